"""Queries and SQL of this subpackage."""

from __future__ import annotations

from . import chat, language, media, minhash, mixing, pieces, quality, tokens, toxicity, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality.op1_quality_rules,
        "op2_source_mixing": mixing.op2_source_mixing,
        "op3_token_files": tokens.op3_token_files,
        "op4_flac_media": media.op4_flac_media,
        "op5_chat_collapse": chat.op5_chat_collapse,
        "op6_language_id": language.op6_language_id,
        "op7_toxicity_grammar": toxicity.op7_toxicity_grammar,
        "op8_sentencepiece_nbest": pieces.op8_sentencepiece_nbest,
        "op9_warc_fixity": warc.op9_warc_fixity,
        "op10_minhash_near_dedup": minhash.op10_minhash_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_collapse": chat.OP5_SQL, "op10_minhash_near_dedup": minhash.OP10_SQL}
