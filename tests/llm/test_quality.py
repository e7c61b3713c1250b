"""Statistics against a plain count, rules on data of which the answer is known."""

import re

import numpy as np
import pandas as pd
import pyarrow as pa

from facetline.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 8)}
    seen, doubled = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), doubled, len(covered)


TEXTS = [None, "", " \n\t", "a", "x y\nx y\n \n \nx y ", "a b c d e f g h " * 3, "w " * 9, "über ## ñ%% <a|b>\x0b\x0cz\x85q r", "l1\r\nl1\r\nl1", "one two three\n" * 40, "z" * 5000, "A B! 3 c?"]


def test_statistics_against_a_plain_count(spark):
    got = Q.statistics(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        assert tuple(int(got[c][i]) for c in Q.COUNTS[:5]) == plain(t), t
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words int")
    rows = {r.row.doc_id: r for r in Q.measured(df).collect()}
    assert rows[4].n_dup_lines == 1 and rows[4].row.n_words == 1


def test_rules_find_planted_thresholds():
    rng = np.random.default_rng(0)
    x = pd.DataFrame({f: rng.random(3000) for f in Q.FEATURES})
    x["quality"] = np.where((x["symbol_share"] > 0.8) | ((x["upper_share"] > 0.7) & (x["mark_share"] > 0.6)), 0, 1)
    rules = Q.learn(x)
    kept = np.ones(len(x), bool)
    for rule in rules:
        kept &= ~Q._covered(rule, x)
    assert (kept == (x["quality"] == 1)).mean() > 0.97
    assert any(c.feature == "symbol_share" and c.above for rule in rules for c in rule)


def test_no_rules_without_two_classes(spark):
    x = pd.DataFrame({f: np.arange(30.0) for f in Q.FEATURES} | {"quality": 1})
    assert Q.learn(x) == [] and Q.learn(x.iloc[:0]) == []
    docs = spark.createDataFrame([(1, "good words " * 30), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.row.doc_id: (r.base_failed, r.kept) for r in Q.rated(docs, labels).collect()}
    assert got == {1: (True, False), 2: (True, False)}


def test_contract_on_a_table(spark):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in Q.op1_quality_rules(spark, d).collect()}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        n = plain(r.text)
        assert tuple(got[r.doc_id][c] for c in Q.COUNTS[:5]) == n
        assert got[r.doc_id].base_failed == (n[0] < 20 or 100 * n[4] > 30 * n[0])
        assert not (got[r.doc_id].base_failed and got[r.doc_id].kept)
