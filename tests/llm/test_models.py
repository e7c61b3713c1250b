"""Language and toxicity: held-out accuracy, and the grammar on single clauses."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from facetline.llm import language as L
from facetline.llm import toxicity as T

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    out = L.op6_language_id(spark, DATA).join(docs, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg("score"), F.count("*")).first()
    assert out[0] > 0.97 and 0.9 < out[1] <= 1 and out[2] > 100


def test_language_edges(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learned(docs)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "12 .. 34", "x"), (4, "DIE KATZE UND DER HUND", "x"), (4, "DIE KATZE UND DER HUND", "x"), (None, "the dog " * 5000, "x")], "doc_id long, text string, lang_pred string")
    got = [(r.row.doc_id, r.lang_pred) for r in L.predicted(odd, model).collect()]
    assert sorted(got, key=str) == sorted([(1, "und"), (2, "und"), (3, "und"), (4, "de"), (4, "de"), (None, "en")], key=str)
    assert L.learned(docs.where("false")) is None and L.learned(docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r.lang_pred for r in L.predicted(odd, None).collect()} == {"und"}
    assert L.predicted(odd.where("false"), model).count() == 0


def test_more_languages_than_the_sample_has_rows(spark):
    words = ["aba", "cdc", "efe", "ghg", "iji", "klk"]
    rows = [(i, f"{words[i % 6]} " * 9, f"l{i % 6}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.learned(docs, L.Params(sample=2))
    assert model.languages == tuple(f"l{k}" for k in range(6))


def test_vectors_and_chances_against_plain_counts():
    """TF-IDF by a dictionary of n-grams, the chances by the formula of the softmax."""
    from collections import Counter

    rng = np.random.default_rng(3)
    idf, weights = rng.uniform(1, 5, L.DIMENSIONS), rng.normal(0, 1, (L.DIMENSIONS + 1, 3))
    model = L.Model(("a", "b", "c"), idf, weights, 0.7)

    def bucket(gram):
        h = 0
        for k, c in enumerate(gram, 1):
            h = (h * 0x01000193 + ord(c) + k) % 2**32
        return (h * 0x9E3779B1) % 2**32 >> (32 - L.BITS)

    for text in ("Hello, wörld!! 42 hello", "a", "ÉÉ  é", "x" * 300):
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        plain = " " + " ".join(plain.split()) + " "
        counts = Counter(bucket(plain[i : i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1))
        x = {k: (1 + math.log(n)) * idf[k] for k, n in counts.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        logits = [sum(v / norm * weights[k][j] for k, v in x.items()) + weights[-1][j] for j in range(3)]
        odds = [math.exp(z / 0.7) for z in logits]
        assert np.allclose(model.probabilities(*L.features(text)), [o / sum(odds) for o in odds])


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = [(i, "aaa" if i % 2 else "zzz", "x" if i % 2 else "y") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    wrong = docs.withColumn("lang", F.when(L.held_out(), F.lit("wrong")).otherwise(F.col("lang")))
    a, b = L.learned(docs), L.learned(wrong)
    assert a.languages == b.languages and (a.weights == b.weights).all()


@pytest.mark.parametrize(("clause", "symbol"), [
    ("you idiot", T.AIMED), ("the idiot sat", T.STRONG), ("you are not an idiot", T.NEGATED), ("he said you idiot", T.REPORTED), ("i will kill you", T.MENACE), ("stupid", T.WEAK), ("idiot, like you", T.AIMED), ("not here. idiot", T.STRONG), ("Il a dit: IDIOTA!", T.STRONG),
])
def test_clauses(clause, symbol):
    arcs = [kind for c in T.clauses_of(pa.array([clause]))[0] for kind, bit in T.NUMBER.items() if c & bit]
    assert symbol in {out for _, out in arcs}
    if symbol in (T.NEGATED, T.REPORTED):
        assert not {T.STRONG, T.AIMED} & {out for _, out in arcs}


def test_composition_reads_like_one_after_the_other():
    rng = random.Random(0)
    parts = (T._negation(), T._reported(), T._target(), T._threat())
    for _ in range(300):
        clause = [rng.choice(range(10)) for _ in range(rng.randint(1, 9))]
        step = clause
        for fst in parts:
            step = T.read_clause(step, fst)
        assert step == T.read_clause(clause, T.grammar())


def test_toxic_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic")
    rows = T.op7_toxicity_grammar(spark, d).join(labels, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("p")).collect()
    share = {r.toxic: r.p for r in rows}
    assert share[1] > 0.8 and share[0] < 0.01


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([(1, None, 1), (2, "", 2), (3, "you idiot", 3), (3, "you idiot", 3), (None, "fine " * 4000, 4)], "doc_id long, text string, score int")
    model = T.learned(docs, labels)
    assert model == T.Model()
    got = {(r.row.doc_id, r.row.score): round(r.score, 6) for r in T.scored(docs, model).collect()}
    assert got[1, 1] == got[2, 2] == got[None, 4] < 0.1 < 0.7 < got[3, 3]
    assert T.scored(docs.where("false"), model).count() == 0


def test_words_that_explain_labels_are_learned(spark):
    rows = [(i, f"plain words here zorgl{'abcdefghij'[i % 10]} and there" if i % 4 == 0 else f"plain words here {'abcdefghij'[i % 10]}zorg and there {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    model = T.learned(docs, labels)
    assert any("zorgl".startswith(s) or s.startswith("zorgl") for s in model.sure)
    share = {r.toxic: r.p for r in T.scored(docs, model).select("row.doc_id", "score").join(labels, "doc_id").groupBy("toxic").agg(F.avg((F.col("score") >= 0.7).cast("int")).alias("p")).collect()}
    assert share == {0: 0, 1: 1}


@pytest.mark.parametrize(("text", "toxic"), [
    ("you idiot", True), ("you are stupid", True), ("i will kill you", True), ("the idiot sat", False), ("take out the trash. " + "fine words. " * 50 + "garbage day", False),
    ("you are not an idiot. he is not a moron", False), ("he said you idiot. she called him a loser", False), ("i will not kill you", False),
])
def test_clause_weights_reach_the_score(spark, text, toxic):
    got = T.scored(spark.createDataFrame([(1, text)], "doc_id long, text string"), T.Model()).first()
    assert (got.score >= T.Params().threshold) == toxic


def test_composition_sums_weights():
    way = {kind: weight for row in T.grammar().arcs for s, (_, out, weight) in row.items() for kind in [(s, out)]}
    assert way[T.STRONG, T.AIMED] == 1.25 and way[T.STRONG, T.NEGATED] == -2 and way[T.STRONG, T.REPORTED] == -1 and way[T.TARGET, T.MENACE] == 2
    assert T.KINDS[T.STRONG, T.AIMED] == 2.25 and T.KINDS[T.THREAT, T.NEGATED] == -2


def rewritten(symbols):
    """What the grammar writes, by its four rules in plain loops."""
    out, left = [], 0
    for s in symbols:  # three words after a negation
        out.append(T.NEGATED if left and s in (*T.INSULTS, T.THREAT) else s)
        left = 3 if s == T.NEGATION else max(0, left - 1)
    said, told = [], False
    for s in out:
        said.append(T.REPORTED if told and s in (*T.INSULTS, T.THREAT) else s)
        told = told or s == T.SAYING
    aimed, at, kind = [], 0, ""
    for s in said:  # four words after a target or an insult that waits for one
        if s == T.TARGET:
            aimed.append(T.AIMED if at and kind == "insult" else s)
            at, kind = 4, "target"
        elif s in T.INSULTS and at and kind == "target":
            aimed.append(T.AIMED)  # the target holds on
        elif s in T.INSULTS:
            aimed.append(s)
            at, kind = 4, "insult"
        else:
            aimed.append(s)
            at = max(0, at - 1)
    out, intent, threat = [], 0, 0
    for s in aimed:  # three words after an intent, three after its threat
        hit = s == T.TARGET and threat
        out.append(T.MENACE if hit else T.OTHER if s == T.THREAT else s)
        if s == T.INTENT:
            intent, threat = 3, 0
        elif s == T.THREAT:
            intent, threat = 0, 3 if intent else 0
        else:
            intent, threat = max(0, intent - 1), 0 if hit else max(0, threat - 1)
    return out


def plain_score(text, model):
    of_word = {w: s for s, line in T.LEXICON.items() for w in line.split()}
    clauses, now = [], []
    for w in text.split():
        now.append(of_word.get(w.strip(T.STRIP).lower(), T.OTHER))
        if w[-1] in ".!?":
            clauses, now = [*clauses, now], []
    weights = []
    for symbols in [*clauses, now]:
        kinds = {k for k in zip(symbols, rewritten(symbols), strict=True) if k in T.KINDS}
        if kinds:
            weights.append(sum(model.arcs[list(T.KINDS).index(k)] for k in kinds))
    weights.sort(reverse=True)
    x = model.constant + sum(weights[:1]) + model.more * math.log1p(sum(w for w in weights[1:] if w > 0))
    return 1 / (1 + math.exp(-x))


def test_scores_against_plain_rules(spark):
    rng = random.Random(5)
    words = ["idiot", "Scum,", "stupid", "trash", "kill", "you", "them", "not", "never", "said", "will", "stone", "river.", "tree", "sky!", "leaf"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    got = T.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), T.Model()).select("row.doc_id", "score").collect()
    assert len(got) == 400
    for r in got:
        assert r.score == pytest.approx(plain_score(texts[r.doc_id], T.Model()), abs=1e-12), texts[r.doc_id]


def test_grammar_is_needed(spark):
    """Aimed insults and menaces against the same words negated, reported or about nobody: learned weights tell them apart by
    the grammar, and can't by the words."""
    rng = random.Random(9)
    filler = ["stone", "river", "tree", "sky", "leaf", "house"]

    def near(*clause):
        pad = lambda: " ".join(rng.choices(filler, k=rng.randint(0, 6)))
        return f"{pad()} sand. {' '.join(clause)}. {pad()} sand."

    rows = []
    for i in range(600):
        insult = rng.choice(["idiot", "scum", "stupid", "worthless"])
        if i % 2:
            rows.append((i, near("you", rng.choice(filler), insult) if i % 4 == 1 else near("i", "will", "kill", "you"), 1))
        else:
            rows.append((i, near(*rng.choice([("you", "are", "not", insult), ("they", "said", insult), ("the", insult, "sat"), ("i", "will", "not", "kill", "you")])), 0))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    model = T.learned(docs, labels, T.Params(support=10**6))

    def right(model, fst=None):
        got = T.scored(docs, model, fst).select("row.doc_id", "score").where(T.held_out()).collect()
        return sum((r.score >= 0.7) == bool(r.doc_id % 2) for r in got) / len(got)

    words = T.fitted(T.Model(), T.clauses_of(pa.array([t for _, t, _ in rows]), T.Model(), T.identity()), np.array([float(y) for _, _, y in rows]))
    assert right(model) > 0.97 and right(words, T.identity()) < 0.7 and right(model, T.identity()) < 0.7


def test_held_out_labels_teach_nothing(spark):
    rows = [(i, "you idiot" if i % 3 else "fine words") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 3 > 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    wrong = labels.withColumn("toxic", F.when(T.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert T.learned(docs, labels) == T.learned(docs, wrong)
