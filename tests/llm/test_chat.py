"""Maximal conversations against comparing all pairs."""

import random

from facetline.llm.chat import collapsed


def brute(rows):
    talks = {}
    for c, turn, role, text in rows:
        if c is not None:
            talks.setdefault(c, []).append((turn, role, text))
    low = lambda v: (v is not None, v if v is not None else 0)
    name = lambda v: (v is not None, v or "")
    said = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (low(x[0]), name(x[1]), name(x[2])))] for c, v in talks.items()}
    out = {}
    for c, own in said.items():
        same = sorted(d for d, other in said.items() if other == own)
        if same[0] == c and not any(len(o) > len(own) and o[: len(own)] == own for o in said.values()):
            out[c] = (len(own), len(same), "".join(f"<|{r or ''}|>\n{t or ''}<|end|>\n" for r, t in own))
    return out


def result(df):
    parts = {}
    for r in df.collect():
        parts.setdefault(r.conv_id, []).append(r)
    return {c: (p[0].n_turns, p[0].copies, "".join(x.rendered for x in sorted(p, key=lambda x: x.part))) for c, p in parts.items()}


SCHEMA = "conv_id long, turn long, role string, text string"


def test_against_all_pairs(spark):
    rng = random.Random(0)
    rows, c = [], 0
    for _ in range(30):
        base = [(rng.choice(("user", "assistant", None)), rng.choice(("hi", "yes", "no", "", None))) for _ in range(rng.randint(1, 7))]
        for _ in range(rng.randint(1, 4)):
            for k, (role, text) in enumerate(base[: rng.randint(1, len(base))]):
                rows.append((c, k + rng.choice((0, 10)) * (c % 2), role, text))
            c += 1
    rng.shuffle(rows)
    assert result(collapsed(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_long_conversation_runs_over_parts(spark):
    rows = [(1, k, "user", f"t{k}") for k in range(700)] + [(2, k, "user", f"t{k}") for k in range(600)] + [(3, k, "user", f"t{k}") for k in range(600)] + [(4, 0, "user", "other")]
    got = collapsed(spark.createDataFrame(rows, SCHEMA))
    assert result(got) == brute(rows) and got.where("conv_id = 1").count() == 3


def test_nulls_ties_repeats_and_other_columns(spark):
    rows = [(None, 0, "user", "x"), (1, None, "user", "a"), (1, 0, "user", "b"), (2, 5, "user", "a"), (2, 5, "user", "b"), (2, 5, "user", "b"), (3, 0, None, None), (4, 0, "", "")]
    df = spark.createDataFrame([(*r, 7, "p") for r in rows], SCHEMA + ", place int, copies string")
    assert result(collapsed(df)) == brute(rows)
    assert collapsed(df.where("false")).count() == 0


def test_many_turns_without_a_number(spark):
    rng = random.Random(1)
    rows = [(1, None, rng.choice(("user", None)), f"t{rng.randrange(400)}") for _ in range(1500)] + [(2, 3, "user", "same")] * 600 + [(3, 3, "user", "same")] * 599
    got = collapsed(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert result(got) == brute(rows)
    assert got.where("conv_id = 1").count() == 6 and got.selectExpr("max(size(split(rendered, '<.end.>')))").first()[0] <= 257
