"""Near-duplicate groups against all pairs of full sets."""

import random
from collections import Counter

import pytest

from facetline.llm import minhash
from facetline.llm.minhash import Params, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=5):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            n = len(x & y)
            if x and y and 100 * n >= 75 * (len(x) + len(y) - n):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def corpus(seed, n, copies=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)] + ["Über", "ÄB", "naïve"]
    rows = []
    for _ in range(n):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 5, 8, 40, 120)))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, copies)):
            near = [w.upper() if rng.random() < 0.2 and w.isascii() else w for w in base]
            for _ in range(rng.choice((0, 1, 2, len(base) // 12))):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append("  ".join(near))
    rng.shuffle(rows)
    return list(enumerate(rows))


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


@pytest.mark.parametrize("small", [64, 2])
def test_against_all_pairs(spark, docs, small):
    """Also with buckets that all count as large, cut into blocks of three."""
    rows = corpus(1, 60)
    p = Params(small=small, block=3 if small == 2 else 2048)
    assert result(near_duplicates(docs(rows).repartition(3), p)) == brute(rows)


def test_one_large_group_of_near_copies(spark, docs):
    rng = random.Random(2)
    base = [f"x{k}" for k in range(80)]
    rows = []
    for i in range(150):
        own = list(base)
        for k in rng.sample(range(80), rng.randint(0, 3)):
            own[k] = f"y{rng.randrange(1000)}"
        rows.append((i, " ".join(own)))
    assert result(near_duplicates(docs(rows), Params(small=8, block=40))) == brute(rows)


def test_shuffled_join_of_candidates(spark, docs):
    rows = corpus(3, 20)
    assert result(near_duplicates(docs(rows), Params(broadcast_ids=0))) == brute(rows)


def test_nulls_empty_repeats_and_other_columns(spark, docs):
    df = docs([(1, None, "a"), (2, "", "b"), (3, " \n", "c"), (4, "one two", "d"), (5, "ONE two", "e"), (5, "ONE two", "e"), (None, "one two", "f"), (6, "long " * 3000, "g")], "doc_id long, text string, kept string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (5, 1, 4, False), (0, 1, None, True), (6, 1, 6, True)], key=str)


def brute_rows(rows):
    """(doc_id, text): size and component of each row, rows being nodes of their own."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def test_rows_that_share_a_doc_id(spark, docs):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(2, a), (5, a + " more"), (5, b), (9, b)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs(rows)).collect())
    assert got == [(2, 2, True), (5, 2, False), (5, 5, True), (9, 5, False)]
    assert sorted(r.text for r in minhash.one_of_each(docs(rows)).collect()) == sorted([a, b])


@pytest.mark.parametrize("seed", [4, 5])
def test_shared_doc_ids_against_all_pairs(spark, docs, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(40), t) for _, t in corpus(seed, 50)]
    rows += rng.choices(rows, k=10)  # repeated rows
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(docs(rows).repartition(3)).collect())
    assert got == sorted(brute_rows(rows))
    left = minhash.one_of_each(docs(rows)).collect()
    texts = [(r.doc_id, r.text) for r in left]
    every = {x[2] for x in brute_rows(rows)}
    assert len(texts) == len(set(texts)) and {i for i, _ in texts} == every
    # one row of each group: as many as there are groups among the rows themselves
    groups = brute_rows([(k, t) for k, (_, t) in enumerate(rows)])
    assert len(texts) == len({c for _, n, c in groups if n})


def test_one_of_each_keeps_rows_outside_of_groups(spark, docs):
    rows = [(1, None, "a"), (1, None, "b"), (2, "", "c"), (None, "one two", "d"), (None, "one two", "e"), (3, "one two", "f"), (3, "one two", "g"), (4, "ONE two", "h")]
    out = minhash.one_of_each(docs(rows, "doc_id long, text string, mark string"))
    assert out.columns == ["doc_id", "text", "mark"]
    got = sorted(r.mark for r in out.collect())
    assert len(got) == 6 and set("abcde") < set(got) and got[-1] in "fg"


def test_empty_table(spark, docs):
    assert near_duplicates(docs([])).count() == 0 and minhash.one_of_each(docs([])).count() == 0


def test_estimate_leaves_room_for_the_threshold():
    p = Params()
    assert p.least_match(128) < p.least_match(1024) < 1 / 16 + 15 / 16 * 0.75
    assert minhash.LANES == int("1" * 16, 16)


def exact_components(rows):
    """Components by a prefix filter: of two sets that are similar enough, those of their rarest shingles that may be left
    out of the common ones and one more meet. Nothing is estimated."""
    own = {i: sorted({hash(s) for s in shingles(t)}) for i, t in rows}
    groups = {}
    for i, s in own.items():
        groups.setdefault(tuple(s), []).append(i)
    count = Counter(g for s in groups for g in s)
    parent = {i: i for i in own}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def join(x, y):
        p, q = root(x), root(y)
        parent[max(p, q)] = min(p, q)

    places, links = {}, 0
    for s, ids in groups.items():
        if not s:
            continue
        for i in ids[1:]:
            join(ids[0], i)
        rare = sorted(s, key=lambda g: (count[g], g))[: len(s) - -(-3 * len(s) // 4) + 1]
        seen = {k for g in rare for k in places.get(g, ())}
        for k in seen:
            n = len(set(s).intersection(k))
            if 100 * n >= 75 * (len(s) + len(k) - n):
                join(ids[0], groups[k][0])
                links += 1
        for g in rare:
            places.setdefault(g, []).append(s)
    return {i: (len(s), root(i), root(i) == i) for i, s in own.items()}, links


def test_no_link_of_a_whole_table_is_lost(spark):
    """10,000 documents against an exact join of their full sets."""
    data = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    want, links = exact_components([(r.doc_id, r.text) for r in data.collect()])
    assert links > 50 and len(want) > 5_000
    assert result(near_duplicates(data)) == want
