"""Image search from pixels to ranks.

Building is one pass over the images: decode, describe, write. Searching goes through the index three times, each time
with fewer rows and wider columns: a 545-wide vector of every row for the cheap score, all columns of a short list, the
masks of the first twelve. The stages between are windows over ids and scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mlp, ranking, search
from ..operators.raster import bounds, masks
from ..operators.raster import descriptors as D
from ..operators.raster import pairs as P
from ..sources import images, sheets

REGIONS = "array<struct<occ:array<double>,area:int,nx:double,ny:double,fill:double,aspect:double>>"
CHEAP = ("hist", "zern", "radial", "ang_mag")
VECTORS = (*D.WIDTHS, "cheap", "occ64", "patch", "occ_bbox64", "patch_bbox", "fourier", "rad")
SCHEMA = "path string, mtime timestamp, length long, error string, n int, mono boolean, " + ", ".join(f"{v} array<double>" for v in VECTORS) + f", regions {REGIONS}, solidity double, area int"
COLUMNS = [c.split()[0] for c in "path mtime length error n mono".split()] + list(VECTORS) + ["regions", "solidity", "area"]


#: columns of an index that ``expert_ranked`` can search
EXTRA = ("occ32", "occ16", "hog")
EXTRA_SCHEMA = SCHEMA + ", " + ", ".join(f"{v} array<double>" for v in EXTRA) + ", points array<array<double>>, context array<array<double>>"
EXTRA_COLUMNS = [*COLUMNS, *EXTRA, "points", "context"]


def describe(raster: np.ndarray, is_query: bool, extra: bool = False) -> dict | None:
    """Both descriptors. The object of a library image is what isn't transparent, that of a query image what differs from
    its background."""
    cover = masks.query_coverage(raster) if is_query else masks.library_coverage(raster)
    found = D.features(raster, cover)
    if found is None:
        return None
    found["cheap"] = np.concatenate([found[c] for c in CHEAP])
    return found | {"regions": None} | (D.shape(raster, extra) or {})


def outlined(raster: np.ndarray, is_query: bool) -> dict | None:
    """What ``describe`` says of the shape alone, with ``extra``."""
    cover = masks.query_coverage(raster) if is_query else masks.library_coverage(raster)
    return (D.shape(raster, True) or {}) if (cover > 0).any() else None


def _frame(rows: list[dict], extra: bool = False) -> pd.DataFrame:
    for row in rows:
        for c in ("points", "context"):
            if row.get(c) is not None:
                row[c] = [list(map(float, v)) for v in row[c]]
    return pd.DataFrame(rows, columns=EXTRA_COLUMNS if extra else COLUMNS).astype(object).where(lambda x: x.notna(), None)


def described(rows: DataFrame, converter: images.Converter | None = None, extra: bool = False) -> DataFrame:
    """(path, mtime, length, content) to rows of the index. What can't be decoded, or shows nothing, has only an error.
    ``extra`` adds what only ``expert_ranked`` reads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                row = {"path": r.path, "mtime": r.mtime, "length": r.length}
                try:
                    if r.content is None:
                        raise ValueError("can't be read")
                    found = describe(images.decode(bytes(r.content), str(r.path).rpartition(".")[2], converter), False, extra)
                    row |= found if found else {"error": "nothing is covered"}
                except Exception as e:  # of one file; it must not end the build
                    row["error"] = str(e)[:200] or type(e).__name__
                out.append(row)
            yield _frame(out, extra)

    return rows.mapInPandas(run, EXTRA_SCHEMA if extra else SCHEMA)


def cheap_scores(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    at = np.cumsum([0] + [D.WIDTHS[c] for c in CHEAP])
    part = [slice(a, b) for a, b in zip(at[:-1], at[1:], strict=True)]
    shared = np.stack([np.minimum(x, r[:, part[0]]).sum(axis=1) for x in q[:, part[0]]])
    return 0.4 * shared + 0.2 * sum(search.cosine(q[:, p], r[:, p]) for p in part[1:])


def _asked_of(listed: DataFrame, index: DataFrame, columns: tuple) -> DataFrame:
    """Rows of the index with ``asked``, the query_id and other columns of the pairs they are in: pairs go to where the wide
    rows lie, and those are not shuffled while the pairs can be broadcast."""
    pairs = listed.groupBy("ref_id").agg(F.collect_list(F.struct(*[c for c in listed.columns if c != "ref_id"])).alias("asked"))  # one for each query at most
    small = listed.count() <= search.BROADCAST
    return index.select("ref_id", *columns).join(F.broadcast(pairs) if small else pairs, "ref_id")


def _by_query(batch: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
    """Each query with its rows of a batch, and what else its pairs say."""
    if not len(batch):
        return
    named = batch.explode("asked", ignore_index=True)
    told = pd.DataFrame(named.pop("asked").tolist(), index=named.index)
    yield from pd.concat([named, told], axis=1).groupby("query_id")


#: queries that a task keeps prepared (about 3 MB each); others are prepared anew for each batch that needs them
KEPT = 64


def _made(ready: dict, name: int, make) -> dict:
    q = ready.get(name) or make()
    if len(ready) < KEPT:
        ready[name] = q
    return q


#: columns that pairs are made of
PAIRED = ("hist", "radial", "ang_mag", "polar_shape", "polar_col", "zern", "mask", "occ64", "occ_bbox64", "patch", "patch_bbox", "regions", "fourier", "rad")


def _pair_vectors(queries: dict[int, dict]):
    """27 values of each pair: seven similarities, mask, gate (0 here), mono, 16 rings, expert score."""

    def make(q: dict) -> dict:
        return (P.prepared(q) if q.get("occ64") is not None else q) | {"mask_turns": P.mask_turns(q["mask"])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, dict] = {}
        for batch in batches:
            out = []
            for name, group in _by_query(batch):
                q = _made(ready, name, lambda name=name: make(queries[name]))
                turns = q["mask_turns"]
                dice = P.mask_scores(turns, float(q["mask"].sum()), np.stack(group["mask"].to_numpy()))
                shaped = group["occ64"].notna().to_numpy() if "occ_turns" in q else np.zeros(len(group), bool)
                expert = np.zeros(len(group))
                if shaped.any():
                    expert[shaped] = P.experts(q, P.stacked(group[shaped]))
                for r, mask, known in zip(group.to_dict("records"), dice, expert, strict=True):
                    v = [*P.seven(q, r), float(mask), 0.0, float(q["mono"]), *P.polar_detail(q["polar_shape"], r["polar_shape"]), float(known)]
                    out.append((name, r["ref_id"], r["pref"], v[0], [float(x) for x in v]))
            yield pd.DataFrame(out, columns=["query_id", "ref_id", "pref", "hist", "v"])

    return run


def _contexts(queries: dict[int, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, list] = {}
        for batch in batches:
            out, own = [], [P.contexts(P.context_points(m)) for m in batch["mask"]]
            for ref, asked, context in zip(batch["ref_id"], batch["asked"], own, strict=True):
                for name in (a["query_id"] for a in asked):
                    turns = _made(ready, name, lambda name=name: P.context_turns(queries[name]["mask"]))
                    out.append((name, ref, P.context_similarity(turns, context)))
            yield pd.DataFrame(out, columns=["query_id", "ref_id", "second"])

    return run


#: descriptors of one query's rows that are read at once; of those that are weighed in six dimensions
STEP, WEIGHED = 64, 256


def _of_sheets(kernel, home: str, columns: tuple, step: int):
    """``kernel`` for rows of a query with the places of its descriptors, a query at a time: it is prepared once, and neither
    it nor what it is held against is kept for the next."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = sheets.Reader(home)

        def read(name: int, refs: list) -> Iterator[pd.DataFrame]:
            for a in range(0, len(refs), step):
                found = [reader.get(*(r[c] for c in sheets.PLACE)) for r in refs[a : a + step]]
                asked = [[{"query_id": name} | {c: v for c, v in r.items() if c not in (*sheets.PLACE, "ref_id")}] for r in refs[a : a + step]]
                yield pd.DataFrame({"ref_id": [r["ref_id"] for r in refs[a : a + step]], "asked": asked} | {c: pd.Series([f.get(c) for f in found], dtype=object) for c in columns})

        for batch in batches:
            for name, refs in zip(batch["query_id"], batch["refs"], strict=True):
                yield from kernel(read(name, sorted(refs, key=lambda r: (r["file"], r["at"]))))

    return run


def _paired(listed: DataFrame, index: DataFrame, columns: tuple, kernel, queries, schema: str, step: int = STEP) -> DataFrame:
    """What ``kernel`` makes of the listed pairs. Of an index with places only those are shuffled, to the pair's query."""
    if "file" not in index.columns:
        return _asked_of(listed, index, columns).mapInPandas(kernel(queries), schema)
    placed = listed.join(index.select("ref_id", *sheets.PLACE), "ref_id")
    of_query = placed.groupBy("query_id").agg(F.collect_list(F.struct(*[c for c in placed.columns if c != "query_id"])).alias("refs"))
    # few bytes, much work on each
    spread = of_query.repartition(max(4 * index.sparkSession.sparkContext.defaultParallelism, -(-len(queries) // STEP)))
    return spread.mapInPandas(_of_sheets(kernel(queries), queries.home, columns, step), schema)


def ranked(index: DataFrame, queries: dict[int, dict], k: int | None = 5, network: mlp.Network | None = None, short: int = 50, refine: int = 12, blend: float = 0.7) -> DataFrame:
    """query_id, ref_id, score, stage and rank of the ``k`` best rows of ``index`` (with ref_id) for each query
    descriptor. Without a network the cheap score ranks. k of None gives all rows, those behind the short list by their
    cheap score. An index with places goes with ``Sheets`` of the same folder as queries."""
    spark = index.sparkSession
    index = index.where("error IS NULL")
    asked = queries.vectors if isinstance(queries, sheets.Sheets) else spark.createDataFrame([(i, [float(x) for x in q["cheap"]]) for i, q in sorted(queries.items())], "id long, vector array<double>")
    most = index.count() if k is None else max(k, short)
    # a row for each query and place on its list: written, as the short list and the rows behind it both read them
    cheap = search.top_k(index.select("ref_id", "cheap"), asked, cheap_scores, most).withColumnRenamed("score", "pref")
    cheap = search.cut(cheap)
    if network is None:
        return cheap.where(F.col("rank") <= most if k is None else F.col("rank") <= k).select("query_id", "ref_id", F.col("pref").alias("score"), F.lit(2).alias("stage"), "rank")
    listed = cheap.where(F.col("rank") <= short).select("query_id", "ref_id", "pref")
    pairs = _paired(listed, index, PAIRED, _pair_vectors, queries, "query_id long, ref_id long, pref double, hist double, v array<double>")
    gated = pairs.withColumn("gate", ranking.family_gate("hist"))
    gated = gated.withColumn("v", F.concat(F.slice("v", 1, 8), F.array(F.col("gate").cast("double")), F.slice("v", 10, 18)))
    gated = search.cut(gated)
    scored = mlp.predicted(ranking.with_leads(gated, "v"), "v", network)
    order = ranking.per_query().orderBy(F.desc("score"), F.desc("hist"), F.desc("gate"), "ref_id")
    first = scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= refine)
    first = search.cut(first.select("query_id", "ref_id"))
    second = _paired(first, index, ("mask",), _contexts, queries, "query_id long, ref_id long, second double")
    head = ranking.blended(scored.join(second, ["query_id", "ref_id"], "left"), refine, blend).select("query_id", "ref_id", "score", "rank")
    return ranking.with_tail(search.cut(head), cheap.select("query_id", "ref_id", "pref"), k)


def from_grid(values, label: int, cell: int = 6, margin: int = 8) -> np.ndarray:
    """A drawing of an 8 x 8 grid: cells above 0 in a colour of the label, brighter for larger values."""
    v = np.asarray(values, np.float64).reshape(8, 8)
    side = 8 * cell + 2 * margin
    out = np.zeros((side, side, 4), np.uint8)
    turn = np.array([0, 2, 4]) * np.pi / 3 + label * 0.6
    base = 90 + 70 * np.cos(turn)
    big = np.kron(v, np.ones((cell, cell)))
    inner = out[margin:-margin, margin:-margin]
    inner[..., :3] = np.where(big[..., None] > 0, np.clip(base + 250 * np.clip(big, 0, 0.4)[..., None], 0, 255), 0)
    inner[..., 3] = np.where(big > 0, 255, 0)
    return out


def on_background(raster: np.ndarray, colour=(236, 240, 232)) -> np.ndarray:
    a = raster[..., 3:].astype(np.float64) / 255
    rgb = raster[..., :3] * a + np.array(colour) * (1 - a)
    return np.concatenate([np.rint(rgb).astype(np.uint8), np.full_like(raster[..., 3:], 255)], axis=-1)


def described_sheets(rows: DataFrame, describe_row, columns: tuple | None, home: str, vectors: bool = True) -> DataFrame:
    """id, error, shaped, vector (the cheap one) and place of what ``describe_row`` makes of (vec_id, embedding, label), of
    which ``columns`` (all, if None) are written to ``home``. The table is written as well, as descriptors are made once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with sheets.Writer(home) as out:
            for batch in batches:
                for a in range(0, len(batch), STEP):
                    made = []
                    for r in batch[a : a + STEP].itertuples(index=False):
                        found = describe_row(r)
                        if found is None:
                            made.append((r.vec_id, "nothing is covered", False, None, None, 0, 0))
                            continue
                        kept = found if columns is None else {c: found.get(c) for c in columns}
                        made.append((r.vec_id, None, found.get("occ64") is not None, found["cheap"] if vectors else None, *out.put(kept)))
                    yield pd.DataFrame(made, columns=["id", "error", "shaped", "vector", *sheets.PLACE])

    spread = rows.select("vec_id", "embedding", "label").repartition(max(rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))  # small rows, much work on each
    return search.cut(spread.mapInPandas(run, f"id long, error string, shaped boolean, vector array<double>, {sheets.PLACE_SCHEMA}"))


def drawings(spark: SparkSession, sf_dir: str, extra: bool, home: str) -> DataFrame:
    """The index of drawings of all embeddings, descriptors in ``home``."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    made = described_sheets(rows, lambda r: (outlined if extra else describe)(from_grid(r.embedding, r.label), False), (*SIX, "rad") if extra else PAIRED, home, not extra)
    return made.withColumnsRenamed({"id": "ref_id", "vector": "cheap"})


# -- colour-agnostic search ---------------------------------------------------------------------------------------------

#: weights of the six dimensions before a query's own spread moves them
PRIOR = {"occ": 0.20, "ncc": 0.20, "reg": 0.20, "hog": 0.10, "sc": 0.10, "fd": 0.20}
#: columns that they read
SIX = ("occ64", "occ_bbox64", "patch", "patch_bbox", "hog", "fourier", "regions", "solidity", "context")


def _global(queries: dict[int, dict]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, dict] = {}
        for batch in batches:
            rows = P.stacked(batch)
            for i, q in queries.items():
                yield pd.DataFrame({"query_id": i, "ref_id": batch["ref_id"], "global": P.experts(_made(ready, i, lambda q=q: P.prepared(q)), rows)})

    return run


#: columns that the global score reads
GLOBAL = ("occ64", "occ_bbox64", "patch", "patch_bbox", "fourier", "rad", "regions")
#: queries that rows are held against at once (0.2 MB each), and descriptors that are read at once
ASKED, ROWS = 64, 128
#: rows of a chunk of bounds' coordinates (some 6 KB each), rows whose bounds are held at once, rows that axes are fitted on
PACKED, SPAN, FITTED = 2048, 1 << 17, 1024


def _read(reader: sheets.Reader, places) -> dict:
    found = [[f[c] for c in GLOBAL] for f in (reader.get(*x) for x in places)]
    return {c: pd.Series(v, dtype=object) for c, v in zip(GLOBAL, map(list, zip(*found, strict=True)), strict=True)}


def _axes(reader: sheets.Reader, places: list) -> dict:
    """Axes of bounds, fitted on at most ``FITTED`` rows: bounds are true whatever they are."""
    found = [reader.get(*x) for x in places[:: -(-len(places) // FITTED)]]
    return bounds.axes({c: np.array([f[c] for f in found], np.float32) for c in bounds.ALONG})


def _chunks(reader: sheets.Reader, axes: dict, batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    """Coordinates of rows with places, with their ids and places."""
    for batch in batches:
        for a in range(0, len(batch), PACKED):
            part = batch[a : a + PACKED].reset_index(drop=True)
            made = [bounds.of_rows(P.stacked(_read(reader, part[b : b + ROWS][list(sheets.PLACE)].itertuples(index=False))), axes) for b in range(0, len(part), ROWS)]
            yield bounds.joined(made) | {"rows": part[["ref_id", *sheets.PLACE]]}


def _best_of_chunks(queries: sheets.Sheets, names: list[int], most: int, reader: sheets.Reader, axes: dict, chunks) -> Iterator[pd.DataFrame]:
    """The ``most`` best rows of ``chunks`` (called for each block of queries) by their global score: those that can reach a
    query's list are read, the likeliest first."""
    for a in range(0, len(names), ASKED):
        block = names[a : a + ASKED]
        asked = [bounds.of_query(P.prepared(queries[i]), axes) for i in block]
        held = dict.fromkeys(block, (np.empty(0, np.int64), np.empty(0)))
        rows, above, size = [], [], 0

        def settle() -> None:
            nonlocal rows, above, size
            every, most_of = pd.concat(rows, ignore_index=True), np.concatenate(above, axis=1)
            ids, place = every["ref_id"].to_numpy(np.int64), every[list(sheets.PLACE)].to_numpy()
            rows, above, size = [], [], 0
            for i, bound in zip(block, most_of, strict=True):
                # a full list takes only what reaches its last score
                least = lambda i=i: held[i][1][-1] if len(held[i][1]) == most else -np.inf
                near = np.flatnonzero(bound >= least())
                near, q = near[np.argsort(-bound[near], kind="stable")], None
                for b in range(0, len(near), ROWS):
                    part = near[b : b + ROWS]
                    part = np.sort(part[bound[part] >= least()])
                    if not len(part):
                        break
                    q = q or P.prepared(queries[i])
                    scores = P.experts(q, P.stacked(_read(reader, place[part])), least())
                    live = ~np.isneginf(scores)
                    held[i] = search._best(np.concatenate([held[i][0], ids[part][live]]), np.concatenate([held[i][1], scores[live]]), most)

        for chunk in chunks():
            rows.append(chunk["rows"])
            above.append(bounds.bounds(asked, chunk))
            size += len(chunk["rows"])
            if size >= SPAN:
                settle()
        if size:
            settle()
        for i, (ids, scores) in held.items():
            yield pd.DataFrame({"query_id": i, "ref_id": ids, "global": scores})


def _best_of_sheets(queries: sheets.Sheets, most: int):
    """For few queries: of a task's rows with places the ``most`` best for each query by their global score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([*batches, pd.DataFrame(columns=["ref_id", *sheets.PLACE])]).sort_values(["file", "at"])
        if not len(rows):
            return
        reader = sheets.Reader(queries.home)
        axes = _axes(reader, list(rows[list(sheets.PLACE)].itertuples(index=False)))
        yield from _best_of_chunks(queries, list(queries), most, reader, axes, lambda: _chunks(reader, axes, iter([rows])))

    return run


def _best_by_query(live: DataFrame, queries: sheets.Sheets, most: int) -> DataFrame:
    """For many queries: a task has some of them and goes through the coordinates of all rows, which lie in files, so that a
    query's list is full of its best rows before others are read."""
    spark, home = live.sparkSession, queries.home
    rows = live.select("ref_id", *sheets.PLACE)

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if places := [x for batch in batches for x in batch.itertuples(index=False)]:
            with sheets.Writer(home) as out:
                yield pd.DataFrame([out.put(_axes(sheets.Reader(home), places), packed=False)], columns=list(sheets.PLACE))

    sample = rows.orderBy(F.xxhash64("ref_id"), "ref_id").limit(FITTED).select(*sheets.PLACE)
    axes_at = sample.coalesce(1).mapInPandas(fit, sheets.PLACE_SCHEMA).collect()
    if not axes_at:
        return spark.createDataFrame([], "query_id long, ref_id long, global double")
    axes_at = tuple(axes_at[0])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = sheets.Reader(home)
        with sheets.Writer(home) as out:
            places = [out.put(chunk, packed=False) for chunk in _chunks(reader, reader.get(*axes_at), batches)]
        yield pd.DataFrame(places, columns=list(sheets.PLACE))

    chunks = sorted(tuple(r) for r in rows.mapInPandas(pack, sheets.PLACE_SCHEMA).collect())
    size = min(ASKED, -(-len(queries) // (4 * spark.sparkContext.defaultParallelism)))
    blocks = -(-len(queries) // size)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, names = sheets.Reader(home), list(queries)
        for b in (b for batch in batches for b in batch["id"]):
            yield from _best_of_chunks(queries, names[b * size : (b + 1) * size], most, reader, reader.get(*axes_at), lambda: (reader.get(*x) for x in chunks))

    return spark.range(0, blocks, 1, blocks).mapInPandas(run, "query_id long, ref_id long, global double")


def _six(queries: dict[int, dict]):
    """The six dimensions of each pair, a query of a batch at a time."""

    def make(q: dict) -> dict:
        return P.prepared(q) | {"contour_turns": P.contour_turns(q["points"])}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready: dict[int, dict] = {}
        for batch in batches:
            for name, group in _by_query(batch):
                v = P.six(_made(ready, name, lambda name=name: make(queries[name])), group)
                ids = group["ref_id"].to_numpy()
                yield pd.DataFrame({"query_id": name, "ref_id": np.repeat(ids, len(PRIOR)), "dim": list(PRIOR) * len(ids), "score": v.ravel()})

    return run


def expert_ranked(index: DataFrame, queries: dict[int, dict], k: int = 5, cut: float = 0.0, most: int = 200) -> DataFrame:
    """query_id, ref_id, score and rank by shape alone: a global score of every row, those that reach ``cut`` (all, if
    none does), the best ``most`` of them in six dimensions, whose weights each query's own spread sets.

    ``index`` and ``queries`` are described with ``extra``; rows without a shape are left out. With fewer than three
    candidates the prior weights hold."""
    order = (F.desc("global"), F.asc("ref_id"))
    if "file" in index.columns:
        live = index.where("error IS NULL AND shaped")
        if len(queries) <= ASKED:
            scores = live.select("ref_id", *sheets.PLACE).mapInPandas(_best_of_sheets(queries, most), "query_id long, ref_id long, global double")
        else:
            scores = _best_by_query(live, queries, most)
    else:
        live = index.where("error IS NULL AND occ64 IS NOT NULL")
        wide = live.select("ref_id", *GLOBAL)
        scores = wide.mapInPandas(_global(queries), "query_id long, ref_id long, global double")
    # rows that reach the cut come first, so the best ``most`` of them are among the best ``most`` of all
    short = ranking.cut_or_all(search.ranked(scores, most, order), "global", cut).select("query_id", "ref_id")
    dims = search.cut(_paired(search.cut(short), live, SIX, _six, queries, "query_id long, ref_id long, dim string, score double", WEIGHED))
    return search.ranked(ranking.fused(dims, ranking.adaptive_weights(dims, PRIOR)), k)
