"""Labelled query images: a library image on a random background, turned, scaled and moved, with text-like bars.

Each query is drawn from its own number and the seed, so any number of tasks makes the same set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import images, png

MANIFEST = (
    "image string, src string, crop array<int>, canvas array<int>, bg_hex string, rotation double, scale double, translate array<int>, "
    "texts array<struct<side:string,text:string,size:int,x:int,y:int,color:string>>, content binary"
)
WORDS = "search image lens photo index vector match query label scene frame pixel".split()
LEAST, MOST = 320, 560


def trimmed(raster: np.ndarray) -> tuple[int, int, int, int] | None:
    """x, y, w, h of what has alpha above 4."""
    seen = raster[..., 3] > 4
    ys, xs = np.flatnonzero(seen.any(axis=1)), np.flatnonzero(seen.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1] - xs[0] + 1), int(ys[-1] - ys[0] + 1)) if len(ys) else None


def painted(canvas: np.ndarray, sprite: np.ndarray, scale: float, degrees: float, cx: float, cy: float) -> None:
    """Draws a sprite, scaled and turned about its middle, onto an opaque canvas: each pixel looks up its place in the
    sprite, between pixels by their shares."""
    h, w = canvas.shape[:2]
    sh, sw = sprite.shape[:2]
    t = np.radians(degrees)
    x, y = np.meshgrid(np.arange(w) - cx, np.arange(h) - cy)
    u, v = (x * np.cos(t) + y * np.sin(t)) / scale + (sw - 1) / 2, (-x * np.sin(t) + y * np.cos(t)) / scale + (sh - 1) / 2
    edge = np.pad(sprite.astype(np.float64), ((1, 1), (1, 1), (0, 0)))
    u0, v0 = np.floor(u).astype(np.int64), np.floor(v).astype(np.int64)
    total = np.zeros((h, w, 4))
    for a in (0, 1):
        for b in (0, 1):
            share = np.where(a, u - u0, 1 - u + u0) * np.where(b, v - v0, 1 - v + v0)
            pixel = edge[np.clip(v0 + b + 1, 0, sh + 1), np.clip(u0 + a + 1, 0, sw + 1)]
            total[..., :3] += pixel[..., :3] * (pixel[..., 3:] * share[..., None])
            total[..., 3] += pixel[..., 3] * share
    alpha = total[..., 3:] / 255
    canvas[..., :3] = np.rint(total[..., :3] / 255 + canvas[..., :3] * (1 - alpha)).clip(0, 255)


def turned_box(w: float, h: float, scale: float, degrees: float, cx: float, cy: float) -> tuple[float, float, float, float]:
    c, s = abs(np.cos(np.radians(degrees))), abs(np.sin(np.radians(degrees)))
    across, down = (w * c + h * s) * scale / 2, (w * s + h * c) * scale / 2
    return cx - across, cy - down, cx + across, cy + down


def _bars(rng: np.random.Generator, canvas: np.ndarray, box: tuple) -> list[dict]:
    """Words as rows of bars along some sides, where they don't touch the object."""
    h, w = canvas.shape[:2]
    out = []
    for side in ("top", "bottom", "left", "right"):
        if rng.random() < 0.5:
            continue
        word = str(rng.choice(WORDS)) + (str(int(rng.integers(10, 1000))) if rng.random() < 0.5 else "")
        size = int(rng.integers(12, 28))
        long = min(int(size * 0.6 * len(word)), (w if side in ("top", "bottom") else h) - 8)
        x = int(rng.integers(4, max(5, w - long - 4))) if side in ("top", "bottom") else (4 if side == "left" else w - size - 4)
        y = int(rng.integers(4, max(5, h - long - 4))) if side in ("left", "right") else (4 if side == "top" else h - size - 4)
        bw, bh = (long, size) if side in ("top", "bottom") else (size, long)
        if x < box[2] and x + bw > box[0] and y < box[3] and y + bh > box[1]:
            continue
        level = int(rng.integers(0, 60)) if rng.random() < 0.4 else 255
        area = canvas[y : y + bh, x : x + bw]
        step = max(2, size // 3)
        if side in ("top", "bottom"):
            area[:, np.arange(area.shape[1]) % step < step // 2, :3] = level
        else:
            area[np.arange(area.shape[0]) % step < step // 2, :, :3] = level
        out.append({"side": side, "text": word, "size": size, "x": x, "y": y, "color": f"#{level:02x}{level:02x}{level:02x}"})
    return out


def rendered(rng: np.random.Generator, sprite: np.ndarray) -> tuple[np.ndarray, dict] | None:
    """(canvas, label) for a sprite; None if it is transparent all over."""
    crop = trimmed(sprite)
    if crop is None:
        return None
    x, y, w, h = crop
    cut = sprite[y : y + h, x : x + w]
    size = (int(rng.integers(LEAST, MOST + 1)), int(rng.integers(LEAST, MOST + 1)))
    colour = rng.integers(140, 256, 3)
    canvas = np.full((size[1], size[0], 4), 255, np.uint8)
    canvas[..., :3] = colour
    degrees = float(rng.uniform(0, 360)) if rng.random() < 0.9 else 0.0
    scale = float(rng.uniform(0.35, 0.85)) * min(size) / float(np.hypot(w, h))
    reach = turned_box(w, h, scale, degrees, 0, 0)
    cx, cy = float(rng.uniform(-reach[0], size[0] - reach[2])), float(rng.uniform(-reach[1], size[1] - reach[3]))
    texts = _bars(rng, canvas, turned_box(w, h, scale, degrees, cx, cy))
    painted(canvas, cut, scale, degrees, cx, cy)
    return canvas, {"crop": list(crop), "canvas": list(size), "bg_hex": "#" + "".join(f"{int(c):02x}" for c in colour), "rotation": degrees, "scale": scale, "translate": [round(cx), round(cy)], "texts": texts or None}


def generated(spark: SparkSession, library: DataFrame, n: int = 120, seed: int = 1) -> DataFrame:
    """The manifest of ``n`` queries over ``library`` (path, content), sources drawn with replacement; those that are
    transparent, or can't be decoded, are left out, so there may be fewer."""
    from pyspark.sql import functions as F

    sources = library.select("path", "content")
    count = sources.count()
    if not count:
        return spark.createDataFrame([], MANIFEST)
    numbered = sources.rdd.map(lambda r: r["path"]).zipWithIndex().toDF("path string, at long").join(sources, "path")
    asked = spark.range(n).withColumn("at", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(count)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                try:
                    made = rendered(np.random.default_rng([seed, r.id]), images.decode(bytes(r.content)))
                except ValueError:
                    continue
                if made:
                    out.append({"image": f"q{r.id:05d}.png", "src": r.path, "content": png.encode(made[0])} | made[1])
            yield pd.DataFrame(out, columns=[c.split()[0] for c in MANIFEST.split(", ")])

    return asked.join(numbered, "at").mapInPandas(run, MANIFEST)


def write_manifest(queries: DataFrame, path: str) -> None:
    queries.drop("content").write.mode("overwrite").json(path)
