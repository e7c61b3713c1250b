"""Masks: morphology, components, segmentation of query and library images, row bands."""

from __future__ import annotations

import numpy as np

#: four and eight neighbours as (dy, dx)
FOUR = ((-1, 0), (1, 0), (0, -1), (0, 1))
EIGHT = (*FOUR, (-1, -1), (-1, 1), (1, -1), (1, 1))


def _shifted(mask: np.ndarray, steps: tuple) -> np.ndarray:
    """One plane for each step: the value of the neighbour there, False outside."""
    h, w = mask.shape
    edge = np.pad(mask, 1)
    return np.stack([edge[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in steps])


def dilate(mask: np.ndarray, times: int = 1) -> np.ndarray:
    for _ in range(times):
        mask = mask | _shifted(mask, EIGHT).any(axis=0)
    return mask


def erode(mask: np.ndarray, times: int = 1, steps: tuple = EIGHT) -> np.ndarray:
    """A cell stays if all its neighbours are set; outside counts as empty, so with eight the border goes."""
    for _ in range(times):
        mask = mask & _shifted(mask, steps).all(axis=0)
    return mask


def labels(mask: np.ndarray, steps: tuple = EIGHT) -> tuple[np.ndarray, int]:
    """(label of each cell, 0 outside; number): components numbered in the order of their first cell.

    Runs of each row are joined with the runs of the row above that they touch."""
    h, w = mask.shape
    reach = int(len(steps) == 8)
    edge = np.zeros((h, w + 2), np.int8)
    edge[:, 1:-1] = mask
    y, x = np.nonzero(np.diff(edge, axis=1))  # a run's first cell and the one behind it, in turn
    rows, first, end = y[::2].tolist(), x[::2].tolist(), x[1::2].tolist()
    parent = list(range(len(rows)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    above = 0  # first run of the row above that may touch the next run or those behind it
    for k, (row, a, b) in enumerate(zip(rows, first, end, strict=True)):
        while above < k and (rows[above] < row - 1 or (rows[above] == row - 1 and end[above] + reach <= a)):
            above += 1
        j = above
        while j < k and rows[j] == row - 1 and first[j] < b + reach:
            u, v = root(k), root(j)
            parent[max(u, v)] = min(u, v)
            j += 1
    number: dict[int, int] = {}
    own = np.array([number.setdefault(root(k), len(number) + 1) for k in range(len(rows))], np.int64)
    out = np.zeros(h * w, np.int64)
    sizes = (x[1::2] - x[::2]).astype(np.int64)
    out[mask.ravel()] = np.repeat(own, sizes)
    return out.reshape(h, w), len(number)


def areas(label: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(label.ravel(), minlength=n + 1)[1:]


def without_small(mask: np.ndarray, least: int, steps: tuple = FOUR) -> np.ndarray:
    label, n = labels(mask, steps)
    return np.concatenate([[False], areas(label, n) >= least])[label]


def touches_border(mask: np.ndarray) -> bool:
    return bool(mask[0].any() or mask[-1].any() or mask[:, 0].any() or mask[:, -1].any())


def flooded(open_cells: np.ndarray) -> np.ndarray:
    """Open cells that four steps at a time lead to from the border."""
    label, _ = labels(open_cells, FOUR)
    edge = np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]]))
    return np.isin(label, edge[edge > 0])


def box(mask: np.ndarray) -> tuple[int, int, int, int] | None:
    """x0, y0, x1, y1, the last two exclusive; None for an empty mask."""
    ys, xs = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    return (int(xs[0]), int(ys[0]), int(xs[-1]) + 1, int(ys[-1]) + 1) if len(ys) else None


def centroid(mask: np.ndarray) -> tuple[float, float]:
    ys, xs = np.nonzero(mask)
    return float(xs.mean() + 0.5), float(ys.mean() + 0.5)


def frame(mask: np.ndarray) -> tuple[float, float, float] | None:
    """Centre and side of the square that holds the mask however it is turned: 2.02 times the largest radius."""
    if not mask.any():
        return None
    cx, cy = centroid(mask)
    ys, xs = np.nonzero(mask)
    reach = float(np.hypot(xs + 0.5 - cx, ys + 0.5 - cy).max())
    return (cx, cy, 2.02 * reach) if reach > 0 else None


def radial_percentile(mask: np.ndarray, share: float) -> float:
    cx, cy = centroid(mask)
    ys, xs = np.nonzero(mask)
    r = np.sort(np.hypot(xs + 0.5 - cx, ys + 0.5 - cy))
    return float(r[int((len(r) - 1) * share)])


# -- rows ---------------------------------------------------------------------------------------------------------------


def runs(present: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of each run of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], present.view(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def heaviest_band(mask: np.ndarray) -> np.ndarray:
    """Only the heaviest run of rows that 3% of the width fill; everything if there is but one, or if it is lower than a
    tenth of the height."""
    h, w = mask.shape
    counts = mask.sum(axis=1)
    bands = runs(counts >= max(1, int(0.03 * w)))
    if len(bands) < 2:
        return mask
    a, b = max(bands, key=lambda r: int(counts[r[0] : r[1]].sum()))
    if b - a < h / 10:
        return mask
    out = np.zeros_like(mask)
    out[a:b] = mask[a:b]
    return out


def content_bands(dark: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, end, cells) of runs of rows with dark cells; thin ones (under 3% of the height, 2 rows at least) go
    before those with gaps under 12% (3 rows) are joined."""
    h = dark.shape[0]
    counts, out = dark.sum(axis=1), []
    for a, b in runs(counts > 0):
        if b - a < max(2, int(0.03 * h)):
            continue
        n = int(counts[a:b].sum())
        if out and a - out[-1][1] < max(3, int(0.12 * h)):
            out[-1] = (out[-1][0], b, out[-1][2] + n)
        else:
            out.append((a, b, n))
    return out


def main_band(bands: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The band with most cells, if it has twice those of the second."""
    ranked = sorted(bands, key=lambda b: -b[2])
    return ranked[0] if ranked and (len(ranked) < 2 or ranked[0][2] >= 2 * ranked[1][2]) else None


# -- segmentation -------------------------------------------------------------------------------------------------------


def distance(raster: np.ndarray, colour) -> np.ndarray:
    """Euclid's distance in RGB, 0 to 441."""
    d = raster[..., :3].astype(np.float64) - np.asarray(colour, np.float64)
    return np.sqrt((d * d).sum(axis=-1))


def common_colour(raster: np.ndarray) -> np.ndarray:
    """Centre of the most frequent of 16 x 16 x 16 colour bins, of equal ones the lowest."""
    bins = (raster[..., :3] >> 4).astype(np.int64) @ np.array([256, 16, 1])
    best = int(np.bincount(bins.ravel(), minlength=4096).argmax())
    return np.array([best >> 8, (best >> 4) & 15, best & 15]) * 16 + 8


def query_coverage(raster: np.ndarray, threshold: float = 0.16, full: float = 0.2) -> np.ndarray:
    """Coverage (0..1) of the object in a query image: what differs from the common colour, closed, without the
    components that touch the border (or, if all do, the largest component). Empty: all 0."""
    far = distance(raster, common_colour(raster)) / 255
    mask = erode(dilate(far > threshold))
    label, n = labels(mask)
    if not n:
        return np.zeros(mask.shape)
    edge = set(np.unique(np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])).tolist())
    inner = [k for k in range(1, n + 1) if k not in edge] or [int(areas(label, n).argmax()) + 1]
    return np.where(np.isin(label, inner), np.minimum(1.0, far / full), 0.0)


def library_coverage(raster: np.ndarray) -> np.ndarray:
    """Coverage of a library image: its alpha, where that is above 4."""
    alpha = raster[..., 3]
    return np.where(alpha > 4, alpha / 255, 0.0)


def premultiplied(raster: np.ndarray) -> np.ndarray:
    out = raster.astype(np.int64)
    out[..., :3] = out[..., :3] * out[..., 3:] // 255
    return out.astype(np.uint8)


def luminance(raster: np.ndarray) -> np.ndarray:
    y = raster[..., :3].astype(np.float64) @ np.array([0.299, 0.587, 0.114])
    return np.where(raster[..., 3] == 0, 255.0, y) if raster.shape[-1] == 4 else y


def _border(raster: np.ndarray) -> np.ndarray:
    return np.concatenate([raster[0], raster[-1], raster[1:-1, 0], raster[1:-1, -1]])


def border_colour(raster: np.ndarray, bits: int = 4) -> tuple[np.ndarray, float]:
    """(colour, share) of the most frequent border colour, by its upper ``bits``; transparent counts as white. Of equally
    frequent bins the lowest; the colour is the last of its bin along the border."""
    edge = _border(raster)
    rgb = np.where(edge[:, 3:] == 0, 255, edge[:, :3]) if raster.shape[-1] == 4 else edge[:, :3]
    bins = (rgb.astype(np.int64) >> (8 - bits)) @ np.array([1 << (2 * bits), 1 << bits, 1])
    counts = np.bincount(bins)
    best = int(counts.argmax())
    return rgb[np.flatnonzero(bins == best)[-1]].astype(np.int64), float(counts[best] / len(bins))


def border_tolerance(raster: np.ndarray, colour) -> float:
    """From the spread along the border: 1.5 times its 90th percentile and 4, from 6 to 48."""
    edge = _border(raster)
    d = np.sort(distance(edge[edge[:, 3] > 0] if raster.shape[-1] == 4 and (edge[:, 3] > 0).any() else edge, colour))
    return float(np.clip(1.5 * d[(len(d) - 1) * 9 // 10] + 4, 6, 48))


def foreground(raster: np.ndarray) -> np.ndarray:
    """The object's mask: by alpha if over a twentieth is transparent, else all that a flood from the border doesn't
    reach; without specks and without rows of text beside the main band."""
    h, w = raster.shape[:2]
    clear = raster[..., 3] == 0
    if clear.sum() > h * w / 20:
        mask = ~clear
    else:
        colour, _ = border_colour(raster)
        mask = ~flooded((distance(raster, colour) <= border_tolerance(raster, colour)) | clear)
        mask = erode(dilate(mask), steps=FOUR)
    return heaviest_band(without_small(mask, max(6, int(0.0008 * h * w))))
