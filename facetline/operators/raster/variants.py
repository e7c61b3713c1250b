"""Variants of a query image: grey, median, binary, skeleton, and the normalised crop."""

from __future__ import annotations

import numpy as np

from . import masks


def grey(raster: np.ndarray) -> np.ndarray:
    """8-bit luma with the usual integer weights."""
    r, g, b = (raster[..., k].astype(np.int64) * 257 for k in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + (1 << 15)) >> 24).astype(np.uint8)


def median(image: np.ndarray, side: int = 3) -> np.ndarray:
    """Upper median of a window that is cut off at the edges."""
    reach, (h, w) = side // 2, image.shape
    padded = np.pad(image.astype(np.int64), reach, constant_values=1 << 20)  # what is outside sorts last
    near = np.sort(np.stack([padded[dy : dy + h, dx : dx + w] for dy in range(side) for dx in range(side)]), axis=0)
    n = (near < 1 << 20).sum(axis=0)
    return np.take_along_axis(near, (n // 2)[None], axis=0)[0].astype(np.uint8)


def otsu(image: np.ndarray) -> int:
    """The threshold of most variance between the classes below it and from it on; of equal ones the last."""
    n = np.bincount(image.ravel(), minlength=256).astype(np.float64)
    below, mass = np.concatenate([[0], np.cumsum(n)[:-1]]), np.concatenate([[0], np.cumsum(n * np.arange(256))[:-1]])
    above, rest = n.sum() - below, (n * np.arange(256)).sum() - mass
    both = (below > 0) & (above > 0)
    if not both.any():
        return 0
    apart = np.divide(mass, below, where=both, out=np.zeros(256)) - np.divide(rest, above, where=both, out=np.zeros(256))
    between = np.where(both, below * above * apart * apart, -1.0)
    return int(np.flatnonzero(between >= between.max())[-1])


def binary(image: np.ndarray, invert: bool = False) -> np.ndarray:
    t = otsu(image)
    return np.where(image > t, 0, 255).astype(np.uint8) if invert else np.where(image < t, 0, 255).astype(np.uint8)


def structure(raster: np.ndarray) -> np.ndarray:
    return binary(grey(raster))


def thinned(mask: np.ndarray) -> np.ndarray:
    """Zhang and Suen's thinning (1984); it ends when either half of a round removes nothing."""
    mask = mask.copy()
    ring = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))
    inner = np.zeros_like(mask)
    inner[1:-1, 1:-1] = True
    while True:
        removed = []
        for corners in (((0, 2, 4), (2, 4, 6)), ((0, 2, 6), (0, 4, 6))):
            near = masks._shifted(mask, ring)
            number, turns = near.sum(axis=0), (~near & np.roll(near, -1, axis=0)).sum(axis=0)
            gone = mask & inner & (number >= 2) & (number <= 6) & (turns == 1)
            for triple in corners:
                gone &= ~near[list(triple)].all(axis=0)
            mask &= ~gone
            removed.append(bool(gone.any()))
        if not all(removed):
            return mask


def skeleton(raster: np.ndarray, blur: bool = True, invert: bool = False) -> np.ndarray:
    """0 on the skeleton of what the binary image has at 255, 255 elsewhere."""
    image = grey(raster)
    return np.where(thinned(binary(median(image) if blur else image, invert) != 0), 0, 255).astype(np.uint8)


def query_variants(raster: np.ndarray, **options) -> list[np.ndarray]:
    return [raster, skeleton(raster, **options)]


def normalised(raster: np.ndarray) -> np.ndarray | None:
    """For an image on a flat border that isn't white: background made white, the main band of content cropped with a
    margin; None where that doesn't apply."""
    colour, share = masks.border_colour(raster, bits=5)
    if share < 0.5 or masks.luminance(np.append(colour, 255)[None, None].astype(np.uint8))[0, 0] >= 240:
        return None
    back = masks.flooded((masks.distance(raster, colour) <= 30) & (raster[..., 3] >= 128))
    white = np.where(back[..., None], np.uint8(255), raster)
    dark = masks.luminance(white) < 245
    band = masks.main_band(masks.content_bands(dark))
    if band is None:
        return None
    dark[: band[0]] = dark[band[1] :] = False
    x0, y0, x1, y1 = masks.box(dark)
    margin = max(6, int(0.08 * max(x1 - x0, y1 - y0)))
    out = np.full((y1 - y0 + 2 * margin, x1 - x0 + 2 * margin, 4), 255, np.uint8)
    out[margin:-margin, margin:-margin] = white[y0:y1, x0:x1]
    return out
