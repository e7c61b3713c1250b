"""Descriptors of one object.

``features`` describes coverage and colour (histogram, rings, sectors, moments, soft mask); ``shape`` ignores colour
(grids, patches, contour, gradients, regions). Both are dicts of vectors, one column each in the index.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from . import masks

# The widths that indexes and the ranking network agree on.
HUE, SATURATION, VALUE = 16, 6, 3
RINGS, SECTORS, FREQUENCIES = 16, 24, 12
GRID, ORDER = 64, 12
RAYS, FOURIER, REGION, CELL, ORIENTATIONS = 128, 32, 8, 8, 9
WIDTHS = {"hist": 288, "radial": 16, "ang_mag": 192, "polar_shape": 384, "polar_col": 1152, "zern": 49, "mask": 4096}
SHAPE_WIDTHS = {"occ64": 4096, "occ32": 1024, "occ16": 256, "patch": 4096, "occ_bbox64": 4096, "patch_bbox": 4096, "fourier": 32, "rad": 16, "hog": 1764}


def unit(v: np.ndarray) -> np.ndarray:
    n = math.sqrt(float((v * v).sum()))
    return v / n if n > 0 else v


def share(v: np.ndarray) -> np.ndarray:
    s = float(v.sum())
    return v / s if s > 0 else v


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation, value of (..., 3) 8-bit colours."""
    c = rgb.astype(np.float64) / 255
    top, span = c.max(axis=-1), c.max(axis=-1) - c.min(axis=-1)
    r, g, b = c[..., 0], c[..., 1], c[..., 2]
    safe = np.where(span > 0, span, 1.0)
    h = np.where(top == r, (g - b) / safe, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    h = np.where(span > 0, np.where(h < 0, h + 360, h), 0.0)
    return h, np.where(top > 0, span / np.where(top > 0, top, 1.0), 0.0), top


def _bin(x: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum((x * bins).astype(np.int64), bins - 1)


@lru_cache
def zernike_terms() -> tuple[tuple[int, tuple[tuple[float, int], ...]], ...]:
    """(m, ((coefficient, power of r), ...)) for n = 0..12 and even m up to n; factorials of halves are rounded down, and
    those below 0 are 1."""
    f = lambda k: float(math.factorial(max(0, k)))
    out = []
    for n in range(ORDER + 1):
        for m in range(0, n + 1, 2):
            out.append((m, tuple(((-1) ** s * f(n - s) / (f(s) * f((n + m) // 2 - s) * f((n - m) // 2 - s)), n - 2 * s) for s in range((n - m) // 2 + 1))))
    return tuple(out)


def features(raster: np.ndarray, coverage: np.ndarray) -> dict | None:
    """None if nothing is covered; a single point has zero vectors."""
    ys, xs = np.nonzero(coverage > 0)
    if not len(ys):
        return None
    out = {name: np.zeros(width) for name, width in WIDTHS.items()}
    out |= {"n": len(ys), "mono": False, "box": (int(xs.min()), int(ys.min()), int(xs.max()), int(ys.max()))}
    dx, dy = xs - xs.mean(), ys - ys.mean()
    r, t = np.hypot(dx, dy), np.arctan2(dy, dx)
    rms = out["rms"] = math.sqrt(float((r * r).mean()))
    if rms <= 0:
        return out
    rgb = raster[ys, xs, :3]
    h, s, v = hsv(rgb)
    out["hist"] = share(np.bincount((_bin(h / 360, HUE) * SATURATION + _bin(s, SATURATION)) * VALUE + _bin(v, VALUE), minlength=WIDTHS["hist"]).astype(float))
    out["mono"] = bool(((s > 0.22) & (v > 0.15)).sum() < 0.05 * len(ys))

    ring, sector = _bin(r / rms, RINGS), _bin((np.degrees(t) + 180) / 360, SECTORS)
    cell = ring * SECTORS + sector
    count = np.bincount(cell, minlength=RINGS * SECTORS).astype(float)
    out["radial"] = share(np.bincount(ring, minlength=RINGS).astype(float))
    polar = np.stack([share(row) for row in count.reshape(RINGS, SECTORS)])
    out["polar_shape"] = polar.ravel()
    mean = np.stack([np.bincount(cell, rgb[:, k] / 255, RINGS * SECTORS) for k in range(3)], axis=1)
    out["polar_col"] = np.divide(mean, count[:, None], out=np.zeros_like(mean), where=count[:, None] > 0).ravel()
    waves = np.abs(np.fft.fft(polar, axis=1))[:, 1 : FREQUENCIES + 1]
    out["ang_mag"] = share(np.concatenate([share(w) for w in waves]))

    near = r / r.max()
    powers = near[None] ** np.arange(ORDER + 1)[:, None]
    turned = {m: np.exp(1j * m * t) for m in range(0, ORDER + 1, 2)}
    out["zern"] = unit(np.array([abs((sum(c * powers[e] for c, e in terms) * turned[m]).sum()) for m, terms in zernike_terms()]))

    scale = 0.45 * (GRID // 2) / max(float(np.sort(r)[int(0.98 * len(r))]), 1e-300)
    if np.isfinite(scale) and scale < 1e300:
        # toward zero, so the middle cells are two wide
        x, y = (np.trunc(d * scale).astype(np.int64) + GRID // 2 for d in (dx, dy))
        inside = (x >= 0) & (x < GRID) & (y >= 0) & (y < GRID)
        grid = np.zeros((GRID, GRID))
        np.maximum.at(grid, (y[inside], x[inside]), coverage[ys, xs][inside])
        out["mask"] = grid.ravel()
    return out


# -- colour-agnostic ----------------------------------------------------------------------------------------------------


def area_grid(mask: np.ndarray, x0: float, y0: float, side_x: float, side_y: float, n: int) -> np.ndarray:
    """n x n shares of a rectangle's cells that the mask covers; outside of the image is empty. From an integral image,
    read between its points."""
    table = np.zeros((mask.shape[0] + 1, mask.shape[1] + 1))
    table[1:, 1:] = mask.cumsum(axis=0).cumsum(axis=1)

    def edges(start: float, side: float, most: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.clip(start + np.arange(n + 1) * side / n, 0, most)
        low = np.minimum(at.astype(np.int64), most - 1)
        return low, at - low

    (xi, xf), (yi, yf) = edges(x0, side_x, mask.shape[1]), edges(y0, side_y, mask.shape[0])
    across = table[:, xi] * (1 - xf) + table[:, xi + 1] * xf
    both = across[yi] * (1 - yf)[:, None] + across[yi + 1] * yf[:, None]
    return np.diff(np.diff(both, axis=0), axis=1) / max(side_x * side_y / (n * n), 1e-12)


def sampled(image: np.ndarray, x: np.ndarray, y: np.ndarray, clamp: bool = False) -> np.ndarray:
    """Bilinear samples; outside is 0, or the nearest edge."""
    h, w = image.shape
    if clamp:
        x, y = np.clip(x, 0, w - 1), np.clip(y, 0, h - 1)
    x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
    fx, fy = x - x0, y - y0
    edge = np.pad(image, 1)
    at = lambda i, j: edge[np.clip(j + 1, 0, h + 1), np.clip(i + 1, 0, w + 1)]
    return (at(x0, y0) * (1 - fx) + at(x0 + 1, y0) * fx) * (1 - fy) + (at(x0, y0 + 1) * (1 - fx) + at(x0 + 1, y0 + 1) * fx) * fy


def grey_grid(image: np.ndarray, x0: float, y0: float, side: float, n: int) -> np.ndarray:
    centre = (np.arange(n) + 0.5) * side / n - 0.5
    x, y = np.meshgrid(x0 + centre, y0 + centre)
    return sampled(image, x, y)


def resized(image: np.ndarray, n: int) -> np.ndarray:
    """Corner to corner."""
    x, y = np.meshgrid(np.linspace(0, image.shape[1] - 1, n), np.linspace(0, image.shape[0] - 1, n))
    return sampled(image, x, y, clamp=True)


def blocks(grid: np.ndarray, n: int) -> np.ndarray:
    """n x n block means; zeros if the grid isn't larger."""
    side = grid.shape[0]
    if n >= side:
        return np.zeros((n, n))
    step = side // n
    return grid[: n * step, : n * step].reshape(n, step, n, step).mean(axis=(1, 3))


def patch(grid: np.ndarray) -> np.ndarray:
    v = grid.ravel()
    return unit(v - v.mean())


def boundary(mask: np.ndarray, frame: tuple[float, float, float], rays: int = RAYS) -> tuple[np.ndarray, np.ndarray]:
    """(points in the unit frame, radii): the farthest covered point along each ray from the centre, in half steps, as
    long as the ray is inside of the image."""
    cx, cy, side = frame
    h, w = mask.shape
    t = 0.5 * np.arange(int(max(h, w) * 3 / 0.5) + 1)
    angle = 2 * np.pi * np.arange(rays) / rays
    x, y = cx + np.outer(np.cos(angle), t), cy + np.outer(np.sin(angle), t)
    xi, yi = np.floor(x + 0.5).astype(np.int64), np.floor(y + 0.5).astype(np.int64)
    inside = np.logical_and.accumulate((xi >= 0) & (xi < w) & (yi >= 0) & (yi < h), axis=1)
    hit = inside & mask[np.clip(yi, 0, h - 1), np.clip(xi, 0, w - 1)]
    last = np.where(hit.any(axis=1), hit.shape[1] - 1 - hit[:, ::-1].argmax(axis=1), 0)
    rows = np.arange(rays)
    points = np.stack([0.5 + (x[rows, last] - cx) / side, 0.5 + (y[rows, last] - cy) / side], axis=1)
    return points, t[last] / (side / 2)


def fourier(points: np.ndarray) -> np.ndarray:
    f = np.abs(np.fft.fft(points[:, 0] + 1j * points[:, 1]))
    return f[1 : FOURIER + 1] / f[1] if f[1] > 1e-12 else np.zeros(FOURIER)


def log_polar(points: np.ndarray, radial: int, angular: int, low: float, high: float, strict: bool) -> np.ndarray:
    """For each point the share of the others in log-polar bins around it, (points, radial, angular). ``strict`` leaves
    out those nearer or farther; otherwise they go to the first or last bin."""
    n = len(points)
    d = points[None] - points[:, None]
    r, t = np.hypot(d[..., 0], d[..., 1]), np.mod(np.arctan2(d[..., 1], d[..., 0]), 2 * np.pi)
    use = ~np.eye(n, dtype=bool) & ((r >= low) & (r <= high) if strict else True)
    level = np.log(np.maximum(r, 1e-300) / low) / np.log(high / low)
    ring = np.clip((level * radial).astype(np.int64), 0, radial - 1)
    at = (np.arange(n)[:, None] * radial + ring) * angular + np.minimum((t / (2 * np.pi) * angular).astype(np.int64), angular - 1)
    out = np.bincount(at[use], minlength=n * radial * angular).reshape(n, -1).astype(float)
    total = out.sum(axis=1, keepdims=True)
    return np.divide(out, total, out=out, where=total > 0).reshape(n, radial, angular)


def hog(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Gradients inside the mask: 9 unsigned orientations, shared between the two nearest, in 8 x 8 cells; 2 x 2 blocks,
    clipped at 0.2."""
    n = len(image)
    p = np.pad(image, 1, mode="edge")
    v = lambda dy, dx: p[1 + dy : 1 + dy + n, 1 + dx : 1 + dx + n]
    gx = (v(-1, 1) - v(-1, -1)) + 2 * (v(0, 1) - v(0, -1)) + (v(1, 1) - v(1, -1))
    gy = (v(1, -1) - v(-1, -1)) + 2 * (v(1, 0) - v(-1, 0)) + (v(1, 1) - v(-1, 1))
    live = mask.copy()
    live[[0, -1]] = live[:, [0, -1]] = False
    size = np.where(live, np.hypot(gx, gy), 0.0)
    angle = np.arctan2(gy, gx)
    place = np.minimum(np.where(angle < 0, angle + np.pi, angle) / np.pi * ORIENTATIONS, ORIENTATIONS - 1e-6)
    low = place.astype(np.int64)
    part, cells = place - low, n // CELL
    cell = (np.arange(n)[:, None] // CELL) * cells + np.arange(n)[None] // CELL
    count = sum(np.bincount((cell * ORIENTATIONS + b).ravel(), (size * w).ravel(), cells * cells * ORIENTATIONS) for b, w in ((low, 1 - part), ((low + 1) % ORIENTATIONS, part)))
    count = count.reshape(cells, cells, ORIENTATIONS)
    joined = np.concatenate([count[:-1, :-1], count[:-1, 1:], count[1:, :-1], count[1:, 1:]], axis=-1)
    return unit(np.concatenate([unit(np.minimum(unit(b), 0.2)) for b in joined.reshape(-1, 4 * ORIENTATIONS)]))


@lru_cache
def uniform_codes() -> np.ndarray:
    """Bin of each 8-bit ring code: those with at most two changes in order, all others in the last."""
    code = np.arange(256)
    changes = np.bitwise_count(code ^ ((code >> 7) | ((code << 1) & 255)))
    return np.where(changes <= 2, np.cumsum(changes <= 2) - 1, (changes <= 2).sum())


def lbp(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Local binary patterns where the whole 3 x 3 neighbourhood is in the mask: 59 shares."""
    whole = masks.erode(mask)
    n = image.shape
    p, code = np.pad(image, 1), np.zeros(n, np.int64)
    for k, (dy, dx) in enumerate(((-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1))):
        code |= (p[1 + dy : 1 + dy + n[0], 1 + dx : 1 + dx + n[1]] >= image).astype(np.int64) << k
    return share(np.bincount(uniform_codes()[code[whole]], minlength=59).astype(float))


def filled(soft: np.ndarray) -> np.ndarray:
    """Holes of the grid (cells up to 0.5 that no way leads to from outside) set to 1."""
    solid = soft > 0.5
    outside = masks.flooded(np.pad(~solid, 1, constant_values=True))[1:-1, 1:-1]
    return np.where(solid | outside, soft, 1.0)


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, by the monotone chain."""
    ordered = sorted({(float(x), float(y)) for x, y in points})
    if len(ordered) < 3:
        return np.array(ordered)

    def half(seq) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(ordered) + half(reversed(ordered)))


def polygon_area(points: np.ndarray) -> float:
    if len(points) < 3:
        return 0.0
    x, y = points[:, 0], points[:, 1]
    return abs(float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum())) / 2


def solidity(soft: np.ndarray) -> float:
    """Covered cells over the area of their convex hull, 1 at most."""
    on = soft > 0.1
    rows = np.flatnonzero(on.any(axis=1))
    if not len(rows):
        return 0.0
    # corners of the first and last cell of each row; all others are between them
    ends = np.concatenate([on[rows].argmax(axis=1), on.shape[1] - on[rows, ::-1].argmax(axis=1)])
    corners = np.concatenate([np.stack([ends, np.tile(rows, 2) + b], axis=1) for b in (0, 1)])
    area = polygon_area(hull(corners))
    return min(1.0, int(on.sum()) / area) if area > 0 else 0.0


def regions(mask: np.ndarray, frame: tuple[float, float, float]) -> list[dict]:
    """Components of at least 8% of the largest (6 cells): grid, area, place in the frame, fill and aspect of the box."""
    label, n = masks.labels(mask, masks.FOUR)
    if not n:
        return []
    sizes = masks.areas(label, n)
    least, out = max(6, int(0.08 * sizes.max())), []
    keep = np.flatnonzero(sizes >= least) if (sizes >= least).any() else np.array([0])
    for k in keep:
        own = label == k + 1
        x0, y0, x1, y1 = masks.box(own)
        ys, xs = np.nonzero(own)
        grid = area_grid(own, x0, y0, x1 - x0, y1 - y0, REGION)
        out.append({
            "occ": unit(grid.ravel()), "area": int(sizes[k]), "nx": 0.5 + (float(xs.mean()) - frame[0]) / frame[2], "ny": 0.5 + (float(ys.mean()) - frame[1]) / frame[2],
            "fill": float(sizes[k]) / ((x1 - x0) * (y1 - y0)), "aspect": (x1 - x0) / (y1 - y0),
        })
    return out


def shape(raster: np.ndarray, extra: bool = True) -> dict | None:
    """The colour-agnostic descriptor; None without a foreground. ``extra`` adds what search doesn't read."""
    flat = masks.premultiplied(raster)
    mask = masks.foreground(flat)
    frame = masks.frame(mask)
    if frame is None:
        return None
    light = masks.luminance(flat)
    cx, cy, side = frame
    x0, y0, x1, y1 = masks.box(mask)
    square = max(x1 - x0, y1 - y0)
    bx, by = (x0 + x1 - square) / 2, (y0 + y1 - square) / 2
    soft = filled(area_grid(mask, cx - side / 2, cy - side / 2, side, side, GRID))
    grey = grey_grid(light, cx - side / 2, cy - side / 2, side, GRID)
    points, radii = boundary(mask, frame)
    out = {
        "occ64": unit(soft.ravel()), "patch": patch(grey), "occ_bbox64": unit(area_grid(mask, bx, by, square, square, GRID).ravel()), "patch_bbox": patch(grey_grid(light, bx, by, square, GRID)),
        "fourier": fourier(points), "rad": share(np.bincount(_bin(np.clip(radii, 0, 1), 16), minlength=16).astype(float)), "regions": regions(mask, frame),
        "solidity": solidity(soft), "area": int(mask.sum()), "box": (x0, y0, x1, y1),
    }
    if extra:
        out |= {"occ32": unit(blocks(soft, 32).ravel()), "occ16": unit(blocks(soft, 16).ravel()), "hog": hog(grey, soft >= 0.5), "points": points, "context": log_polar(points, 5, 12, 0.1, 2.0, False).reshape(len(points), -1)}
    return out
