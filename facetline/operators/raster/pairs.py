"""Similarities of two descriptors that sweep rotations or match parts one to one."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .descriptors import GRID, RAYS, RINGS, SECTORS, log_polar, unit


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    n = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float(a @ b) / n if len(a) == len(b) and n > 0 else 0.0


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.minimum(a, b).sum()) if len(a) == len(b) else 0.0


def ring_cosines(q: np.ndarray, r: np.ndarray, channels: int = 1) -> np.ndarray:
    """(shifts, rings): cosines of each ring at every circular shift of r; nan where a side is empty."""
    q, r = (v.reshape(RINGS, SECTORS, channels) for v in (q, r))
    rolled = np.stack([np.roll(r, k, axis=1) for k in range(SECTORS)])
    dots = (q[None] * rolled).sum(axis=(2, 3))
    lengths = np.sqrt((q * q).sum(axis=(1, 2)) * (r * r).sum(axis=(1, 2)))
    return np.divide(dots, lengths[None], out=np.full_like(dots, np.nan), where=lengths[None] > 0)


def polar_similarity(q: np.ndarray, r: np.ndarray, channels: int = 1) -> float:
    """Mean over rings that both have, at the best common shift; 0 at least."""
    at = ring_cosines(q, r, channels)
    live = ~np.isnan(at[0])
    return max(0.0, float(at[:, live].mean(axis=1).max())) if live.any() else 0.0


def polar_detail(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The rings' cosines at the best common shift, 0 for empty rings."""
    at = ring_cosines(q, r)
    live = ~np.isnan(at[0])
    if not live.any():
        return np.zeros(RINGS)
    return np.nan_to_num(at[int(at[:, live].mean(axis=1).argmax())])


def turned_mask(mask: np.ndarray, degrees: float) -> np.ndarray:
    """A square grid turned about its middle; outside is 0. Places are cut toward zero, so just outside of the first row
    or column values are extrapolated."""
    n = mask.shape[0]
    c, t = 0.5 * (n - 1), np.radians(degrees)
    x, y = np.meshgrid(np.arange(n) - c, np.arange(n) - c)
    sx, sy = x * np.cos(t) + y * np.sin(t) + c, -x * np.sin(t) + y * np.cos(t) + c
    x0, y0 = np.trunc(sx).astype(np.int64), np.trunc(sy).astype(np.int64)
    out = (x0 < 0) | (y0 < 0) | (x0 >= n - 1) | (y0 >= n - 1)
    x0, y0 = np.where(out, 0, x0), np.where(out, 0, y0)
    fx, fy = sx - x0, sy - y0
    v = (mask[y0, x0] * (1 - fx) + mask[y0, x0 + 1] * fx) * (1 - fy) + (mask[y0 + 1, x0] * (1 - fx) + mask[y0 + 1, x0 + 1] * fx) * fy
    return np.where(out, 0.0, v)


def mask_turns(mask: np.ndarray, step: int = 4) -> np.ndarray:
    """(turns, cells) of a query's mask, made once for all references."""
    n = int(round(len(mask) ** 0.5))
    return np.stack([turned_mask(mask.reshape(n, n), d).ravel() for d in range(0, 360, step)])


def mask_scores(turns: np.ndarray, total: float, refs: np.ndarray, enough: float = 0.99) -> np.ndarray:
    """Dice overlap of each reference at the query's best turn; the first turn above ``enough`` ends the sweep."""
    out = np.zeros(len(refs))
    if total <= 1e-9:
        return out
    sums = refs.sum(axis=1)
    live = sums > 1e-9
    for turn in turns:
        if not live.any():
            break
        at = slice(None) if live.all() else np.flatnonzero(live)
        out[at] = np.maximum(out[at], 2 * np.minimum(turn[None], refs[at]).sum(axis=1) / (total + sums[at]))
        live[at] = out[at] <= enough
    return out


@lru_cache
def _turned_places(n: int, steps: int) -> tuple[np.ndarray, ...]:
    """Of each turn and cell of a grid: the four cells around its place, and how far it lies behind the first in x and y."""
    c, out = 0.5 * (n - 1), []
    x, y = np.meshgrid(np.arange(n) - c, np.arange(n) - c)
    for k in range(steps):
        t = 2 * np.pi * k / steps
        sx, sy = (np.clip(v, 0, n - 1).ravel() for v in (x * np.cos(t) + y * np.sin(t) + c, -x * np.sin(t) + y * np.cos(t) + c))
        x0, y0 = np.floor(sx).astype(np.int32), np.floor(sy).astype(np.int32)
        x1, y1 = np.minimum(x0 + 1, n - 1), np.minimum(y0 + 1, n - 1)  # beyond the edge nothing is taken
        out.append((y0 * n + x0, y0 * n + x1, y1 * n + x0, y1 * n + x1, sx - x0, sy - y0))
    return tuple(np.stack(v) for v in zip(*out, strict=True))


def grid_turns(grid: np.ndarray, steps: int = 36, centre: bool = False) -> np.ndarray:
    """(steps, cells): a grid turned with its edges held, at unit length (and centred, for patches)."""
    a, b, c, d, fx, fy = _turned_places(int(round(len(grid) ** 0.5)), steps)
    turned = (grid[a] * (1 - fx) + grid[b] * fx) * (1 - fy) + (grid[c] * (1 - fx) + grid[d] * fx) * fy
    return np.stack([unit(v - v.mean()) if centre else unit(v) for v in turned])


def best_dot(turns: np.ndarray, grid: np.ndarray) -> float:
    return max(0.0, float((turns @ grid).max())) if turns.shape[1] == len(grid) else 0.0


def assignment(cost: np.ndarray, reduced: bool = False) -> np.ndarray:
    """Column of each row (-1: none) in the one-to-one matching of least cost: shortest augmenting paths with potentials
    (Jonker and Volgenant, 1987), a row at a time over whole columns. ``reduced`` begins a square matrix with rows and
    columns less their least, which is faster; of matchings that cost the same it may give another."""
    if not cost.size:
        return np.full(cost.shape[0], -1)
    if cost.shape[0] > cost.shape[1]:
        back = assignment(cost.T)
        out = np.full(cost.shape[0], -1)
        out[back] = np.arange(len(back))
        return out
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of, out = np.full(m, -1), np.full(n, -1)
    if reduced and n == m:
        u = cost.min(axis=1)
        less = cost - u[:, None]
        v = less.min(axis=0)
        rows, columns = np.unique(less.argmin(axis=0), return_index=True)
        out[rows], row_of[columns] = columns, rows
    for start in np.flatnonzero(out < 0).tolist():
        least, came, open_v = np.full(m, np.inf), np.full(m, -1), v.copy()
        row, seen, reach = start, [], 0.0
        while True:
            through = reach + cost[row]
            through -= u[row]
            through -= open_v  # infinite for columns that are done
            came[through < least] = row
            np.minimum(least, through, out=least)
            column = int(least.argmin())
            reach = float(least[column])
            if row_of[column] < 0:
                break
            least[column], open_v[column] = np.inf, -np.inf
            seen.append((column, reach))
            row = int(row_of[column])
        u[start] += reach
        for c, at in seen:
            u[row_of[c]] += reach - at
            v[c] -= reach - at
        while True:
            row = came[column]
            row_of[column], out[row], column = row, column, out[row]
            if row == start:
                break
    return out


def least_costs(costs: np.ndarray) -> np.ndarray:
    """Cost of the best one-to-one matching of each of (problems, n, n) matrices: ``assignment`` with reduced rows and
    columns, a step of all problems at a time. Those whose path has reached a free column wait until most have."""
    size, n = costs.shape[:2]
    total, every = np.zeros(size), np.arange(size)
    u = np.zeros((size, n + 1))  # the last is of no row
    u[:, :n] = costs.min(axis=2)
    less = costs - u[:, :n, None]
    v, nearest = less.min(axis=1), less.argmin(axis=1)
    out, row_of = np.full((size, n), -1), np.full((size, n), -1)
    for c in range(n - 1, -1, -1):
        out[every, nearest[:, c]] = c
    b, r = np.nonzero(out >= 0)
    row_of[b, out[b, r]] = r
    own, free = every, out < 0

    def begin(at: np.ndarray) -> None:
        start[at] = row[at] = free[at].argmax(axis=1)
        free[at, start[at]] = False
        least[at], open_v[at], passed[at], reach[at] = np.inf, v[at], np.inf, 0.0

    keep = free.any(axis=1)
    for k in np.flatnonzero(~keep):
        total[k] = costs[k, np.arange(n), out[k]].sum()
    own, free, u, v, out, row_of = (x[keep] for x in (own, free, u, v, out, row_of))
    least, open_v, passed = (np.empty((len(own), n)) for _ in range(3))
    came, row, start, reach = np.zeros((len(own), n), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), np.zeros(len(own))
    begin(np.arange(len(own)))
    waits = np.zeros(len(own), bool)
    while len(own):
        every = np.arange(len(own))
        through = costs[own, row]
        through += np.where(waits, np.inf, reach - u[every, row])[:, None]
        through -= open_v  # infinite for columns that are done
        np.copyto(came, row[:, None], where=through < least)
        np.minimum(least, through, out=least)
        column = least.argmin(axis=1)
        reach = least[every, column]
        after = row_of[every, column]
        waits = after < 0
        go = np.flatnonzero(~waits)
        at = column[go]
        least[go, at], open_v[go, at], passed[go, at] = np.inf, -np.inf, reach[go]
        row[go] = after[go]
        if 2 * len(go) > len(own):
            continue
        ends = np.flatnonzero(waits)
        beyond = np.maximum(0.0, reach[ends, None] - passed[ends])  # 0 for columns that no path has passed
        v[ends] -= beyond
        u[ends[:, None], row_of[ends]] += beyond
        u[ends, start[ends]] += reach[ends]
        b, c = ends, column[ends]
        while len(b):
            r = came[b, c]
            before = out[b, r]
            row_of[b, c], out[b, r] = r, c
            more = r != start[b]
            b, c = b[more], before[more]
        live = free[ends].any(axis=1)
        begin(ends[live])
        waits[ends[live]] = False
        if not live.all():
            for k in ends[~live]:
                total[own[k]] = costs[own[k], np.arange(n), out[k]].sum()
            keep = np.ones(len(own), bool)
            keep[ends[~live]] = False
            own, free, u, v, out, row_of, least, came, open_v, passed, row, start, reach, waits = (x[keep] for x in (own, free, u, v, out, row_of, least, came, open_v, passed, row, start, reach, waits))
    return total


def chi_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(rows of a, rows of b). Half of (x-y)^2/(x+y) is x/2 - 3y/2 + 2y^2/(x+y), and the last is 0 where y is, which is so
    for most bins: each row of b is summed over the bins that it has."""
    out = np.empty((len(b), len(a)))
    bins_of = np.ascontiguousarray(a.T)
    for k, row in enumerate(b):
        bins = np.flatnonzero(row)
        y = row[bins]
        sums = bins_of[bins]
        sums += y[:, None]
        out[k] = (y * y) @ np.divide(1.0, sums, out=sums)
    return np.maximum(0.0, 0.5 * a.sum(axis=1)[:, None] + (2 * out - 1.5 * b.sum(axis=1)[:, None]).T)


# -- shape context of soft masks ----------------------------------------------------------------------------------------


def context_points(mask: np.ndarray, most: int = 48) -> np.ndarray:
    """(x, y) of covered cells in grid order, evenly thinned."""
    ys, xs = np.nonzero(mask.reshape(GRID, GRID) > 0.05)
    points = np.stack([xs, ys], axis=1).astype(float)
    return points if len(points) <= most else points[(np.arange(most) * (len(points) / most)).astype(np.int64)]


def contexts(points: np.ndarray) -> np.ndarray:
    """(points, 72): 6 log-radial by 12 angular bins from 0.05 to 2.5 times the upper median distance."""
    if len(points) < 2:
        return np.zeros((0, 72))
    i, j = np.triu_indices(len(points), 1)
    d = np.sort(np.hypot(*(points[i] - points[j]).T))
    scale = d[len(d) // 2] if d[len(d) // 2] > 1e-6 else 1.0
    return log_polar(points, 6, 12, 0.05 * scale, 2.5 * scale, True).reshape(len(points), -1)


def context_turns(mask: np.ndarray, turns: int = 36) -> list[np.ndarray]:
    points, out = context_points(mask), []
    for k in range(turns):
        t = 2 * np.pi * k / turns
        out.append(contexts(points @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])))
    return out


def context_similarity(turns: list[np.ndarray], ref: np.ndarray) -> float:
    """1 less the mean cost of the best matching over all turns, from 0 to 1; points without a partner cost nothing."""
    best, todo = np.inf, []
    live = [own for own in turns if len(own)] if len(ref) else []
    costs = chi_squares(np.concatenate(live), ref) if live else None
    at = 0
    for own in live:
        cost, at = costs[at : at + len(own)], at + len(own)
        # no matching costs less than the nearest partners of the side that is matched whole
        least = [cost.min(axis=k).sum() for k, whole in ((1, cost.shape[0] <= cost.shape[1]), (0, cost.shape[0] >= cost.shape[1])) if whole]
        todo.append((max(least) / max(cost.shape), len(todo), cost))
    for bound, _, cost in sorted(todo, key=lambda x: x[:2]):
        if bound >= best:
            break
        to = assignment(cost, reduced=True)
        best = min(best, cost[np.flatnonzero(to >= 0), to[to >= 0]].sum() / max(cost.shape))
    return float(np.clip(1 - best, 0, 1)) if np.isfinite(best) else 0.0


# -- colour-agnostic score ----------------------------------------------------------------------------------------------


def region_arrays(regions) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Grids at unit length, distances from the middle and areas of an object's regions; None if it has none."""
    if regions is None or not len(regions):
        return None
    grids = np.array([x["occ"] for x in regions], float)
    lengths = np.sqrt((grids * grids).sum(axis=1, keepdims=True))
    far = np.hypot(*(np.array([x[c] for x in regions]) - 0.5 for c in ("nx", "ny")))
    return np.divide(grids, lengths, out=np.zeros_like(grids), where=lengths > 0), far, np.array([x["area"] for x in regions], float)


def region_similarity(q: tuple | None, r: tuple | None) -> float:
    """Regions (as ``region_arrays``) matched by grid and distance from the middle; the mean over matched area times the
    share of the query's area that is matched."""
    if q is None or r is None:
        return 0.0
    cost = 0.7 * (1 - q[0] @ r[0].T) + 0.3 * np.minimum(1.0, np.abs(q[1][:, None] - r[1][None]))
    to, area = assignment(cost), q[2]
    hit = to >= 0
    matched = area[hit].sum()
    close = np.maximum(0.0, 1 - cost[np.flatnonzero(hit), to[hit]])
    return float((area[hit] * close).sum() / matched * (matched / area.sum())) if matched > 0 else 0.0


def prepared(q: dict) -> dict:
    """A query's descriptor with the turns that every reference is held against."""
    return q | {"occ_turns": grid_turns(q["occ64"]), "patch_turns": grid_turns(q["patch"], centre=True), "parts": region_arrays(q["regions"])}


def grids(q: dict, r: dict) -> tuple[float, float]:
    """Of occupancy and of patches: at the best turn, or box on box."""
    occ = max(best_dot(q["occ_turns"], r["occ64"]), cosine(q["occ_bbox64"], r["occ_bbox64"]))
    return occ, max(best_dot(q["patch_turns"], r["patch"]), max(0.0, float(q["patch_bbox"] @ r["patch_bbox"])))


def expert(q: dict, r: dict) -> float:
    """Weighted sum over grids, patches, regions, contour and radii."""
    occ, near = grids(q, r)
    return 0.20 * occ + 0.20 * near + 0.20 * region_similarity(q["parts"], region_arrays(r["regions"])) + 0.25 * cosine(q["fourier"], r["fourier"]) + 0.15 * overlap(q["rad"], r["rad"])


def _cosines(q: np.ndarray, rows: np.ndarray, squares: np.ndarray) -> np.ndarray:
    lengths = np.sqrt(squares * (q @ q))
    return np.divide(rows @ q, lengths, out=np.zeros(len(rows)), where=lengths > 0)


def stacked(rows) -> dict:
    """What ``experts`` reads of a table of descriptors, made once for all queries: with sums of squares, and the regions of
    all rows behind one another."""
    out = {c: np.stack(rows[c].to_numpy()) for c in ("occ64", "occ_bbox64", "patch", "patch_bbox", "fourier", "rad")}
    out |= {f"{c}_squares": (out[c] * out[c]).sum(axis=1) for c in ("occ_bbox64", "fourier")}
    parts = [region_arrays(x) for x in rows["regions"]]
    some = np.flatnonzero([x is not None for x in parts])
    sizes = [len(parts[k][2]) for k in some]
    every = [np.concatenate([parts[k][c] for k in some]) for c in (0, 1)] if sizes else []
    return out | {"parts": parts, "some": some, "starts": np.cumsum([0, *sizes])[:-1], "every": every}


def region_bounds(q: tuple | None, r: dict) -> np.ndarray:
    """What ``region_similarity`` of each of ``stacked`` rows doesn't exceed: each region of the query with the one that is
    closest to it, though several may have the same."""
    out = np.zeros(len(r["parts"]))
    if q is None or not len(r["some"]):
        return out
    grids, far = r["every"]
    close = np.maximum(0.0, 1 - (0.7 * (1 - q[0] @ grids.T) + 0.3 * np.minimum(1.0, np.abs(q[1][:, None] - far[None]))))
    out[r["some"]] = q[2] @ np.maximum.reduceat(close, r["starts"], axis=1) / max(q[2].sum(), 1e-300) + 1e-9
    return out


def experts(q: dict, r: dict, least: float = -np.inf) -> np.ndarray:
    """``expert`` of a prepared query and each of ``stacked`` rows, but for the regions all rows at once. Rows that don't reach
    ``least`` however well their regions match have minus infinity."""
    occ = np.maximum(np.maximum(0.0, (q["occ_turns"] @ r["occ64"].T).max(axis=0)), _cosines(q["occ_bbox64"], r["occ_bbox64"], r["occ_bbox64_squares"]))
    near = np.maximum(np.maximum(0.0, (q["patch_turns"] @ r["patch"].T).max(axis=0)), np.maximum(0.0, r["patch_bbox"] @ q["patch_bbox"]))
    contour = _cosines(q["fourier"], r["fourier"], r["fourier_squares"])
    radii = np.minimum(r["rad"], q["rad"]).sum(axis=1)
    score = lambda at, regions: 0.20 * occ[at] + 0.20 * near[at] + 0.20 * regions + 0.25 * contour[at] + 0.15 * radii[at]
    out = np.full(len(occ), -np.inf)
    live = np.arange(len(occ)) if least == -np.inf else np.flatnonzero(~(score(slice(None), region_bounds(q["parts"], r)) < least))
    out[live] = score(live, np.array([region_similarity(q["parts"], r["parts"][k]) for k in live]))
    return out


def grid_similarity(q: dict, r: dict) -> float:
    return 0.25 * cosine(q["occ64"], r["occ64"]) + 0.35 * cosine(q["occ32"], r["occ32"]) + 0.40 * cosine(q["occ16"], r["occ16"])


def hog_shifts(q: np.ndarray, r: np.ndarray, bins: int = 9) -> float:
    return max(cosine(q, np.roll(r.reshape(-1, bins), k, axis=1).ravel()) for k in range(bins))


def _thinned(contexts: np.ndarray, most: int = 48) -> np.ndarray:
    n = min(most, len(contexts))
    return contexts[(np.arange(n) * (len(contexts) / max(n, 1))).astype(np.int64)]


def contour_turns(points: np.ndarray, turns: int = 36) -> np.ndarray:
    """(turns, thinned points, bins): shape contexts of a query's contour at each turn, made once for all references."""
    out = []
    for k in range(turns):
        t = 2 * np.pi * k / turns
        turned = (points - 0.5) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + 0.5
        out.append(_thinned(log_polar(turned, 5, 12, 0.1, 2.0, False).reshape(len(points), -1)))
    return np.stack(out)


def contour_similarity(q: dict, r: dict) -> float:
    """Shape contexts of the contours, matched at the best of all turns; 0 for shapes that are far from convex."""
    if min(q["solidity"], r["solidity"]) < 0.4 or len(q["points"]) < 2 or not len(r["context"]):
        return 0.0
    turns, ref = q["contour_turns"] if "contour_turns" in q else contour_turns(q["points"]), _thinned(r["context"])
    costs = chi_squares(turns.reshape(-1, turns.shape[-1]), ref).reshape(*turns.shape[:2], -1)
    if costs.shape[1] > costs.shape[2]:
        costs = costs.transpose(0, 2, 1)
    # no matching costs less than the nearest partners of the side that is matched whole and, if both are, what the
    # other side's nearest cost beyond those
    nearest = costs.min(axis=2)
    bounds = nearest.sum(axis=1)
    if costs.shape[1] == costs.shape[2]:
        bounds = bounds + (costs - nearest[..., None]).min(axis=1).sum(axis=1)
    best = float(costs.shape[1])  # where the similarity is 0
    for k in np.argsort(bounds, kind="stable"):
        if bounds[k] >= best:
            break
        best = min(best, float(costs[k][np.arange(costs.shape[1]), assignment(costs[k], reduced=True)].sum()))
    return 1 - best / costs.shape[1]


#: other points that a point of a contour has: shape contexts are counts of them
OTHERS = RAYS - 1
#: rank of the similarities of counts that bounds are made of (in single precision), and of those that matchings are
ROUGH, WHOLE = 7, 16
#: rows that are bounded at once, and turns of each row that are matched first
BOUNDED, TRIED = 32, 2


@lru_cache
def _count_features(rank: int) -> tuple[np.ndarray, float]:
    """(counts, rank) whose products are near 2xy / (x + y), and what the similarity of two rows of counts made of them is
    at most below the true one. Half the chi-square of two rows of shares is 1 less that similarity."""
    x = np.arange(1.0, OTHERS + 1)
    true, weight = 2 * np.outer(x, x) / (x[:, None] + x), np.sqrt(x)
    size, axes = np.linalg.eigh(true / np.outer(weight, weight))
    out = axes[:, ::-1][:, :rank] * np.sqrt(np.maximum(0.0, size[::-1][:rank])) * weight[:, None]
    # errors are at most this much of the lesser count, and the lesser counts of two rows sum to OTHERS at most
    error = float((np.abs(out @ out.T - true) / np.minimum.outer(x, x)).max())
    return np.concatenate([np.zeros((1, rank)), out]) / np.sqrt(OTHERS), error


def _counts(contexts: np.ndarray) -> np.ndarray | None:
    """Shares of a contour's contexts as counts; None if they aren't."""
    counts = np.rint(contexts * OTHERS).astype(np.int64)
    whole = counts.size and (counts >= 0).all() and (counts.sum(axis=-1) == OTHERS).all() and np.abs(contexts * OTHERS - counts).max() < 1e-9
    return counts if whole else None


def contour_similarities(q: dict, rows: list[dict]) -> np.ndarray:
    """``contour_similarity`` of a query with ``contour_turns`` and each of the rows. Chi-squares are products of features of
    the counts; a turn is matched if a bound made of rough ones lets it be the best, and rows are matched together."""
    out = np.zeros(len(rows))
    turns = _counts(q["contour_turns"])
    refs, places = [], []
    for k, r in enumerate(rows):
        if min(q["solidity"], r["solidity"]) < 0.4 or len(q["points"]) < 2 or not len(r["context"]):
            continue
        thin = _thinned(r["context"])
        ref = _counts(thin) if turns is not None and thin.shape == turns.shape[1:] else None
        if ref is None:
            out[k] = contour_similarity(q, r)
        else:
            refs.append(ref)
            places.append(k)
    if not refs:
        return out
    refs = np.stack(refs)
    used = refs.any(axis=(0, 1)) & turns.any(axis=(0, 1))
    refs, turns = refs[..., used], turns[..., used]
    (of_turns, n), (rough, error) = turns.shape[:2], _count_features(ROUGH)
    rough, bounds = rough.astype(np.float32), np.empty((len(refs), of_turns))
    of_query = rough[turns].reshape(of_turns * n, -1)
    for a in range(0, len(refs), BOUNDED):
        some = refs[a : a + BOUNDED]
        alike = (of_query @ rough[some].reshape(len(some) * n, -1).T).reshape(of_turns, n, len(some), n)
        # no matching costs less than the nearest partners and, beyond those, what the other side's nearest cost
        nearest = alike.max(axis=3)
        alike -= nearest[..., None]
        bounds[a : a + BOUNDED] = (n - nearest.sum(axis=1) - alike.max(axis=1).sum(axis=2)).T - n * (error + 1e-5)
        del alike
    order = np.argsort(bounds, axis=1, kind="stable")
    bounds = np.take_along_axis(bounds, order, axis=1)
    whole, best, at, some = _count_features(WHOLE)[0], np.full(len(refs), float(n)), 0, TRIED
    of_query, of_refs = whole[turns].reshape(of_turns, n, -1), {}
    while at < of_turns:
        row, place = np.nonzero(bounds[:, at : at + some] < best[:, None])
        if not len(row):
            break
        costs = np.empty((len(row), n, n))
        for k, (r, t) in enumerate(zip(row.tolist(), order[row, at + place].tolist(), strict=True)):
            if r != of_refs.get("row"):
                of_refs = {"row": r, "features": np.ascontiguousarray(whole[refs[r]].reshape(n, -1).T)}
            np.matmul(of_query[t], of_refs["features"], out=costs[k])
        np.subtract(1.0, costs, out=costs)
        np.minimum.at(best, row, least_costs(np.maximum(0.0, costs, out=costs)))
        at, some = at + some, max(some, at)
    out[places] = 1 - best / n
    return out


def six(q: dict, rows) -> np.ndarray:
    """(rows, 6): grids, patches, regions, gradients, contours and Fourier coefficients of a prepared query with
    ``contour_turns`` and each row of a table of descriptors."""
    c = {c: np.stack(rows[c].to_numpy()) for c in ("occ64", "occ_bbox64", "patch", "patch_bbox", "fourier", "hog")}
    squares = {x: (c[x] * c[x]).sum(axis=1) for x in ("occ_bbox64", "fourier", "hog")}
    shifts = np.stack([np.roll(q["hog"].reshape(-1, 9), -k, axis=1).ravel() for k in range(9)])
    return np.stack([
        np.maximum(np.maximum(0.0, (q["occ_turns"] @ c["occ64"].T).max(axis=0)), _cosines(q["occ_bbox64"], c["occ_bbox64"], squares["occ_bbox64"])),
        np.maximum(np.maximum(0.0, (q["patch_turns"] @ c["patch"].T).max(axis=0)), np.maximum(0.0, c["patch_bbox"] @ q["patch_bbox"])),
        [region_similarity(q["parts"], region_arrays(x)) for x in rows["regions"]],
        np.max([_cosines(x, c["hog"], squares["hog"]) for x in shifts], axis=0),
        contour_similarities(q, [{"solidity": s, "context": np.array([np.asarray(v) for v in x])} for s, x in zip(rows["solidity"], rows["context"], strict=True)]),
        _cosines(q["fourier"], c["fourier"], squares["fourier"]),
    ], axis=1)


# -- feature pairs ------------------------------------------------------------------------------------------------------


def seven(q: dict, r: dict) -> list[float]:
    radial, angular = cosine(q["radial"], r["radial"]), cosine(q["ang_mag"], r["ang_mag"])
    return [overlap(q["hist"], r["hist"]), radial, angular, polar_similarity(q["polar_shape"], r["polar_shape"]), polar_similarity(q["polar_col"], r["polar_col"], 3), 0.5 * radial + 0.5 * angular, cosine(q["zern"], r["zern"])]


def cheap(q: dict, r: dict) -> float:
    return 0.4 * overlap(q["hist"], r["hist"]) + 0.2 * (cosine(q["zern"], r["zern"]) + cosine(q["radial"], r["radial"]) + cosine(q["ang_mag"], r["ang_mag"]))
