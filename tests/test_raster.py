"""Raster kernels against plain loops, and the behaviours that image search relies on."""

import cmath
import itertools
import math

import numpy as np
import pytest

from facetline.operators.raster import descriptors as D
from facetline.operators.raster import masks as M
from facetline.operators.raster import pairs as P
from facetline.operators.raster import variants as V


def square(w=64, h=64, back=(255, 255, 255), front=(10, 10, 10), alpha=255):
    out = np.full((h, w, 4), 255, np.uint8)
    out[..., :3] = back
    out[..., 3] = alpha
    out[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4, :3] = front
    out[h // 4 : 3 * h // 4, w // 4 : 3 * w // 4, 3] = 255
    return out


def blob(rng, n=24):
    m = rng.random((n, n)) > 0.55
    m[:2] = m[-2:] = False
    m[:, :2] = m[:, -2:] = False
    return m


def test_variants_start_with_the_image_itself():
    image = square()
    out = V.query_variants(image)
    assert len(out) >= 2 and out[0] is image


def test_skeleton_thins_a_filled_square():
    out = V.skeleton(square())
    assert out.shape == (64, 64) and 0 < (out == 0).sum() < 900


def test_otsu_parts_two_levels():
    g = np.array([10] * 32 + [200] * 32, np.uint8).reshape(8, 8)
    assert 10 <= V.otsu(g) <= 200 and (V.binary(g) > 0).sum() == 32


def test_thin_line_stays():
    m = np.zeros((5, 5), bool)
    m[2] = True
    t = V.thinned(m)
    assert t[2, 2] and t.sum() >= 3


def test_median_takes_the_upper_of_a_cut_off_window():
    g = np.arange(9, dtype=np.uint8).reshape(3, 3)
    assert V.median(g)[1, 1] == 4 and V.median(g)[0, 0] == sorted([0, 1, 3, 4])[2]


def test_morphology_against_loops():
    rng = np.random.default_rng(0)
    m = blob(rng)
    h, w = m.shape
    get = lambda y, x: bool(0 <= y < h and 0 <= x < w and m[y, x])
    near = lambda y, x: [get(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert (M.dilate(m) == [[any(near(y, x)) for x in range(w)] for y in range(h)]).all()
    assert (M.erode(m) == [[all(near(y, x)) for x in range(w)] for y in range(h)]).all()


@pytest.mark.parametrize("steps", [M.FOUR, M.EIGHT])
def test_components_against_a_search(steps):
    m = blob(np.random.default_rng(1))
    label, n = M.labels(m, steps)
    seen = np.zeros(m.shape, int)
    count = 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            while todo:
                a, b = todo.pop()
                if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not seen[a, b]:
                    seen[a, b] = count
                    todo += [(a + i, b + j) for i, j in steps]
    assert n == count and (label == seen).all()


def test_query_segmentation_finds_what_stands_out():
    cover = M.query_coverage(square(front=(200, 30, 30)))
    assert M.box(cover > 0) == (16, 16, 48, 48)
    assert not M.query_coverage(np.full((20, 20, 4), 255, np.uint8)).any()


def test_foreground_by_alpha_and_by_flood():
    assert M.box(M.foreground(square(alpha=0))) == (16, 16, 48, 48)
    assert M.box(M.foreground(square())) == (16, 16, 48, 48)
    assert not M.foreground(np.full((20, 20, 4), 255, np.uint8)).any()


def test_bands():
    dark = np.zeros((100, 40), bool)
    dark[10:40, 5:35] = True
    dark[45:60, 5:35] = True  # a gap of five rows is under 12%
    dark[80:81, 5:35] = True  # thin
    assert M.content_bands(dark) == [(10, 60, 45 * 30)]
    assert M.main_band([(0, 5, 10), (10, 20, 15)]) is None


def test_widths_and_unit_vectors():
    image = square(front=(200, 40, 40), alpha=0)
    f = D.features(image, M.library_coverage(image))
    for name, width in D.WIDTHS.items():
        assert len(f[name]) == width, name
    assert np.isclose(f["hist"].sum(), 1) and np.isclose((f["zern"] ** 2).sum(), 1)
    s = D.shape(image)
    for name, width in D.SHAPE_WIDTHS.items():
        assert len(s[name]) == width, name
    assert s["context"].shape == (128, 60) and 0 < s["solidity"] <= 1
    assert D.features(image, np.zeros((64, 64))) is None


def test_hull_area_and_fill():
    points = np.array([[0, 0], [4, 0], [4, 3], [0, 3], [2, 1], [4, 0]])
    assert D.polygon_area(D.hull(points)) == 12
    ring = np.zeros((9, 9))
    ring[2:7, 2:7] = 1
    ring[4, 4] = 0
    assert D.filled(ring)[4, 4] == 1 and D.filled(ring)[0, 0] == 0


def test_uniform_patterns():
    bins = D.uniform_codes()
    assert len(set(bins.tolist())) == 59 and bins[0] == 0 and bins[0b01010101] == 58


def test_assignment_against_all_permutations():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 3), (4, 6), (6, 4), (5, 5)):
        c = rng.integers(0, 9, (n, m)).astype(float)
        to = P.assignment(c)
        rows = np.flatnonzero(to >= 0)
        assert len(set(to[rows].tolist())) == len(rows) == min(n, m)
        small = c if n <= m else c.T
        best = min(sum(small[i, p[i]] for i in range(min(n, m))) for p in itertools.permutations(range(max(n, m)), min(n, m)))
        assert c[rows, to[rows]].sum() == best


def test_reduced_start_costs_the_same():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 30):
        for c in (rng.random((n, n)), rng.integers(0, 3, (n, n)).astype(float)):
            plain, fast = P.assignment(c), P.assignment(c, reduced=True)
            assert sorted(fast) == list(range(n)) and c[np.arange(n), fast].sum() == pytest.approx(c[np.arange(n), plain].sum())


def test_chi_squares_against_the_formula():
    rng = np.random.default_rng(6)
    a, b = (np.where(rng.random((n, 20)) < 0.4, rng.random((n, 20)), 0.0) for n in (9, 5))
    b[0], a[1], b[2] = 0, 0, a[0]
    want = [[sum((x - y) ** 2 / (x + y) for x, y in zip(p, q, strict=True) if x + y > 0) / 2 for q in b] for p in a]
    assert np.allclose(P.chi_squares(a, b), want) and P.chi_squares(a, b).min() >= 0


def test_turning_an_object_keeps_it_similar():
    rng = np.random.default_rng(3)
    image = np.zeros((60, 60, 4), np.uint8)
    image[20:30, 10:50] = image[20:50, 10:20] = (180, 60, 40, 255)
    other = np.zeros((60, 60, 4), np.uint8)
    other[10:50, 10:50] = (40, 60, 180, 255)
    describe = lambda x: D.features(x, M.library_coverage(x))
    a, b, c = describe(image), describe(np.rot90(image).copy()), describe(other)
    assert P.polar_similarity(a["polar_shape"], b["polar_shape"]) > 0.95
    assert P.cheap(a, b) > 0.95 > P.cheap(a, c)
    turns = P.mask_turns(a["mask"])
    scores = P.mask_scores(turns, float(a["mask"].sum()), np.stack([b["mask"], c["mask"]]))
    assert scores[0] > 0.85 > scores[1]
    context = P.context_turns(a["mask"])
    assert P.context_similarity(context, P.contexts(P.context_points(b["mask"]))) > P.context_similarity(context, P.contexts(P.context_points(c["mask"])))
    x, y = D.shape(image), D.shape(np.rot90(image).copy())
    assert P.expert(P.prepared(x), y) > P.expert(P.prepared(x), D.shape(other))
    assert rng is not None


def test_context_bound_gives_the_least_cost():
    rng = np.random.default_rng(4)
    mask = (rng.random(4096) > 0.9) * rng.random(4096)
    other = (rng.random(4096) > 0.9) * rng.random(4096)
    ref, turns = P.contexts(P.context_points(other)), P.context_turns(mask, 6)
    costs = []
    for own in turns:
        cost = P.chi_squares(own, ref)
        costs.append(cost[np.arange(len(own)), P.assignment(cost)].sum() / max(cost.shape))
    assert np.isclose(P.context_similarity(turns, ref), np.clip(1 - min(costs), 0, 1))


def test_shape_dimensions_take_the_best_of_36_turns_or_the_box():
    from facetline.plans import image_search as I

    rng = np.random.default_rng(9)
    a, b = (D.shape(np.kron(np.dstack([rng.integers(40, 200, (8, 8))] * 3 + [np.where(rng.random((8, 8)) > 0.4, 255, 0)]), np.ones((6, 6, 1))).astype(np.uint8)) for _ in range(2))
    a["solidity"] = b["solidity"] = 1.0
    ref, sims = P._thinned(b["context"]), []
    for k in range(36):
        t = np.pi * k / 18
        turned = (a["points"] - 0.5) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + 0.5
        cost = P.chi_squares(P._thinned(D.log_polar(turned, 5, 12, 0.1, 2.0, False).reshape(len(turned), -1)), ref)
        sims.append(1 - cost[np.arange(len(cost)), P.assignment(cost)].mean())
    assert int(np.argmax(sims)) % 3 and np.isclose(P.contour_similarity(a, b), max(sims))
    row = pd_row(b)
    got = {r.dim: r.score for batch in I._six({1: a})(iter([row])) for r in batch.itertuples()}
    q = P.prepared(a)
    assert np.isclose(got["occ"], max(max(q["occ_turns"] @ b["occ64"]), P.cosine(a["occ_bbox64"], b["occ_bbox64"])))
    assert np.isclose(got["ncc"], max(0, max(q["patch_turns"] @ b["patch"]), a["patch_bbox"] @ b["patch_bbox"])) and np.isclose(got["sc"], max(sims))
    turned = {**b, "occ64": np.rot90(a["occ64"].reshape(64, 64)).ravel(), "occ_bbox64": b["occ_bbox64"]}
    assert next(I._six({1: a})(iter([pd_row(turned)]))).set_index("dim").score["occ"] > 0.999


def test_experts_of_many_rows_are_those_of_each():
    import pandas as pd

    rng = np.random.default_rng(4)
    shapes = [D.shape(np.kron(np.dstack([rng.integers(40, 200, (8, 8))] * 3 + [np.where(rng.random((8, 8)) > 0.4, 255, 0)]), np.ones((6, 6, 1))).astype(np.uint8)) for _ in range(4)]
    q = P.prepared(shapes[0])
    assert np.allclose(P.experts(q, P.stacked(pd.DataFrame(shapes))), [P.expert(q, r) for r in shapes])


def pd_row(found):
    import pandas as pd

    return pd.DataFrame([{"asked": [{"query_id": 1}], "ref_id": 2, **found}])


def test_own_context_sweeps_36_turns(monkeypatch):
    from facetline.plans import catalogue

    seen, make = [], P.context_turns
    monkeypatch.setattr(P, "context_turns", lambda *a: seen.append(make(*a)) or seen[-1])
    assert catalogue._own_context(square()) > 0.5 and len(seen[0]) == 36


@pytest.mark.parametrize("seed", range(4))
def test_spectrum_and_contour_against_plain_sums(seed):
    """Shares of 24 sectors in each of 16 rings by loops over pixels, and their discrete Fourier transforms by the sum."""
    rng = np.random.default_rng(seed)
    raster = np.zeros((40, 44, 4), np.uint8)
    raster[5:33, 7:38] = np.where(rng.random((28, 31, 1)) < 0.6, 255, 0)
    raster[5:9, 7:12] = 255
    pixels = [(x, y) for y in range(40) for x in range(44) if raster[y, x, 3] > 4]
    cx, cy = (sum(p[k] for p in pixels) / len(pixels) for k in (0, 1))
    rms = math.sqrt(sum((x - cx) ** 2 + (y - cy) ** 2 for x, y in pixels) / len(pixels))
    rings = [[0] * 24 for _ in range(16)]
    for x, y in pixels:
        ring, sector = math.hypot(x - cx, y - cy) / rms * 16, (math.degrees(math.atan2(y - cy, x - cx)) + 180) / 15
        assert min(abs(v - round(v)) for v in (ring, sector)) > 1e-12  # on no border, where the last bits would tell
        rings[min(15, int(ring))][min(23, int(sector))] += 1
    waves = []
    for row in rings:
        row = [n / (sum(row) or 1) for n in row]
        own = [abs(sum(v * cmath.exp(-2j * math.pi * f * k / 24) for k, v in enumerate(row))) for f in range(1, 13)]
        waves += [w / (sum(own) or 1) for w in own]
    assert np.allclose(D.features(raster, M.library_coverage(raster))["ang_mag"], np.array(waves) / sum(waves))

    points = rng.random((128, 2))
    plain = [abs(sum(complex(*p) * cmath.exp(-2j * math.pi * f * k / 128) for k, p in enumerate(points))) for f in range(1, 33)]
    assert np.allclose(D.fourier(points), np.array(plain) / plain[0])
    assert not D.fourier(np.full((128, 2), 0.5)).any()
