"""Detection and prominence against brute force, on one tile and on many."""

import heapq
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import ridgeline.grid
from ridgeline.features import geometric, morphological
from ridgeline.grid import from_numpy
from ridgeline.operators import prominence as prom
from ridgeline.operators import regions, stencil
from ridgeline.operators.components import connected_components
from ridgeline.sources.fixtures import g_plateau


def neighbours(cell, shape, k):
    for o in stencil.offsets(len(shape), k):
        at = tuple(c + x for c, x in zip(cell, o, strict=True))
        if all(0 <= a < n for a, n in zip(at, shape, strict=True)):
            yield at


def brute_plateaus(a, k):
    label, peak = {}, {}
    for start in np.ndindex(a.shape):
        if start in label:
            continue
        todo, top = [start], True
        label[start] = start
        while todo:
            c = todo.pop()
            for n in neighbours(c, a.shape, k):
                if a[n] > a[c]:
                    top = False
                if a[n] == a[c] and n not in label:
                    label[n] = start
                    todo.append(n)
        peak[start] = top
    return label, peak


def brute_saddle(a, k, cells):
    h = a[cells[0]]
    heap = [(-h, c) for c in cells]
    heapq.heapify(heap)
    seen, low = set(cells), h
    while heap:
        v, c = heapq.heappop(heap)
        if -v > h:
            return low
        low = min(low, -v)
        for n in neighbours(c, a.shape, k):
            if n not in seen:
                seen.add(n)
                heapq.heappush(heap, (-a[n], n))
    return None


CASES = [((40,), 1), ((9, 8), 1), ((9, 8), 2), ((4, 5, 4), 2)]


@pytest.mark.parametrize("tile,climb", [(1 << 18, 1 << 24), (9, 1 << 24), (30, 10)])
@pytest.mark.parametrize("shape,k", CASES)
def test_against_brute_force(spark, monkeypatch, shape, k, tile, climb):
    monkeypatch.setattr(ridgeline.grid, "TILE_CELLS", tile)
    monkeypatch.setattr(prom, "CLIMB_CELLS", climb)
    a = np.random.default_rng(len(shape) * 10 + k).integers(0, 5, shape)
    g = from_numpy(spark, a)
    flat = lambda c: int(np.ravel_multi_index(c, shape))
    label, peak = brute_plateaus(a, k)
    cells = regions.plateau_cells(g, k).cache()
    assert {r.cell_id: r.plateau_id for r in cells.collect()} == {flat(c): flat(s) for c, s in label.items()}
    assert {r.plateau_id for r in regions.regional_maxima(g, k, cells).collect()} == {flat(s) for s, p in peak.items() if p}
    want = {}
    for s, p in peak.items():
        if p:
            want[flat(s)] = brute_saddle(a, k, [c for c, x in label.items() if x == s])
    got = {r.peak_id: r.saddle_height for r in prom.merge_tree(g, k, cells).collect()}
    assert got == want
    mask = {r.cell_id: r.is_max for r in stencil.local_max_mask(g, k).collect()}
    assert mask == {flat(c): all(a[n] <= a[c] for n in neighbours(c, shape, k)) for c in np.ndindex(shape)}
    counts = {r.cell_id: r.n for r in stencil.neighbour_counts(g, k).collect()}
    assert counts == {flat(c): len(list(neighbours(c, shape, k))) for c in np.ndindex(shape)}
    cells.unpersist()


@pytest.mark.parametrize("seed,most", [(0, 0), (1, 0), (2, 6), (3, 0)])
def test_contraction_changes_nothing(spark, monkeypatch, seed, most):
    rng = np.random.default_rng(seed)
    g = from_numpy(spark, rng.integers(0, 4 if seed < 2 else 9, (12, 11)))
    want = {r.peak_id: r for r in prom.merge_tree(g, 1).collect()}
    values = {r.cell_id: r.value for r in g.cells.collect()}
    monkeypatch.setattr(ridgeline.grid, "TILE_CELLS", 36)
    monkeypatch.setattr(prom, "MOST_SADDLES", most)
    got = {r.peak_id: r for r in prom.merge_tree(g, 1).collect()}
    for p in want:
        a, b = want[p].asDict(), got[p].asDict()
        if b["join_height"] is None:  # settled before the peak met an equal one: not looked for
            a["join_height"] = a["join_cell"] = None
            a["group_id"] = b["group_id"]
        for name in ("saddle", "join"):  # of several passes of one height, any may be named
            cell, height = b.pop(f"{name}_cell"), b[f"{name}_height"]
            assert (cell is None) == (height is None) and (cell is None or values[cell] == height)
            a.pop(f"{name}_cell")
        assert a == b
    assert want.keys() == got.keys()


@pytest.mark.parametrize("hot", [1000, 5])
def test_components_of_a_path_and_a_star(spark, monkeypatch, hot):
    monkeypatch.setattr("ridgeline.operators.components.HOT", hot)
    n = 300
    path = [(i, i + 1) for i in range(n)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    odd = [(5000, 5000), (None, 3), (7, None), (2000, 2001), (2001, 2000)]
    edges = spark.createDataFrame(path + star + odd, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, **{1000 + i: 1000 for i in range(200)}, 2000: 2000, 2001: 2000}
    assert connected_components(edges.limit(0)).count() == 0


def test_plateau_fixture(spark):
    g = g_plateau(spark)
    every = {r.peak_id: r for r in prom.find_peaks(g, 1, "infinite_depth").collect()}
    inner = {r.peak_id for r in prom.find_peaks(g, 1, "infinite_height").collect()}
    assert 0 in every and 0 not in inner  # the border plateau
    assert {every[p].height for p in inner} == {9, 5, 6, 3}
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, "infinite_height", cells=cells)
    euler = {r.peak_id: r.euler_number for r in morphological.euler_number(geometric.peak_cells(cells, peaks), g).collect()}
    ring = next(p for p in inner if every[p].height == 6)
    assert euler[ring] == 0 and all(v == 1 for p, v in euler.items() if p != ring)
    tree = {r.peak_id: r for r in prom.merge_tree(g, 1, cells).collect()}
    twins = [p for p in inner if every[p].height == 3]
    assert len({tree[p].group_id for p in twins}) == 1 and tree[twins[0]].join_height == 2 and tree[twins[0]].saddle_height == 0
    groups = prom.virtual_peaks(prom.merge_tree(g, 1, cells), peaks, 2).collect()
    assert sorted(groups[0].constituents) == sorted(twins) and len([r for r in groups if r.height == 3]) == 1


def test_wlen_and_levels(spark):
    a = np.array([[0, 0, 0, 0, 0, 0, 0, 0, 0], [0, 5, 3, 4, 1, 9, 1, 2, 0], [0] * 9])
    g = from_numpy(spark, a)
    peaks = prom.find_peaks(g, 1, "infinite_depth")
    near = {r.peak_id: r.prominence for r in prom.prominence_within(g, peaks, 1.0).collect()}
    assert near[g.shape[1] + 1] == 5 and near[g.shape[1] + 3] == 4
    wide = {r.peak_id: r.prominence for r in prom.prominence_within(g, peaks, 50.0).collect()}
    full = {r.peak_id: r.prominence for r in prom.prominence(g, 1, "infinite_depth").collect()}
    assert wide == full
    area = {r.peak_id: r["cells"] for r in prom.area_at_level(g, prom.prominence(g, 1, "infinite_depth"), 0.5).collect()}
    assert area[g.shape[1] + 5] == 1 and area[g.shape[1] + 1] == 3


def test_custom_noise_and_errors(spark):
    g = from_numpy(spark, np.zeros((3, 3)))
    for call in (lambda: stencil.offsets(2, 3), lambda: prom.find_peaks(g, 1, "up"), lambda: prom.prominence_within(g, g.cells, 0), lambda: stencil.downsample(g, 2, "mode"), lambda: stencil.pad(g, 1, "wrap"), lambda: stencil.rolling_windows(g, [4, 1])):
        with pytest.raises(ValueError):
            call()
    assert len(stencil.offsets(3, 1)) == 6 and len(stencil.offsets(3, 3)) == 26
    assert regions.regional_maxima(g).count() == 1


def test_morphology_against_arrays(spark):
    rng = np.random.default_rng(4)
    a = np.kron(rng.integers(0, 3, (5, 5)), np.ones((3, 3), int))
    g = from_numpy(spark, a)
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, "infinite_depth", cells=cells)
    members = geometric.peak_cells(cells, peaks).cache()
    masks = {}
    for r in members.collect():
        masks.setdefault(r.peak_id, np.zeros(a.shape, bool))[r.i0, r.i1] = True
    e = morphological.ball(2, 1)

    def shifted(m, o):
        out = np.zeros_like(m)
        for c in itertools.product(*map(range, m.shape)):
            at = tuple(x + y for x, y in zip(c, o, strict=True))
            if all(0 <= x < n for x, n in zip(at, m.shape, strict=True)):
                out[c] = m[at]
        return out

    for r in morphological.responses(members, g, 1).collect():
        m = masks[r.peak_id]
        ero = np.all([shifted(m, o) for o in e], axis=0)
        dil = np.any([shifted(m, o) for o in e], axis=0)
        assert r.erosion_ratio == pytest.approx(ero.sum() / m.sum()) and r.dilation_gain == dil.sum() - m.sum()
        assert r.opening_loss == m.sum() - np.any([shifted(ero, o) for o in e], axis=0).sum()
    thin = {r.peak_id: r.skeleton_length for r in morphological.skeleton(members, g).collect()}
    assert all(1 <= thin[p] <= m.sum() for p, m in masks.items())
    wet = morphological.watershed(peaks, g, 4).collect()
    assert all(r.watershed_regions >= 1 for r in wet)
    depth = {r.peak_id: r.erosion_iterations for r in morphological.erosion_depth(members, g).collect()}
    for p, m in masks.items():
        n, m = 0, np.pad(m, 1)
        while m.any():
            m = np.all([np.roll(m, s, (0, 1)) for s in itertools.product((-1, 0, 1), repeat=2)], axis=0)
            n += 1
        assert depth[p] == n
    members.unpersist()


def test_many_grids_at_once(spark):
    rng = np.random.default_rng(0)
    arrays = {f"g{i}": rng.integers(0, 4, (6, 6)) for i in range(4)}
    grids = [from_numpy(spark, a, name) for name, a in arrays.items()]
    cells = grids[0].cells
    for g in grids[1:]:
        cells = cells.unionByName(g.cells)
    got = prom.merge_tree(grids[0].with_cells(cells)).groupBy("grid_id").agg(F.count("*").alias("n")).collect()
    want = {name: sum(brute_plateaus(a, 1)[1].values()) for name, a in arrays.items()}
    assert {r.grid_id: r.n for r in got} == want
