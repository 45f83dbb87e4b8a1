import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.analyzer import TerrainAnalyzer, analyze, benchmark_strategies, check_parameters
from ridgeline.features import FeatureStore, features, register_family
from ridgeline.features.registry import FAMILIES, family_of
from ridgeline.features import spread, topographic
from ridgeline.features.spread import clusters
from ridgeline.functions.helpers import ensure_list, ensure_tuple, profile_memory, timer, validate_array
from ridgeline.grid import densify, from_numpy
from ridgeline.operators import spatial, statistics, stencil
from ridgeline.operators.regions import Components
from ridgeline.plans.frame import parse_criterion
from ridgeline.plans.strategy import STRATEGIES, Registry, Strategy, auto_configure, characteristics, chunk_side, decide, decide_column
from ridgeline.sources.fixtures import test_pattern as pattern
from ridgeline.sources.tables import read_cells, write_cells


@pytest.fixture(scope="module")
def grid(spark):
    y, x = np.mgrid[0:20, 0:20]
    hills = 50 * np.exp(-((x - 5) ** 2 + (y - 6) ** 2) / 8) + 30 * np.exp(-((x - 14) ** 2 + (y - 12) ** 2) / 10) + 10 * np.exp(-((x - 4) ** 2 + (y - 15) ** 2) / 6)
    return from_numpy(spark, np.rint(hills).astype(int))


@pytest.fixture(scope="module")
def peaks(grid):
    return TerrainAnalyzer(boundary="infinite_height").find_peaks(grid)


def test_filters(peaks):
    assert len(peaks) == 3
    assert [r.height for r in peaks.sort_by("height", ascending=False).df.collect()] == [50, 30, 10]
    assert len(peaks.filter(prominence__gt=20)) == 2
    assert len(peaks.filter(height__in=[50, 10], area__gte=1)) == 2
    assert len(peaks.filter(height__nin=[50])) == 2 and len(peaks.filter(height__ne=50)) == 2 and len(peaks.filter(height=50)) == 1
    assert len(peaks.filter(height=lambda c: (c > 20) & (c < 40))) == 1
    assert len(peaks.filter(F.col("height") < 20)) == 1
    assert len(peaks.filter(prominence_threshold=20)) == 2
    assert len(peaks.filter_by_coordinates(x_range=(0, 10), y_range=(0, 10))) == 1
    assert peaks.top(1).df.first().height == 50
    assert len(list(peaks)) == 3 and peaks["prominence"].count() == 3 and peaks[0].peak_id <= peaks[1].peak_id
    with pytest.raises(ValueError):
        parse_criterion("height__near")
    with pytest.raises(ValueError):
        peaks.filter(smell__gt=1)
    assert {"coord_0", "coord_1"} <= set(peaks.to_df().columns)


def test_only_asked_families_are_planned(peaks):
    plan = peaks.filter(height__gt=20).df._jdf.queryExecution().optimizedPlan().toString()
    assert "prominence" not in plan


def test_every_family_builds(peaks):
    for name in FAMILIES:
        rows = features(peaks.context, [name]).collect()
        assert len(rows) == 3, name
    with pytest.raises(ValueError):
        features(peaks.context, ["smell"])


def test_own_family(peaks):
    register_family("double_height", lambda c: c.peaks.select("grid_id", "peak_id", (F.col("height") * 2).alias("twice")), ("twice",))
    try:
        assert sorted(r.twice for r in features(peaks.context, ["twice"]).collect()) == [20, 60, 100]
        with pytest.raises(ValueError):
            register_family("other", lambda c: c.peaks, ("twice",))
        assert family_of("twice") == "double_height"
    finally:
        FAMILIES.pop("double_height")


def test_facade(grid):
    out = analyze(grid, boundary="infinite_depth")
    assert out["validation"].is_valid and len(out["peaks"]) >= 3
    assert out["geometric"].count() == len(out["peaks"]) and out["stats"].first()["count"] == 400
    a = TerrainAnalyzer(strategy="uf")
    found = a.find_peaks(grid, min_area=1, height__gte=20)
    assert found.strategy == "union_find" and len(found) == 2
    assert a.analyze_prominence(found).count() >= 2 and a.analyze_prominence(found, wlen=3).count() == 2
    assert a.get_virtual_peaks(found).count() == 0
    assert a.calculate_features(found, ["volume", "tri"]).columns[2:] == ["volume", "tri"]
    with pytest.raises(ValueError):
        TerrainAnalyzer(connectivity=3).find_peaks(grid)


@pytest.mark.parametrize("bad,error", [({"connectivity": 0}, ValueError), ({"connectivity": "1"}, TypeError), ({"rel_height": 2.0}, ValueError), ({"boundary": "x"}, ValueError), ({"wlen": -1}, ValueError), ({"features": "a"}, TypeError), ({"scale": [1, 0]}, ValueError), ({"strategy": "none"}, ValueError)])
def test_parameter_checks(bad, error):
    with pytest.raises(error):
        check_parameters(**bad)


def test_strategy_rule(spark, grid):
    row = {"size": 5_000, "plateau_ratio": 0.0, "noise": 0.0, "peak_density": 0.0, "high": 1.0}
    table = [({}, "plateau_first"), ({"size": 200_000}, "union_find"), ({"size": 200_000, "plateau_ratio": 0.5}, "plateau_first"), ({"size": 200_000, "plateau_ratio": 0.3}, "plateau_first"), ({"size": 20_000, "noise": 0.2}, "union_find"), ({"size": 20_000}, "plateau_first"), ({"size": 60_000, "plateau_ratio": 0.15}, "union_find")]
    for change, want in table:
        assert decide(row | change) == want
    rows = spark.createDataFrame([tuple((row | c).values()) for c, _ in table], "size long, plateau_ratio double, noise double, peak_density double, high double")
    assert [r[0] for r in rows.select(decide_column()).collect()] == [w for _, w in table]
    assert decide(row, "uf") == "union_find" and decide(row, min_accuracy=0.95) == "union_find"
    assert decide(row | {"plateau_ratio": 0.2, "size": 50_000}, max_time=5) == "plateau_first"
    assert auto_configure({"noise": 0.4}, max_memory_mb=500).noise_threshold == 0.2
    assert chunk_side((100, 100)) is None and chunk_side((2000, 2000)) == 1000
    assert characteristics(grid).first()["size"] == 400
    r = Registry()
    r.register(Strategy("mine"), "m")
    assert r.get("M").name == "mine" and r.info()[0]["aliases"] == ["m"]
    with pytest.raises(ValueError):
        STRATEGIES.get("none")


def test_validation(spark):
    good = from_numpy(spark, np.arange(20.0).reshape(4, 5))
    assert statistics.validate(good).is_valid
    assert not statistics.validate(good, low=5).is_valid and not statistics.validate(good, expected_shape=(5, 4)).is_valid
    flat = statistics.validate(from_numpy(spark, np.ones((3, 3))))
    assert flat.is_valid and any("variance" in w for w in flat.warnings)
    holes = from_numpy(spark, np.array([1.0, np.nan, 3.0, np.inf]))
    out = statistics.validate(holes)
    assert not out.is_valid and out.metadata["g"]["finite"] == 2
    text = good.with_cells(good.cells.withColumn("value", F.lit("a")))
    assert "numbers" in statistics.validate(text).errors[0]
    seen = statistics.validate(good, extra=[lambda g, r: statistics.ValidationResult(warnings=[f"{r.cells}"])])
    assert seen.warnings == ["20"]
    with pytest.raises(ValueError):
        statistics.validate(good, level="odd")
    assert statistics.completeness(holes.cells).first().coverage == 0.5


@pytest.mark.parametrize("part", [1 << 16, 4])
def test_interpolation_in_parts(spark, monkeypatch, part):
    monkeypatch.setattr(stencil, "LINE_CELLS", part)
    rng = np.random.default_rng(8)
    y = rng.random((3, 30))
    y[rng.random(y.shape) < 0.7] = np.nan
    y[:, 12] = 1.0
    got = np.array([r.value for r in stencil.interpolate_missing(from_numpy(spark, y.T)).enumerate().collect()]).reshape(30, 3).T
    x = np.arange(30)
    assert np.allclose(got, [np.interp(x, x[~np.isnan(r)], r[~np.isnan(r)]) for r in y])


@pytest.mark.parametrize("rows", [200_000, 0])
def test_normalise_many_grids(spark, monkeypatch, rows):
    monkeypatch.setattr("ridgeline.shared.SMALL_ROWS", rows)
    cells = from_numpy(spark, np.arange(10)).cells.unionByName(from_numpy(spark, np.arange(10) * 3, "h").cells)
    got = statistics.normalise(cells).groupBy("grid_id").agg(F.max("normalised").alias("m"), F.count("*").alias("n")).collect()
    assert sorted((r.grid_id, r.m, r.n) for r in got) == [("g", 1.0, 10), ("h", 1.0, 10)]
    rough = statistics.statistics(cells, accuracy=1000).where("grid_id = 'g'").first()
    assert rough.median in (4, 5) and statistics.normalise(cells, "robust", accuracy=100).count() == 20


def test_interpolation_and_padding(spark):
    line = from_numpy(spark, np.array([np.nan, 1.0, np.nan, np.nan, 4.0, np.nan]))
    lin = [r.value for r in stencil.interpolate_missing(line).enumerate().collect()]
    assert lin == [1, 1, 2, 3, 4, 4]
    near = [r.value for r in stencil.interpolate_missing(line, "nearest").enumerate().collect()]
    assert near == [1, 1, 1, 4, 4, 4]
    a = np.arange(6).reshape(2, 3)
    for mode, kw in (("constant", {"constant_values": 7}), ("edge", {}), ("reflect", {})):
        got = [r.value for r in stencil.pad(from_numpy(spark, a), 1, mode, 7).enumerate().collect()]
        assert got == np.pad(a, 1, mode=mode, **kw).ravel().tolist()


def test_cubic_interpolation(spark):
    x = np.arange(12.0)
    y = 0.5 * x**3 - 2 * x + 1  # a cubic is its own spline
    holes = y.copy()
    holes[[2, 5, 6, 9]] = np.nan
    got = [r.value for r in stencil.interpolate_missing(from_numpy(spark, holes), "cubic").enumerate().collect()]
    assert np.allclose(got, y)
    with pytest.raises(ValueError):
        stencil.interpolate_missing(from_numpy(spark, np.ones((2, 2))), "cubic")


def test_helpers():
    assert ensure_list(None) == [] and ensure_list(3) == [3] and ensure_tuple(2, 3) == (2, 2, 2) and ensure_list((1, 2)) == [1, 2]
    with pytest.raises(ValueError):
        ensure_tuple((1, 2), 3)
    assert validate_array([1, 2], finite=True).tolist() == [1, 2]
    for bad, error in ((["a"], TypeError), ([], ValueError), ([np.nan], ValueError), (1, ValueError)):
        with pytest.raises(error):
            validate_array(bad, finite=True)
    fast = timer(lambda: 5)
    assert fast() == 5 and fast.seconds >= 0
    lean = profile_memory(lambda: 6)
    assert lean() == 6 and lean.megabytes >= 0


def test_feature_store(peaks):
    store, seen = FeatureStore(peaks.context, most=2), []
    store.precompute(["geometry", "tri"], lambda done, of: seen.append((done, of)))
    assert seen == [(1, 2), (2, 2)] and store.get("tri").count() == 3 and store.submit("solidity").result().count() == 3
    assert store.statistics() == {"families": 2, "hits": 1, "misses": 3}
    store.clear()
    assert store.statistics()["families"] == 0


def test_union_find_questions(spark):
    edges = spark.createDataFrame([(1, 2), (3, 4), (9, 9)], "a long, b long")
    c = Components(edges, spark.createDataFrame([(7,)], "node long"))
    assert c.count() == 4 and c.find(2) == 1 and c.connected(3, 4) and not c.connected(1, 3) and c.find(8) is None
    assert {r.component: r["size"] for r in c.sizes().collect()} == {1: 2, 3: 2, 7: 1, 9: 1}
    joined = c.union(2, 3)
    assert joined.count() == 3 and joined.connected(1, 4) and joined.containing(4).count() == 4
    assert c.merge(Components(spark.createDataFrame([(4, 7)], "a long, b long"))).connected(3, 7)
    assert c.add(spark.createDataFrame([(100,)], "n long")).count() == 5


def test_strategies_agree(grid):
    rows = benchmark_strategies(grid)
    assert {r["peaks"] for r in rows} == {3} and len(rows) == 2
    assert spatial.choose_index(10, 2) == "scan" and spatial.choose_index(5_000, 3) == "tree" and spatial.choose_index(5_000, 4) == "hash"
    assert spatial.grid_radius(grid, [5, 5], 2, 1.0).count() == 13


def test_points_queries(spark):
    rng = np.random.default_rng(1)
    pts = rng.random((200, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id long, x double, y double")
    q = df.limit(5).withColumnRenamed("id", "query_id")
    got = {(r.query_id, r.id) for r in spatial.radius_join(df, q, ["x", "y"], 0.2).collect()}
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    assert got == {(i, j) for i in range(5) for j in range(200) if d[i, j] <= 0.2}
    near = spatial.knn_join(df, q, ["x", "y"], 3).collect()
    assert {(r.query_id, r.id) for r in near} == {(i, int(j)) for i in range(5) for j in np.argsort(d[i], kind="stable")[:3]}
    with pytest.raises(ValueError):
        spatial.radius_join(df, q, ["x", "y"], -1)


@pytest.mark.parametrize("p", [2.0, 1.0, float("inf")])
def test_nearest_peaks_in_rounds(spark, monkeypatch, p):
    rng = np.random.default_rng(6)
    at = np.r_[rng.random((60, 2)) * 5, rng.random((20, 2)) * 100]
    height = rng.integers(0, 9, 80)
    height[7] = 20
    peaks = spark.createDataFrame([("g", i, int(h), float(x), float(y)) for i, ((x, y), h) in enumerate(zip(at, height, strict=True))], "grid_id string, peak_id long, height long, c0 double, c1 double")
    g = from_numpy(spark, np.zeros((2, 2)))
    monkeypatch.setattr(spread, "FEW_PEAKS", 0)
    gap = np.abs(at[:, None] - at[None])
    d = gap.max(axis=2) if np.isinf(p) else (gap**p).sum(axis=2) ** (1 / p)
    np.fill_diagonal(d, np.inf)
    got = {r.peak_id: r for r in spread.nearest_neighbours(peaks, g, 5, p).collect()}
    assert len(got) == 80 and all(np.allclose(got[i].knn, np.sort(d[i])[:5]) for i in range(80))
    iso = {r.peak_id: r for r in topographic.isolation(peaks, g, p).collect()}
    higher = {r.peak_id: r.higher_id for r in spread.nearest_peaks(peaks, g, p=p).collect()}
    for i in range(80):
        up = np.where(height >= height[i], d[i], np.inf)
        finite = d[i][np.isfinite(d[i])]
        assert iso[i].topographic_isolation == pytest.approx(up.min() if np.isfinite(up.min()) else finite.max())
        over = np.where(height > height[i], d[i], np.inf)
        assert higher[i] == (int(over.argmin()) if np.isfinite(over.min()) else None)


def test_ward_clusters(spark, grid):
    rows = [("g", i, 1, float(x), float(y)) for i, (x, y) in enumerate([(0, 0), (0, 1), (10, 10), (10, 11), (30, 30)])]
    df = spark.createDataFrame(rows, "grid_id string, peak_id long, height int, c0 double, c1 double")
    assert sorted((r.peak_id, r.cluster_id) for r in clusters(df, grid, 5.0).collect()) == [(0, 0), (1, 0), (2, 2), (3, 2), (4, 4)]


def test_sources(spark, grid, tmp_path):
    write_cells(grid, str(tmp_path / "cells"))
    back = read_cells(spark, str(tmp_path / "cells"), grid.shape, grid.mapping)
    assert back.cells.exceptAll(grid.cells).count() == 0
    sparse = densify(spark.createDataFrame([("a", 0, 5), ("a", 9, 1), ("b", 2, 3)], "grid_id string, i0 long, value long"), (4,))
    assert [(r.grid_id, r.value) for r in sparse.enumerate().collect()] == [("a", 5), ("a", 0), ("a", 0), ("a", 0), ("b", 0), ("b", 0), ("b", 3), ("b", 0)]
    for name in ("peaks", "sinusoid", "gaussian", "random"):
        assert pattern(spark, (6, 7), name, noise=0.01).cells.count() == 42
    with pytest.raises(ValueError):
        pattern(spark, (3,), "stripes")
    with pytest.raises(ValueError):
        from_numpy(spark, np.array(["a"]))
