"""The library's queries: one for each operator with a table result, with equivalent DuckDB SQL where SQL has it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.analyzer import TerrainAnalyzer
from ridgeline.features import geometric, morphological, spread, topographic
from ridgeline.features.registry import Context
from ridgeline.grid import Grid
from ridgeline.mapping import AxisMapping, distance
from ridgeline.operators import prominence as prom
from ridgeline.operators import regions, spatial, statistics, stencil
from ridgeline.plans import sql as S
from ridgeline.plans import strategy
from ridgeline.plans.frame import PeakFrame
from ridgeline.sources import fixtures as fx
from ridgeline.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, others rounded to six digits, so that both engines give equal values."""
    out = []
    for c, kind in df.dtypes:
        if kind in ("int", "smallint", "tinyint"):
            out.append(F.col(c).cast("long").alias(c))
        elif kind in ("double", "float"):
            r = F.round(F.col(c).cast("double"), 6)
            out.append(F.when(r == 0, F.lit(0.0)).otherwise(r).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, folder: _plain(query(spark, folder))
    if sql is not None:
        ORACLES[name] = sql


def _r(expr: str, name: str) -> str:
    return f"CASE WHEN round(CAST({expr} AS DOUBLE), 6) = 0 THEN 0.0 ELSE round(CAST({expr} AS DOUBLE), 6) END::DOUBLE AS {name}"


def _b(expr: str, name: str) -> str:
    return f"CAST({expr} AS BIGINT) AS {name}"


_QD = S.grid("g", fx.QD, S.QD_SRC)
_QDT = S.grid("g", fx.QDT, S.QDT_SRC)
_DAY = S.grid("g", fx.DAY, S.DAY_SRC)
_REV = S.grid("g", fx.DAY, S.REV_SRC)
_EV = S.grid("g", fx.EV, S.EV_SRC)
_PEAKS = S.peaks(2, fx.QD, S.QD_SRC)
_PEAKS2 = S.peaks(2, fx.QD, S.QD_SRC, k=2)
_PEAKS_EV = S.peaks(2, fx.EV, S.EV_SRC)

MAPPING = AxisMapping((2.0, 0.5), (1.0, -3.0))


def _mapped(spark: SparkSession, folder: str) -> Grid:
    g = fx.g_qd(spark, folder)
    return Grid(g.cells, g.shape, MAPPING)


def _points(spark: SparkSession, folder: str) -> DataFrame:
    """The first three components of the embeddings, as points."""
    e = read_table(spark, folder, "embeddings")
    return e.select(F.col("vec_id").alias("id"), *(F.col("embedding")[d].cast("double").alias(f"x{d}") for d in range(3)))


_POINTS = "p AS (SELECT vec_id AS id, " + ", ".join(f"CAST(embedding[{d + 1}] AS DOUBLE) AS x{d}" for d in range(3)) + " FROM embeddings)"

# A and B: grids, coordinates, scalar functions.
_add("a1_densify", lambda s, f: fx.g_day(s, f).cells.select("i0", "cell_id", "value"), S.statement(_DAY, "SELECT i0, cell_id, value FROM g"))
_add(
    "a6_coordinate_mesh",
    lambda s, f: _mapped(s, f).coordinate_mesh(),
    f"SELECT CAST(a.i * 11 + b.i AS BIGINT) AS cell_id, CAST(a.i AS BIGINT) AS i0, CAST(b.i AS BIGINT) AS i1, {_r('1 + 2.0 * a.i', 'c0')}, {_r('-3 + 0.5 * b.i', 'c1')} FROM range(50) a(i) CROSS JOIN range(11) b(i)",
)
_add(
    "a7_enumerate_f",
    lambda s, f: fx.g_qd(s, f).cells.select("cell_id", (F.col("i1") * 50 + F.col("i0")).alias("position"), "value"),
    S.statement(_QD, "SELECT cell_id, CAST(row_number() OVER (ORDER BY i1, i0) - 1 AS BIGINT) AS position, value FROM g"),
)
_add(
    "b1_index_to_coord",
    lambda s, f: (g := _mapped(s, f)).cells.select("cell_id", *(c.alias(f"c{d}") for d, c in enumerate(g.mapping.coordinates(g.index())))),
    S.statement(_QD, f"SELECT cell_id, {_r('1 + 2.0 * i0', 'c0')}, {_r('-3 + 0.5 * i1', 'c1')} FROM g"),
)
for _mode, _rule in (("nearest", "round_even({}, 0)"), ("floor", "floor({})"), ("ceil", "ceil({})")):
    _add(
        f"b2_coord_to_index_{_mode}",
        lambda s, f, m=_mode: _points(s, f).select("id", *(i.alias(f"i{d}") for d, i in enumerate(AxisMapping((0.05, 0.1, 0.2), (-1.0, 0.5, 0.0)).indices([F.col(f"x{d}") for d in range(3)], m)))),
        f"WITH {_POINTS} SELECT id, {_b(_rule.format('(x0 + 1.0::DOUBLE) / 0.05::DOUBLE'), 'i0')}, {_b(_rule.format('(x1 - 0.5::DOUBLE) / 0.1::DOUBLE'), 'i1')}, {_b(_rule.format('(x2 - 0.0::DOUBLE) / 0.2::DOUBLE'), 'i2')} FROM p",
    )
_add(
    "b3_bounds",
    lambda s, f: (g := _mapped(s, f)).coordinate_mesh().agg(*(x for d in range(2) for x in (F.min(f"c{d}").alias(f"low_{d}"), F.max(f"c{d}").alias(f"high_{d}")))),
    "SELECT 1.0::DOUBLE AS low_0, 99.0::DOUBLE AS high_0, -3.0::DOUBLE AS low_1, 2.0::DOUBLE AS high_1",
)


def _probe(spark: SparkSession, folder: str) -> tuple[Grid, DataFrame, list[Column]]:
    g = _mapped(spark, folder)
    pts = _points(spark, folder).select("id", (F.col("x0") * 200 + 50).alias("q0"), (F.col("x1") * 10).alias("q1"))
    return g, pts, [F.col("q0"), F.col("q1")]


_PROBE = f"WITH RECURSIVE {_QD}, {_POINTS}, q AS (SELECT id, x0 * 200 + 50 AS q0, x1 * 10 AS q1 FROM p), n AS (SELECT *, round_even((q0 - 1) / 2.0::DOUBLE, 0) AS n0, round_even((q1 + 3) / 0.5::DOUBLE, 0) AS n1 FROM q)"
_INSIDE = "n0 BETWEEN 0 AND 49 AND n1 BETWEEN 0 AND 10"


def _valid(s: SparkSession, f: str) -> DataFrame:
    g, pts, q = _probe(s, f)
    return pts.select("id", g.valid_coordinate(q).alias("valid"))


def _clip(s: SparkSession, f: str) -> DataFrame:
    g, pts, q = _probe(s, f)
    index = g.clip(g.mapping.indices(q))
    return pts.select("id", *(c.alias(f"c{d}") for d, c in enumerate(g.clip_coordinates(q))), *(i.cast("long").alias(f"i{d}") for d, i in enumerate(index)))


def _sample(method: str) -> Query:
    def run(s: SparkSession, f: str) -> DataFrame:
        g, pts, _ = _probe(s, f)
        return spatial.sample(g, pts, ["q0", "q1"], method, -1.0)

    return run


_add("b10_valid_coordinate", _valid, f"{_PROBE} SELECT id, {_INSIDE} AS valid FROM n")
_add("b11_clip", _clip, f"{_PROBE} SELECT id, {_r('greatest(1.0, least(q0, 99.0))', 'c0')}, {_r('greatest(-3.0, least(q1, 2.0))', 'c1')}, {_b('greatest(0, least(n0, 49))', 'i0')}, {_b('greatest(0, least(n1, 10))', 'i1')} FROM n")
_add("b12_boundary_distance", lambda s, f: (g := fx.g_qdt(s, f)).cells.select("cell_id", g.boundary_distance(g.index()).alias("d")), S.statement(_QDT, "SELECT cell_id, CAST(least(i0, 49 - i0, i1, 10 - i1, i2, 8 - i2) AS BIGINT) AS d FROM g"))
_add("b13_sample_nearest", _sample("nearest"), f"{_PROBE} SELECT id, {_r('coalesce(g.value, -1)', 'sample')} FROM n LEFT JOIN g ON g.i0 = n.n0 AND g.i1 = n.n1")
_add(
    "b13_sample_linear",
    _sample("linear"),
    f"""{_PROBE}, x AS (SELECT id, (q0 - 1) / 2.0::DOUBLE AS e0, (q1 + 3) / 0.5::DOUBLE AS e1 FROM q), y AS (SELECT id, floor(e0) AS f0, floor(e1) AS f1, e0 - floor(e0) AS t0, e1 - floor(e1) AS t1 FROM x)
SELECT id, {_r('coalesce((1 - t0) * (1 - t1) * a.value + (1 - t0) * t1 * b.value + t0 * (1 - t1) * c.value + t0 * t1 * d.value, -1)', 'sample')} FROM y
LEFT JOIN g a ON a.i0 = f0 AND a.i1 = f1 LEFT JOIN g b ON b.i0 = f0 AND b.i1 = f1 + 1 LEFT JOIN g c ON c.i0 = f0 + 1 AND c.i1 = f1 LEFT JOIN g d ON d.i0 = f0 + 1 AND d.i1 = f1 + 1""",
)
_add("b14_subgrid", lambda s, f: fx.g_qd(s, f).subgrid([slice(10, 40, 2), slice(2, 9)]).cells.select("i0", "i1", "cell_id", "value"), S.statement(_QD, f"SELECT {_b('(i0 - 10) // 2', 'i0')}, {_b('i1 - 2', 'i1')}, {_b('(i0 - 10) // 2 * 7 + i1 - 2', 'cell_id')}, value FROM g WHERE i0 BETWEEN 10 AND 39 AND (i0 - 10) % 2 = 0 AND i1 BETWEEN 2 AND 8"))
_ABS = [f"abs(a.x{d} - b.x{d})" for d in range(3)]
for _name, _p, _e in (("1", 1.0, " + ".join(_ABS)), ("2", 2.0, "sqrt(" + " + ".join(f"{x} * {x}" for x in _ABS) + ")"), ("inf", math.inf, f"greatest({', '.join(_ABS)})")):
    _add(
        f"b17_minkowski_{_name}",
        lambda s, f, p=_p: (
            _points(s, f).alias("a").join(_points(s, f).alias("b"), F.col("a.id") == F.col("b.id") + 1).select("a.id", distance([F.col(f"a.x{d}") for d in range(3)], [F.col(f"b.x{d}") for d in range(3)], p).alias("d"))
        ),
        f"WITH {_POINTS} SELECT a.id, {_r(_e, 'd')} FROM p a JOIN p b ON a.id = b.id + 1",
    )
_NORM = {
    "minmax": "(value - (SELECT min(value) FROM g)) / (SELECT CASE WHEN max(value) = min(value) THEN 1 ELSE max(value) - min(value) END FROM g)::DOUBLE",
    "zscore": "(value - (SELECT avg(value) FROM g)) / (SELECT stddev_pop(value) FROM g)",
    "robust": "(value - (SELECT quantile_cont(value, 0.5) FROM g)) / (SELECT quantile_cont(value, 0.75) - quantile_cont(value, 0.25) FROM g)",
    "unit": "value / (SELECT sqrt(sum(CAST(value AS DOUBLE) * value)) FROM g)",
}
for _m, _e in _NORM.items():
    _add(f"b20_normalise_{_m}", lambda s, f, m=_m: statistics.normalise(fx.g_rev(s, f).cells, m).select("cell_id", "normalised"), S.statement(_REV, f"SELECT cell_id, {_r(_e, 'normalised')} FROM g"))
_add(
    "b21_pad_reflect",
    lambda s, f: stencil.pad(fx.g_qd(s, f), 2, "reflect").cells.select("i0", "i1", "cell_id", "value"),
    S.statement(
        _QD,
        f"SELECT {_b('a.i', 'i0')}, {_b('b.i', 'i1')}, {_b('a.i * 15 + b.i', 'cell_id')}, value FROM range(54) a(i) CROSS JOIN range(15) b(i) JOIN g ON g.i0 = CASE WHEN a.i < 2 THEN 2 - a.i WHEN a.i > 51 THEN 100 - a.i ELSE a.i - 2 END AND g.i1 = CASE WHEN b.i < 2 THEN 2 - b.i WHEN b.i > 12 THEN 22 - b.i ELSE b.i - 2 END",
    ),
)

_add(
    "b21_pad_edge",
    lambda s, f: stencil.pad(fx.g_qd(s, f), 2, "edge").cells.select("i0", "i1", "cell_id", "value"),
    S.statement(_QD, f"SELECT {_b('a.i', 'i0')}, {_b('b.i', 'i1')}, {_b('a.i * 15 + b.i', 'cell_id')}, value FROM range(54) a(i) CROSS JOIN range(15) b(i) JOIN g ON g.i0 = greatest(0, least(49, a.i - 2)) AND g.i1 = greatest(0, least(10, b.i - 2))"),
)
_add(
    "b21_pad_constant",
    lambda s, f: stencil.pad(fx.g_qd(s, f), 2, "constant", -1.0).cells.select("i0", "i1", "cell_id", F.col("value").cast("double").alias("value")),
    S.statement(_QD, f"SELECT {_b('a.i', 'i0')}, {_b('b.i', 'i1')}, {_b('a.i * 15 + b.i', 'cell_id')}, {_r('coalesce(value, -1)', 'value')} FROM range(54) a(i) CROSS JOIN range(15) b(i) LEFT JOIN g ON g.i0 = a.i - 2 AND g.i1 = b.i - 2"),
)


# C: filters, order, top-k.
def _frame(s: SparkSession, f: str, boundary: str = "infinite_depth") -> PeakFrame:
    g = fx.g_qd(s, f)
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, boundary, cells=cells)
    return PeakFrame(Context(g, peaks, geometric.peak_cells(cells, peaks), prom.merge_tree(g, 1, cells), boundary))


_BASE = _PEAKS + ",\n" + S.FLOOD + ",\nlow AS (SELECT min(value) AS m FROM g),\npr AS (SELECT peak_id, height, area, c0, c1, on_face, saddle_height, coalesce(saddle_height, m) AS base, height - coalesce(saddle_height, m) AS prominence FROM pk LEFT JOIN sd USING (peak_id) CROSS JOIN low)"
_add("c1_filter_ops", lambda s, f: _frame(s, f).filter(prominence__gte=10, height__gt=100, area__eq=1, peak_id__nin=[0, 1]).get_features(["prominence"]).drop("grid_id"), S.statement(_BASE, "SELECT peak_id, height, prominence FROM pr WHERE prominence >= 10 AND height > 100 AND area = 1 AND peak_id NOT IN (0, 1)"))
_add("c2_initial_filters", lambda s, f: TerrainAnalyzer(boundary="infinite_depth", min_boundary_distance=0).find_peaks(fx.g_qd(s, f), prominence__gte=10, height__gt=100).df.select("peak_id", "height"), S.statement(_BASE, "SELECT peak_id, height FROM pr WHERE prominence >= 10 AND height > 100"))
_add("c3_coordinate_range", lambda s, f: _frame(s, f).filter_by_coordinates(x_range=(10, 30), y_range=(2, 8)).df.select("peak_id", "height"), S.statement(_PEAKS, "SELECT peak_id, height FROM pk WHERE c0 BETWEEN 10 AND 30 AND c1 BETWEEN 2 AND 8"))
_add("c4_sort", lambda s, f: _frame(s, f).sort_by("height", ascending=False).df.select("peak_id", "height", "area"), S.statement(_PEAKS, f"SELECT peak_id, height, {_b('area', 'area')} FROM pk ORDER BY height DESC, peak_id"))
_add("c5_topk", lambda s, f: _frame(s, f).top(20).df.select("peak_id", "height"), S.statement(_PEAKS, "SELECT peak_id, height FROM pk ORDER BY height DESC, peak_id LIMIT 20"))
_add("c6_min_area", lambda s, f: prom.find_peaks(fx.g_qd(s, f), 1, "infinite_depth", min_area=2).select("peak_id", "area"), S.statement(_PEAKS, f"SELECT peak_id, {_b('area', 'area')} FROM pk WHERE area >= 2"))
_add("c7_boundary_artifacts", lambda s, f: prom.find_peaks(fx.g_qd(s, f), 1, "infinite_height", min_boundary_distance=2).select("peak_id", "height"), S.statement(_PEAKS, "SELECT peak_id, height FROM pk WHERE NOT on_face AND c0 >= 2 AND c0 < 48 AND c1 >= 2 AND c1 < 9"))

# D: stencils.
for _k in (1, 2, 3):
    _add(f"d2_neighbour_count_k{_k}", lambda s, f, k=_k: stencil.neighbour_counts(fx.g_qdt(s, f), k).drop("grid_id"), S.statement(f"{_QDT}, {S.steps(3, _k)}, {S.edges(3)}", "SELECT u AS cell_id, count(*) AS n FROM e GROUP BY 1"))
for _k in (1, 2):
    _add(f"d3_local_max_k{_k}", lambda s, f, k=_k: stencil.local_max_mask(fx.g_qd(s, f), k).select("cell_id", "is_max"), S.statement(f"{_QD}, {S.steps(2, _k)}, {S.edges(2)}", "SELECT u AS cell_id, max(hv) <= max(hu) AS is_max FROM e GROUP BY 1"))
_add("d3_local_max_3d_k2", lambda s, f: stencil.local_max_mask(fx.g_qdt(s, f), 2).where("is_max").select("cell_id", "value"), S.statement(f"{_QDT}, {S.steps(3, 2)}, {S.edges(3)}", "SELECT u AS cell_id, max(hu) AS value FROM e GROUP BY 1 HAVING max(hv) <= max(hu)"))
_add("d4_strict_maxima", lambda s, f: stencil.strict_maxima(fx.g_qd(s, f), threshold_rel=0.5, num_peaks=40).select("cell_id", "value"), S.statement(f"{_QD}, {S.steps(2, 1)}, {S.edges(2)}", "SELECT u AS cell_id, max(hu) AS value FROM e GROUP BY 1 HAVING max(hv) < max(hu) AND max(hu) >= 0.5 * (SELECT max(value) FROM g) ORDER BY value DESC, cell_id LIMIT 40"))
_add("d4_strict_maxima_apart", lambda s, f: stencil.strict_maxima(fx.g_qd(s, f), min_distance=3).select("cell_id", "value"))
_add("d5_peak_density", lambda s, f: stencil.peak_density(fx.g_qd(s, f)).select("density"), S.statement(f"{_QD}, {S.steps(2, 2)}, {S.edges(2)}", f"SELECT {_r('avg(CASE WHEN m <= value THEN 1.0 ELSE 0.0 END)', 'density')} FROM (SELECT u, max(hv) AS m FROM e GROUP BY 1) x JOIN g ON g.cell_id = x.u WHERE i0 BETWEEN 1 AND 48 AND i1 BETWEEN 1 AND 9"))
_add("d6_rolling_window", lambda s, f: stencil.rolling_windows(fx.g_day(s, f), [7], 3).groupBy("w0").agg(F.sum("value").alias("total"), F.max("value").alias("top")), S.statement(_DAY, f"SELECT CAST(w.i AS BIGINT) AS w0, {_b('sum(value)', 'total')}, max(value) AS top FROM range(800) w(i) JOIN g ON g.i0 BETWEEN w.i * 3 AND w.i * 3 + 6 WHERE w.i * 3 + 7 <= 2405 GROUP BY 1"))
_add("d6_rolling_window_2d", lambda s, f: stencil.rolling_windows(fx.g_qd(s, f), [5, 3], 2).groupBy("w0", "w1").agg(F.sum("value").alias("total")), S.statement(_QD, f"SELECT CAST(a.i AS BIGINT) AS w0, CAST(b.i AS BIGINT) AS w1, {_b('sum(value)', 'total')} FROM range(23) a(i) CROSS JOIN range(5) b(i) JOIN g ON g.i0 BETWEEN a.i * 2 AND a.i * 2 + 4 AND g.i1 BETWEEN b.i * 2 AND b.i * 2 + 2 GROUP BY 1, 2"))
for _m, _fn in (("mean", "avg"), ("max", "max"), ("min", "min"), ("median", "median")):
    _cast = (lambda e: _r(e, "value")) if _m in ("mean", "median") else (lambda e: f"{e} AS value")
    _add(
        f"d7_downsample_{_m}",
        lambda s, f, m=_m: stencil.downsample(fx.g_qd(s, f), [4, 3], m).cells.select("i0", "i1", "value"),
        S.statement(f"{_QD}, h AS (SELECT i0 // 4 AS i0, i1, {_fn}(value) AS value FROM g WHERE i0 < 48 AND i1 < 9 GROUP BY 1, 2)", f"SELECT {_b('i0', 'i0')}, {_b('i1 // 3', 'i1')}, {_cast(f'{_fn}(value)')} FROM h GROUP BY i0, i1 // 3"),
    )
_add(
    "d8_interpolate",
    lambda s, f: stencil.interpolate_missing(fx.g_day(s, f), "linear", 0).cells.select("cell_id", "value"),
    S.statement(
        f"{_DAY}, x AS (SELECT i0, cell_id, CASE WHEN value <> 0 THEN value::DOUBLE END AS v FROM g), y AS (SELECT *, last_value(v IGNORE NULLS) OVER b AS v0, last_value(CASE WHEN v IS NOT NULL THEN i0 END IGNORE NULLS) OVER b AS p0, first_value(v IGNORE NULLS) OVER a AS v1, first_value(CASE WHEN v IS NOT NULL THEN i0 END IGNORE NULLS) OVER a AS p1 FROM x WINDOW b AS (ORDER BY i0 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (ORDER BY i0 ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))",
        f"SELECT cell_id, {_r('CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN v1 WHEN v1 IS NULL THEN v0 ELSE v0 + (v1 - v0) * (i0 - p0) / (p1 - p0) END', 'value')} FROM y",
    ),
)
_add("d8_interpolate_cubic", lambda s, f: stencil.interpolate_missing(fx.g_day(s, f), "cubic", 0).cells.select("cell_id", "value"))
_W = [math.exp(-0.5 * (x / 0.5) ** 2) for x in range(3)]
_W = [w / (_W[0] + 2 * sum(_W[1:])) for w in _W]
_TAPS = ", ".join(f"({d}, {_W[abs(d)]!r}::DOUBLE)" for d in (-2, -1, 0, 1, 2))
_MIRROR = lambda e, n: f"CASE WHEN {e} < 0 THEN -1 - ({e}) WHEN {e} >= {n} THEN {2 * n - 1} - ({e}) ELSE {e} END"
_add(
    "d9_gaussian",
    lambda s, f: stencil.gaussian(fx.g_qd(s, f)).cells.select("cell_id", "value"),
    S.statement(
        f"{_QD}, k(d, w) AS (VALUES {_TAPS}), h AS (SELECT a.i0, a.i1, a.cell_id, sum(k.w * b.value) AS v FROM g a CROSS JOIN k JOIN g b ON b.i1 = a.i1 AND b.i0 = {_MIRROR('a.i0 + k.d', 50)} GROUP BY 1, 2, 3)",
        f"SELECT a.cell_id, {_r('sum(k.w * b.v)', 'value')} FROM h a CROSS JOIN k JOIN h b ON b.i0 = a.i0 AND b.i1 = {_MIRROR('a.i1 + k.d', 11)} GROUP BY 1",
    ),
)
_GRAD = (
    "gr AS (SELECT c.cell_id, c.i0, c.i1, c.value, CASE WHEN n.value IS NOT NULL AND s.value IS NOT NULL THEN (s.value - n.value) / 2.0::DOUBLE WHEN s.value IS NOT NULL THEN (s.value - c.value)::DOUBLE ELSE (c.value - n.value)::DOUBLE END AS g0, "
    "CASE WHEN w.value IS NOT NULL AND x.value IS NOT NULL THEN (x.value - w.value) / 2.0::DOUBLE WHEN x.value IS NOT NULL THEN (x.value - c.value)::DOUBLE ELSE (c.value - w.value)::DOUBLE END AS g1 FROM g c "
    "LEFT JOIN g n ON n.i0 = c.i0 - 1 AND n.i1 = c.i1 LEFT JOIN g s ON s.i0 = c.i0 + 1 AND s.i1 = c.i1 LEFT JOIN g w ON w.i0 = c.i0 AND w.i1 = c.i1 - 1 LEFT JOIN g x ON x.i0 = c.i0 AND x.i1 = c.i1 + 1)"
)
_add("d10_gradient", lambda s, f: stencil.gradient(fx.g_qd(s, f)).select("cell_id", "g0", "g1"), S.statement(f"{_QD}, {_GRAD}", f"SELECT cell_id, {_r('g0', 'g0')}, {_r('g1', 'g1')} FROM gr"))
_add("d10_noise_level", lambda s, f: stencil.noise_level(fx.g_qd(s, f)).select("noise"), S.statement(f"{_QD}, {_GRAD}", f"SELECT {_r('stddev_pop(sqrt(g0 * g0 + g1 * g1))', 'noise')} FROM gr"))
_add("d11_plateau_ratio", lambda s, f: stencil.plateau_ratio(fx.g_qd(s, f)).select("ratio"), S.statement(f"{_QD}, {S.steps(2, 1)}, {S.edges(2)}", f"SELECT {_r('avg(CASE WHEN same THEN 1.0 ELSE 0.0 END)', 'ratio')} FROM (SELECT u, bool_or(hu = hv) AS same FROM e GROUP BY 1)"))

# E: regions.
for _k in (1, 2):
    _head = f"{_QD}, {S.steps(2, _k)}, {S.edges(2)}, {S.LABELS}"
    _add(f"e1_plateaus_k{_k}", lambda s, f, k=_k: regions.plateau_cells(fx.g_qd(s, f), k).select("cell_id", "plateau_id"), S.statement(_head, "SELECT u AS cell_id, l AS plateau_id FROM lab"))
    _add(f"e2_regional_maxima_k{_k}", lambda s, f, k=_k: regions.regional_maxima(fx.g_qd(s, f), k).select("plateau_id", "height", "area", "c0", "c1", "on_face"), S.statement(_PEAKS if _k == 1 else _PEAKS2, f"SELECT peak_id AS plateau_id, height, {_b('area', 'area')}, {_r('c0', 'c0')}, {_r('c1', 'c1')}, on_face FROM pk"))
_add("e2_regional_maxima_3d", lambda s, f: regions.regional_maxima(fx.g_qdt(s, f), 3).select("plateau_id", "height", "area"), S.statement(S.peaks(3, fx.QDT, S.QDT_SRC, 3), f"SELECT peak_id AS plateau_id, height, {_b('area', 'area')} FROM pk"))


def _by_type_sql() -> str:
    """All event types at once: cells carry the type's number, and neighbours share it."""
    return f"""WITH RECURSIVE ty AS (SELECT event_type AS t, row_number() OVER (ORDER BY event_type) - 1 AS n FROM (SELECT DISTINCT event_type FROM events)),
src AS (SELECT event_type AS t, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x0, hour(ts) AS x1, count(*) AS v FROM events GROUP BY 1, 2, 3),
g AS (SELECT ty.t, ty.n AS i2, a.i AS i0, b.i AS i1, CAST(ty.n * 720 + a.i * 24 + b.i AS BIGINT) AS cell_id, CAST(coalesce(src.v, 0) AS BIGINT) AS value FROM ty CROSS JOIN range(30) a(i) CROSS JOIN range(24) b(i) LEFT JOIN src ON src.t = ty.t AND src.x0 = a.i AND src.x1 = b.i),
st(s0, s1) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)),
e AS (SELECT a.cell_id AS u, a.value AS hu, b.cell_id AS v, b.value AS hv FROM (SELECT g.*, i0 + s0 AS t0, i1 + s1 AS t1 FROM g CROSS JOIN st) a JOIN g b ON b.i2 = a.i2 AND b.i0 = a.t0 AND b.i1 = a.t1),
{S.LABELS}, {S.PLATEAUS}
SELECT t AS grid_id, CAST(peak_id % 720 AS BIGINT) AS plateau_id, any_value(value) AS height, count(*) AS area FROM pc GROUP BY 1, 2"""


_add("e2_by_event_type", lambda s, f: regions.regional_maxima(fx.g_ev_type(s, f)).select("grid_id", "plateau_id", "height", "area"), _by_type_sql())
_AROUND = f"{_QD}, {S.steps(2, 1)}, {S.edges(2)}, {S.LABELS}, ar AS (SELECT DISTINCT lab.l AS plateau_id, hu, v, hv FROM lab JOIN e ON e.u = lab.u WHERE hv <> hu), cn AS (SELECT plateau_id, count(*) AS boundary, count(*) FILTER (hv < hu) AS lower FROM ar GROUP BY 1)"
_add("e3_valid_strict", lambda s, f: regions.valid_plateaus(fx.g_qd(s, f)).drop("grid_id"), S.statement(_AROUND, "SELECT plateau_id FROM cn WHERE lower = boundary"))
_add("e4_valid_relaxed", lambda s, f: regions.valid_plateaus(fx.g_qd(s, f), strict=False).drop("grid_id"), S.statement(_AROUND, "SELECT plateau_id FROM cn WHERE lower > boundary * 0.5"))
_STAR = [(-1, -1), (-1, 1), (1, -1), (1, 1)]
_add("e5_custom_structure", lambda s, f: regions.plateau_cells(fx.g_qd(s, f), structure=_STAR).select("cell_id", "plateau_id"), S.statement(f"{_QD}, st(s0, s1) AS (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)), {S.edges(2)}, {S.LABELS}", "SELECT u AS cell_id, l AS plateau_id FROM lab"))


def _merge(s: SparkSession, f: str) -> DataFrame:
    """Plateaus found with diagonal steps alone, merged over faces; a plateau is valid if it is higher than 100."""
    g = fx.g_qd(s, f)
    cells = regions.plateau_cells(g, structure=_STAR).withColumn("valid", F.col("value") > 100)
    return regions.merge_plateaus(cells, g).drop("grid_id")


_add(
    "e6_merge_plateaus",
    _merge,
    S.statement(
        f"{_QD}, st(s0, s1) AS (VALUES (-1, -1), (-1, 1), (1, -1), (1, 1)), {S.edges(2)}, {S.LABELS}, sf(s0, s1) AS (VALUES (-1, 0), (1, 0), (0, -1), (0, 1)), {S.edges(2, name='f', st='sf')}, pe AS (SELECT DISTINCT a.l AS x, b.l AS y FROM f JOIN lab a ON a.u = f.u JOIN lab b ON b.u = f.v WHERE f.hu = f.hv), mg(u, l) USING KEY (u) AS (SELECT DISTINCT l, l FROM lab UNION SELECT pe.y, min(mg.l) FROM mg JOIN pe ON pe.x = mg.u JOIN recurring.mg cur ON cur.u = pe.y WHERE mg.l < cur.l GROUP BY pe.y)",
        "SELECT u AS plateau_id, l AS merged_id, bool_or(value > 100) OVER (PARTITION BY l) AS valid FROM mg JOIN g ON g.cell_id = mg.u",
    ),
)
_add("e7_component_sizes", lambda s, f: regions.plateaus(fx.g_qd(s, f)).groupBy("area").agg(F.count("*").alias("n")), S.statement(f"{_QD}, {S.steps(2, 1)}, {S.edges(2)}, {S.LABELS}", "SELECT area, count(*) AS n FROM (SELECT l, count(*) AS area FROM lab GROUP BY 1) GROUP BY 1"))
_add(
    "e8_condition_components",
    lambda s, f: regions.grid_components(fx.g_ev(s, f), lambda a, b: (a > 14) & (b > 14)).drop("grid_id"),
    S.statement(f"{_EV}, {S.steps(2, 1)}, {S.edges(2)}, {S.LABELS.replace('e.hu = e.hv', 'e.hu > 14 AND e.hv > 14')}", "SELECT u AS cell_id, l AS component FROM lab"),
)

# F: prominence.
_add("f1_prominence", lambda s, f: prom.prominence(fx.g_qd(s, f), boundary="infinite_depth").select("peak_id", "height", "base", "prominence"), S.statement(_BASE, "SELECT peak_id, height, base, prominence FROM pr"))
_add("f1_prominence_3d", lambda s, f: prom.prominence(fx.g_qdt(s, f), 1, "infinite_depth").select("peak_id", "prominence"))
_add(
    "f1_prominence_k2",
    lambda s, f: prom.prominence(fx.g_ev(s, f), 2, "infinite_height").select("peak_id", "height", "prominence"),
    S.statement(S.peaks(2, fx.EV, S.EV_SRC, 2) + ",\n" + S.FLOOD, "SELECT peak_id, height, height - coalesce(saddle_height, (SELECT min(value) FROM g WHERE i0 IN (0, 29) OR i1 IN (0, 23))) AS prominence FROM pk LEFT JOIN sd USING (peak_id)"),
)


def _within(s: SparkSession, f: str) -> DataFrame:
    g = fx.g_qd(s, f)
    cells = regions.plateau_cells(g)
    return prom.prominence_within(g, prom.find_peaks(g, 1, "infinite_depth", cells=cells), 4.0, 1, cells).drop("grid_id")


_add(
    "f2_prominence_wlen",
    _within,
    S.statement(
        _PEAKS
        + """,
bl AS (SELECT pk.peak_id, pk.height, g.cell_id, g.value FROM pk JOIN g ON (g.i0 - pk.c0) * (g.i0 - pk.c0) + (g.i1 - pk.c1) * (g.i1 - pk.c1) <= 16.0 UNION SELECT pc.peak_id, pk.height, pc.cell_id, pc.value FROM pc JOIN pk USING (peak_id)),
be AS (SELECT a.peak_id AS p, a.height AS h, a.cell_id AS u, a.value AS hu, b.cell_id AS v, b.value AS hv FROM bl a JOIN e ON e.u = a.cell_id JOIN bl b ON b.peak_id = a.peak_id AND b.cell_id = e.v),
fl(p, c, h, b) USING KEY (p, c) AS (
  SELECT peak_id, cell_id, value, value FROM pc
  UNION
  SELECT fl.p, be.v, fl.h, max(least(fl.b, be.hv)) FROM fl JOIN be ON be.p = fl.p AND be.u = fl.c LEFT JOIN recurring.fl cur ON cur.p = fl.p AND cur.c = be.v
  WHERE be.hu <= fl.h AND (cur.b IS NULL OR least(fl.b, be.hv) > cur.b) GROUP BY fl.p, be.v, fl.h
),
out AS (SELECT fl.p AS peak_id, any_value(fl.h) AS h, max(fl.b) FILTER (g.value > fl.h) AS up, min(fl.b) AS lowest FROM fl JOIN g ON g.cell_id = fl.c GROUP BY 1)""",
        "SELECT peak_id, coalesce(up, lowest) AS base, h - coalesce(up, lowest) AS prominence FROM out",
    ),
)
_add("f3_boundary_min", lambda s, f: prom.boundary_minimum(fx.g_qd(s, f)).drop("grid_id"), S.statement(_QD, "SELECT arg_min(value, value * 1000 + cell_id) FILTER (i0 IN (0, 49) OR i1 IN (0, 10)) AS face_min, arg_min(cell_id, value * 1000 + cell_id) FILTER (i0 IN (0, 49) OR i1 IN (0, 10)) AS face_min_cell, min(value) AS min_all FROM g"))
_DOWN = f"{_QD}, sf(s0, s1, r) AS (VALUES (-1, 0, 0), (1, 0, 1), (0, -1, 2), (0, 1, 3)), dn AS (SELECT a.cell_id AS u, arg_min(b.cell_id, b.value * 10 + a.r) AS v FROM (SELECT g.*, i0 + s0 AS t0, i1 + s1 AS t1, r FROM g CROSS JOIN sf) a JOIN g b ON b.i0 = a.t0 AND b.i1 = a.t1 WHERE b.value < a.value GROUP BY 1), pa(start, step, cell_id) AS (SELECT cell_id, 0, cell_id FROM g WHERE i1 = 5 UNION ALL SELECT start, step + 1, dn.v FROM pa JOIN dn ON dn.u = pa.cell_id)"


def _starts(s: SparkSession, f: str) -> tuple[Grid, DataFrame]:
    g = fx.g_qd(s, f)
    return g, prom.descent_paths(g, g.cells.where("i1 = 5"))


_add("f4_descent_path", lambda s, f: _starts(s, f)[1].select("start", "step", "cell_id", "value"), S.statement(_DOWN, f"SELECT start, {_b('step', 'step')}, pa.cell_id, value FROM pa JOIN g USING (cell_id)"))
_add("f4_descent_summary", lambda s, f: (lambda g, p: prom.path_summary(p, g))(*_starts(s, f)).select("start", "cells", "length", "low", "high"), S.statement(_DOWN, f"SELECT start, count(*) AS cells, {_r('count(*) - 1', 'length')}, min(value) AS low, max(value) AS high FROM pa JOIN g USING (cell_id) GROUP BY 1"))


def _peaks_of(s: SparkSession, f: str, fixture: Callable = fx.g_qd) -> tuple[Grid, DataFrame, DataFrame]:
    """Grid, all peaks, their plateau cells."""
    g = fixture(s, f)
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, "infinite_depth", cells=cells)
    return g, peaks, geometric.peak_cells(cells, peaks)


def _on_peaks(fn: Callable[[DataFrame, Grid], DataFrame], fixture: Callable = fx.g_qd) -> Query:
    def run(s: SparkSession, f: str) -> DataFrame:
        g, peaks, _ = _peaks_of(s, f, fixture)
        return fn(peaks, g).drop("grid_id")

    return run


def _on_members(fn: Callable[[DataFrame, Grid], DataFrame], fixture: Callable = fx.g_qd) -> Query:
    def run(s: SparkSession, f: str) -> DataFrame:
        g, _, members = _peaks_of(s, f, fixture)
        return fn(members, g).drop("grid_id")

    return run


_CENTRE = "ct AS (SELECT peak_id, height, area, c0, c1, CAST(floor(c0) AS BIGINT) AS m0, CAST(floor(c1) AS BIGINT) AS m1 FROM pk)"
_add(
    "f6_box_prominence",
    _on_peaks(topographic.box_prominence),
    S.statement(f"{_PEAKS}, {_CENTRE}", "SELECT peak_id, greatest(any_value(height) - min(value), 0) AS box_prominence FROM ct JOIN g ON abs(i0 - m0) <= 2 AND abs(i1 - m1) <= 2 WHERE i0 IN (greatest(0, m0 - 2), least(49, m0 + 2)) OR i1 IN (greatest(0, m1 - 2), least(10, m1 + 2)) GROUP BY 1"),
)


def _groups(s: SparkSession, f: str) -> DataFrame:
    return prom.merge_tree(fx.g_ev(s, f)).select("peak_id", "group_id")


# Two equal summits belong together if their best joint pass is above their pass to higher terrain.
_GROUP = S.FLOOD + """,
jn AS (SELECT fl.p AS a, pc.peak_id AS b, max(fl.b) AS w FROM fl JOIN pc ON pc.cell_id = fl.c WHERE pc.value = fl.h AND pc.peak_id <> fl.p GROUP BY 1, 2),
ok AS (SELECT a, b FROM jn LEFT JOIN sd ON sd.peak_id = jn.a WHERE sd.saddle_height IS NULL OR w > sd.saddle_height)"""
_add("f7_equal_groups", _groups, S.statement(_PEAKS_EV + ",\n" + _GROUP, "SELECT pk.peak_id, least(pk.peak_id, coalesce(min(ok.b), pk.peak_id)) AS group_id FROM pk LEFT JOIN ok ON ok.a = pk.peak_id GROUP BY pk.peak_id"))


def _virtual(s: SparkSession, f: str) -> DataFrame:
    g = fx.g_ev(s, f)
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, "infinite_depth", cells=cells)
    return prom.virtual_peaks(prom.merge_tree(g, 1, cells), peaks, 2).select("group_id", "height", "members", "area", "c0", "c1", "saddle_height")


_add(
    "f8_virtual_peaks",
    _virtual,
    S.statement(
        _PEAKS_EV + ",\n" + _GROUP + ",\ngp AS (SELECT pk.peak_id, least(pk.peak_id, coalesce(min(ok.b), pk.peak_id)) AS group_id FROM pk LEFT JOIN ok ON ok.a = pk.peak_id GROUP BY pk.peak_id)",
        f"SELECT group_id, any_value(height) AS height, count(*) AS members, {_b('sum(area)', 'area')}, {_r('sum(c0 * area) / sum(area)', 'c0')}, {_r('sum(c1 * area) / sum(area)', 'c1')}, max(saddle_height) AS saddle_height FROM gp JOIN pk USING (peak_id) LEFT JOIN sd USING (peak_id) GROUP BY 1 HAVING count(*) > 1",
    ),
)


def _virtual_prominence(s: SparkSession, f: str) -> DataFrame:
    g = fx.g_ev(s, f)
    cells = regions.plateau_cells(g)
    peaks = prom.find_peaks(g, 1, "infinite_depth", cells=cells)
    return prom.virtual_prominence(prom.virtual_peaks(prom.merge_tree(g, 1, cells), peaks, 2), g, "infinite_depth").select("group_id", "base", "prominence")


_add(
    "f9_virtual_prominence",
    _virtual_prominence,
    S.statement(
        _PEAKS_EV + ",\n" + _GROUP + ",\ngp AS (SELECT pk.peak_id, least(pk.peak_id, coalesce(min(ok.b), pk.peak_id)) AS group_id FROM pk LEFT JOIN ok ON ok.a = pk.peak_id GROUP BY pk.peak_id), vg AS (SELECT group_id, any_value(height) AS height, coalesce(max(saddle_height), (SELECT min(value) FROM g)) AS base FROM gp JOIN pk USING (peak_id) LEFT JOIN sd USING (peak_id) GROUP BY 1 HAVING count(*) > 1)",
        "SELECT group_id, base, height - base AS prominence FROM vg",
    ),
)
# Steepest ascent from plateau to plateau, ties to the smaller plateau.
_BASINS = """hp AS (SELECT a.l AS p, arg_max(b.l, e.hv * 100000 - b.l) AS q FROM e JOIN lab a ON a.u = e.u JOIN lab b ON b.u = e.v WHERE e.hv > e.hu GROUP BY 1),
up(p, q) USING KEY (p) AS (SELECT plateau_id, plateau_id FROM pt UNION SELECT cur.p, hp.q FROM up JOIN recurring.up cur ON cur.p = up.p JOIN hp ON hp.p = cur.q)"""
_add(
    "f10_saddles",
    lambda s, f: prom.peak_saddles(fx.g_qd(s, f)).select("peak_a", "peak_b", "saddle_height", "saddle_cell"),
    S.statement(
        _PEAKS + ",\n" + _BASINS + ",\nbs AS (SELECT lab.u AS cell_id, up.q AS basin FROM lab JOIN up ON up.p = lab.l), sx AS (SELECT a.basin AS peak_a, b.basin AS peak_b, least(e.hu, e.hv) AS w, CASE WHEN e.hu <= e.hv THEN e.u ELSE e.v END AS c FROM e JOIN bs a ON a.cell_id = e.u JOIN bs b ON b.cell_id = e.v WHERE a.basin < b.basin)",
        "SELECT peak_a, peak_b, max(w) AS saddle_height, arg_max(c, w * 100000 - c) AS saddle_cell FROM sx GROUP BY 1, 2",
    ),
)


def _half_height(s: SparkSession, f: str) -> DataFrame:
    g = fx.g_qd(s, f)
    p = prom.prominence(g, boundary="infinite_depth").where("saddle_height is not null")
    return prom.area_at_level(g, p, 0.5).select("peak_id", "level", "cells")


_add(
    "f12_rel_height_area",
    _half_height,
    S.statement(
        _BASE + ",\nlv AS (SELECT peak_id, height - prominence * 0.5 AS level FROM pr WHERE saddle_height IS NOT NULL)",
        f"SELECT lv.peak_id, {_r('any_value(level)', 'level')}, count(*) AS cells FROM lv JOIN fl ON fl.p = lv.peak_id WHERE fl.b >= lv.level GROUP BY 1",
    ),
)

# G: geometry.
_GEO = f"""SELECT peak_id, {_r('count(*)', 'area')}, {_r('sum(value)', 'volume')}, {_r('sum(value) - count(*) * min(value)', 'relief_volume')}, {_r('sum(i0 * value) / sum(value)', 'centroid_0')}, {_r('sum(i1 * value) / sum(value)', 'centroid_1')},
min(i0) AS box_min_0, max(i0) AS box_max_0, min(i1) AS box_min_1, max(i1) AS box_max_1, {_b('(max(i0) - min(i0) + 1) * (max(i1) - min(i1) + 1)', 'box_volume')},
{_r('count(*) / ((max(i0) - min(i0) + 1) * (max(i1) - min(i1) + 1))', 'extent')}, {_r('(max(i0) - min(i0) + 1) / (max(i1) - min(i1) + 1)', 'aspect_ratio_0_1')}, {_r('greatest(max(i0) - min(i0) + 1, max(i1) - min(i1) + 1) / least(max(i0) - min(i0) + 1, max(i1) - min(i1) + 1)', 'aspect_ratio')} FROM pc GROUP BY 1"""
_GEO_COLS = ["peak_id", "area", "volume", "relief_volume", "centroid_0", "centroid_1", "box_min_0", "box_max_0", "box_min_1", "box_max_1", "box_volume", "extent", "aspect_ratio_0_1", "aspect_ratio"]
_add("g2_geometry", _on_members(lambda m, g: geometric.geometry(m, g).select("grid_id", *_GEO_COLS), fx.g_ev), S.statement(_PEAKS_EV, _GEO))
_add(
    "g7_perimeter",
    _on_members(geometric.perimeter, fx.g_ev),
    S.statement(_PEAKS_EV + ", bd AS (SELECT pc.peak_id, count(DISTINCT e.v) AS n FROM pc JOIN e ON e.u = pc.cell_id WHERE e.hv <> e.hu GROUP BY 1)", f"SELECT peak_id, n AS boundary, {_r('n', 'perimeter')}, {_r('n * n / area', 'compactness')} FROM bd JOIN pk USING (peak_id)"),
)
_add(
    "g7_perimeter_ref",
    _on_members(geometric.boundary_ref, fx.g_ev),
    S.statement(_PEAKS_EV + ", fs AS (SELECT pc.peak_id, pc.cell_id, arg_min(e.v, CASE e.v - e.u WHEN -24 THEN 0 WHEN 24 THEN 1 WHEN -1 THEN 2 ELSE 3 END) AS o FROM pc JOIN e ON e.u = pc.cell_id WHERE e.hv <> e.hu GROUP BY 1, 2)", "SELECT peak_id, count(DISTINCT o) AS boundary_ref FROM fs GROUP BY 1"),
)
_add(
    "g9_elongation",
    _on_members(lambda m, g: geometric.geometry(m, g).select("grid_id", "peak_id", "elongation"), fx.g_ev),
    S.statement(
        _PEAKS_EV + ", cv AS (SELECT peak_id, count(*) AS n, covar_samp(i0, i0) AS a, covar_samp(i1, i1) AS b, covar_samp(i0, i1) AS x FROM pc GROUP BY 1), ev AS (SELECT peak_id, n, (a + b) / 2 AS m, sqrt((a - b) / 2 * (a - b) / 2 + x * x) AS r FROM cv)",
        f"SELECT peak_id, {_r('CASE WHEN n = 1 THEN 1.0 WHEN m - r > 1e-10 THEN (m + r) / (m - r) END', 'elongation')} FROM ev",
    ),
)
_add(
    "g11_moments",
    _on_members(lambda m, g: geometric.geometry(m, g).select("grid_id", "peak_id", "mean_0", "var_0", "std_0", "mean_1", "var_1", "std_1"), fx.g_ev),
    S.statement(_PEAKS_EV, "SELECT peak_id, " + ", ".join(f"{_r(f'avg(i{d})', f'mean_{d}')}, {_r(f'var_pop(i{d})', f'var_{d}')}, {_r(f'stddev_pop(i{d})', f'std_{d}')}" for d in range(2)) + " FROM pc GROUP BY 1"),
)

# H: topography.
_DIST = "sqrt((a.c0 - b.c0) * (a.c0 - b.c0) + (a.c1 - b.c1) * (a.c1 - b.c1))"
_add("h2_isolation", _on_peaks(topographic.isolation), S.statement(_PEAKS, f"SELECT a.peak_id, {_r(f'coalesce(min({_DIST}) FILTER (b.height >= a.height), 0)', 'isolation')}, {_r(f'coalesce(min({_DIST}) FILTER (b.height >= a.height), max({_DIST}))', 'topographic_isolation')} FROM pk a LEFT JOIN pk b ON a.peak_id <> b.peak_id GROUP BY 1"))
_add(
    "h3_relative_height",
    _on_peaks(lambda p, g: topographic.relative_height(p, g, [3, 5]), fx.g_ev),
    S.statement(
        f"{_PEAKS_EV}, {_CENTRE}, nr AS (SELECT ct.peak_id, height, g.value, abs(i0 - m0) <= 5 AND abs(i1 - m1) <= 5 AS box, sqrt((i0 - m0) * (i0 - m0) + (i1 - m1) * (i1 - m1)) AS d FROM ct JOIN g ON abs(i0 - m0) <= 6 AND abs(i1 - m1) <= 6)",
        f"SELECT peak_id, {_r('any_value(height) - coalesce(avg(value) FILTER (d BETWEEN 2.5 AND 3.5), any_value(value) FILTER (d = 0))', 'rel_height_3')}, {_r('any_value(height) - coalesce(avg(value) FILTER (d BETWEEN 4.5 AND 5.5), any_value(value) FILTER (d = 0))', 'rel_height_5')}, {_r('any_value(height) - avg(value) FILTER (box)', 'local_rel_height')} FROM nr GROUP BY 1",
    ),
)
_SLOPES = f"{_PEAKS}, {_GRAD}, fc AS (SELECT pc.peak_id, row_number() OVER (PARTITION BY peak_id ORDER BY pc.cell_id) AS r, g0, g1, sqrt(g0 * g0 + g1 * g1) AS l FROM pc JOIN gr ON gr.cell_id = pc.cell_id), f20 AS (SELECT * FROM fc WHERE r <= 20)"
_add(
    "h4_slopes",
    _on_members(topographic.slopes),
    S.statement(
        _SLOPES,
        f"SELECT peak_id, {_r('avg(l) FILTER (r <= 10)', 'gradient_mean')}, {_r('max(l) FILTER (r <= 10)', 'gradient_max')}, {_r('min(l) FILTER (r <= 10)', 'gradient_min')}, {_r('stddev_pop(l) FILTER (r <= 10)', 'gradient_std')}, {_r('degrees(atan(avg(l) FILTER (r <= 10)))', 'slope_angle')}, {_r('avg(l)', 'drainage_density')}, {_r('CASE WHEN count(*) FILTER (r <= 10 AND l > 1e-10) >= 2 THEN 1 / (1 + (stddev_pop(g0 / l) FILTER (r <= 10 AND l > 1e-10) + stddev_pop(g1 / l) FILTER (r <= 10 AND l > 1e-10)) / 2) ELSE 1.0 END', 'flow_consistency')} FROM f20 GROUP BY 1",
    ),
)
_add(
    "h6_aspect",
    _on_peaks(topographic.aspect),
    S.statement(f"{_PEAKS}, {_CENTRE}, {_GRAD}, an AS (SELECT ct.peak_id, g0, g1, 90.0 - degrees(atan2(g1, g0)) AS t FROM ct JOIN gr ON gr.i0 = m0 AND gr.i1 = m1)", f"SELECT peak_id, {_r('CASE WHEN g0 <> 0 OR g1 <> 0 THEN t - 360 * floor(t / 360) END', 'aspect_angle')} FROM an"),
)
_add(
    "h12_directional_slopes",
    _on_peaks(topographic.directional_slopes),
    S.statement(
        f"{_PEAKS}, {_CENTRE}, {_GRAD}, nb AS (SELECT u, stddev_pop(hv - hu) AS s, sum(hv - hu) AS t FROM e GROUP BY 1)",
        f"SELECT ct.peak_id, {_r('g0', 'slope_0')}, {_r('g1', 'slope_1')}, {_r('t', 'laplacian')}, {_r('s', 'slope_variability')} FROM ct JOIN gr ON gr.i0 = m0 AND gr.i1 = m1 JOIN nb ON nb.u = gr.cell_id",
    ),
)
_add("h7_roughness", _on_members(lambda m, g: topographic.roughness(m), fx.g_ev), S.statement(_PEAKS_EV, f"SELECT peak_id, {_r('stddev_pop(value)', 'roughness')} FROM pc GROUP BY 1"))
_AT = lambda a, b, n: f"LEFT JOIN g {n} ON {n}.i0 = ct.m0 + {a} AND {n}.i1 = ct.m1 + {b}"
_add(
    "h8_curvature",
    _on_peaks(topographic.curvature),
    S.statement(
        f"""{_PEAKS}, {_CENTRE}, sc AS (SELECT ct.peak_id, coalesce(s.value + n.value - 2 * c.value, 0) AS a, coalesce(x.value + w.value - 2 * c.value, 0) AS b, coalesce((p1.value - p2.value - p3.value + p4.value) / 4.0::DOUBLE, 0) AS x FROM ct JOIN g c ON c.i0 = m0 AND c.i1 = m1
{_AT(-1, 0, 'n')} {_AT(1, 0, 's')} {_AT(0, -1, 'w')} {_AT(0, 1, 'x')} {_AT(1, 1, 'p1')} {_AT(1, -1, 'p2')} {_AT(-1, 1, 'p3')} {_AT(-1, -1, 'p4')})""",
        f"SELECT peak_id, {_r('(a + b) / 2.0', 'mean_curvature')}, {_r('-(a + b)', 'sharpness')}, {_r('a * b - x * x', 'gaussian_curvature')}, {_r('(a + b) / 2.0 + sqrt((a - b) / 2.0 * ((a - b) / 2.0) + x * x)', 'principal_1')}, {_r('(a + b) / 2.0 - sqrt((a - b) / 2.0 * ((a - b) / 2.0) + x * x)', 'principal_2')} FROM sc",
    ),
)
_add("h10_position", _on_peaks(lambda p, g: topographic.topographic_position(p, g, 20)), S.statement(f"{_PEAKS}, {_CENTRE}", f"SELECT peak_id, {_r('any_value(height) - avg(value)', 'tpi')} FROM ct JOIN g ON abs(i0 - m0) <= 20 AND abs(i1 - m1) <= 20 GROUP BY 1"))
_add("h11_ruggedness", _on_members(topographic.ruggedness), S.statement(f"{_PEAKS}, fc AS (SELECT peak_id, cell_id, row_number() OVER (PARTITION BY peak_id ORDER BY cell_id) AS r FROM pc)", f"SELECT peak_id, {_r('sqrt(avg((hv - hu)::DOUBLE * (hv - hu)))', 'tri')} FROM fc JOIN e ON e.u = fc.cell_id WHERE r <= 20 GROUP BY 1"))

# I: morphology (on the day and hour grid, whose plateaus are larger).
_ELEMENT = "el AS (SELECT a.x AS s0, b.x AS s1 FROM range(-1, 2) a(x) CROSS JOIN range(-1, 2) b(x) WHERE a.x * a.x + b.x * b.x <= 1)"
_DIL = lambda src, out: f"{out} AS (SELECT DISTINCT peak_id, i0 + s0 AS i0, i1 + s1 AS i1 FROM {src} CROSS JOIN el WHERE i0 + s0 BETWEEN 0 AND 29 AND i1 + s1 BETWEEN 0 AND 23)"
_ERO = lambda src, out: f"{out} AS (SELECT peak_id, i0 - s0 AS i0, i1 - s1 AS i1 FROM {src} CROSS JOIN el GROUP BY 1, 2, 3 HAVING count(*) = 5 AND i0 - s0 BETWEEN 0 AND 29 AND i1 - s1 BETWEEN 0 AND 23)"
_ERO = lambda src, out: f"{out} AS (SELECT peak_id, x0 AS i0, x1 AS i1 FROM (SELECT peak_id, i0 - s0 AS x0, i1 - s1 AS x1 FROM {src} CROSS JOIN el) WHERE x0 BETWEEN 0 AND 29 AND x1 BETWEEN 0 AND 23 GROUP BY 1, 2, 3 HAVING count(*) = 5)"
_N = lambda t: f"(SELECT count(*) FROM {t} q WHERE q.peak_id = pk.peak_id)"
_add(
    "i2_responses",
    _on_members(lambda m, g: morphological.responses(m, g, 1), fx.g_ev),
    S.statement(
        f"{_PEAKS_EV}, {_ELEMENT}, {_ERO('pc', 'er')}, {_DIL('pc', 'di')}, {_DIL('er', 'op')}, {_ERO('di', 'cl')}, cn AS (SELECT peak_id, area, {_N('er')} AS x, {_N('di')} AS d, {_N('op')} AS o, {_N('cl')} AS c FROM pk)",
        f"SELECT peak_id, {_r('x / area', 'erosion_ratio')}, {_r('d / area', 'dilation_ratio')}, {_b('d - area', 'dilation_gain')}, {_r('o / area', 'opening_ratio')}, {_b('area - o', 'opening_loss')}, {_r('c / area', 'closing_ratio')}, {_b('c - area', 'closing_gain')} FROM cn",
    ),
)
_add("i6_solidity", _on_members(morphological.solidity, fx.g_ev), S.statement(_PEAKS_EV, f"SELECT peak_id, {_r('CASE WHEN count(*) < 3 THEN 1.0 ELSE count(*) / ((max(i0) - min(i0) + 1) * (max(i1) - min(i1) + 1)) END', 'solidity')} FROM pc GROUP BY 1"))
_INNER = "ib AS (SELECT DISTINCT pc.peak_id, pc.i0, pc.i1 FROM pc JOIN e ON e.u = pc.cell_id LEFT JOIN pc o ON o.peak_id = pc.peak_id AND o.cell_id = e.v WHERE o.cell_id IS NULL)"
_add(
    "i7_concavity",
    _on_members(morphological.concavity, fx.g_ev),
    S.statement(
        f"{_PEAKS_EV}, {_INNER}, sp AS (SELECT peak_id, i0 - lag(i0) OVER w AS a0, i1 - lag(i1) OVER w AS a1, lead(i0) OVER w - i0 AS b0, lead(i1) OVER w - i1 AS b1 FROM ib WINDOW w AS (PARTITION BY peak_id ORDER BY i0, i1))",
        f"SELECT peak_id, {_r('CASE WHEN count(*) >= 3 THEN count(*) FILTER (a0 * b1 - a1 * b0 < 0) / count(*) ELSE 0 END', 'concavity')} FROM sp GROUP BY 1",
    ),
)
def _parts(s: SparkSession, f: str) -> DataFrame:
    """Masks of many parts: the cells of each remainder of the value."""
    g = fx.g_ev(s, f)
    return morphological.connectivity_pattern(g.cells.withColumn("peak_id", F.col("value") % 4), g).drop("grid_id", "component_sizes")


_add(
    "i8_connectivity",
    _parts,
    S.statement(
        f"{_EV}, {S.steps(2, 2)}, {S.edges(2)}, {S.LABELS.replace('e.hu = e.hv', 'e.hu % 4 = e.hv % 4')}, sz AS (SELECT value % 4 AS peak_id, l, count(*) AS s FROM lab JOIN g ON g.cell_id = lab.u GROUP BY 1, 2)",
        f"SELECT peak_id, count(*) AS components, {_r('max(s) / sum(s)', 'largest_share')}, {_r('var_pop(s)', 'size_variance')} FROM sz GROUP BY 1",
    ),
)
_add("i9_skeleton", _on_members(morphological.skeleton, fx.g_ev))
_add("i10_watershed", _on_peaks(lambda p, g: morphological.watershed(p, g, 6), fx.g_ev))
_add("i2_erosion_depth", _on_members(morphological.erosion_depth, fx.g_ev))
# Each vertex, edge and face of the union of closed cells: Euler's formula gives components less holes for
# face-connected masks when corners that only touch count apart.
_add("i11_euler", _on_members(morphological.euler_number, fx.g_ev))
_add(
    "i12_boundary",
    _on_members(morphological.boundary_complexity, fx.g_ev),
    S.statement(
        f"{_PEAKS_EV}, {_INNER}, bx AS (SELECT peak_id, count(*) AS n, max(i0) - min(i0) + max(i1) - min(i1) AS t FROM ib GROUP BY 1)",
        f"SELECT peak_id, n AS boundary_length, {_r('n / sqrt(area)', 'boundary_complexity')}, {_r('CASE WHEN n < 2 OR t = 0 THEN 1.0 ELSE 1 + least(n / (2.0 * t), 1.0) END', 'fractal_dimension')} FROM bx JOIN pk USING (peak_id)",
    ),
)

# J: how peaks lie to one another.
_PAIRS = f"{_PEAKS}, pr AS (SELECT a.peak_id, b.peak_id AS other_id, a.height, b.height AS other_height, {_DIST} AS d FROM pk a JOIN pk b ON a.peak_id <> b.peak_id)"
_add(
    "j3_knn",
    _on_peaks(lambda p, g: spread.nearest_neighbours(p, g).drop("knn")),
    S.statement(f"{_PAIRS}, rk AS (SELECT *, row_number() OVER (PARTITION BY peak_id ORDER BY d, other_id) AS r FROM pr WHERE d > 0)", f"SELECT peak_id, {_r('min(d)', 'nearest')}, {_r('avg(d)', 'mean_knn')}, {_r('stddev_pop(d)', 'std_knn')}, {_r('max(d)', 'max_knn')}, count(*) AS k_used FROM rk WHERE r <= 5 GROUP BY 1"),
)
_add("j2_pair_distances", _on_peaks(spread.pair_distances, fx.g_ev), S.statement(f"{_PEAKS_EV}", f"SELECT a.peak_id, b.peak_id AS other_id, {_r(_DIST, 'd')}, a.height, b.height AS other_height FROM pk a JOIN pk b ON a.peak_id <> b.peak_id"))
_PI = f"{math.pi!r}::DOUBLE"
_add(
    "j4_density",
    _on_peaks(spread.local_density),
    S.statement(
        f"{_PAIRS}, mn AS (SELECT *, avg(d) FILTER (d > 0) OVER (PARTITION BY peak_id) AS m FROM pr)",
        "SELECT peak_id, " + ", ".join(_r(f"count(*) FILTER (d <= {r}) / ({_PI} * {r} * {r})", f"density_r{r}") for r in (5, 10, 20, 50)) + f", {_r(f'count(*) FILTER (d <= m) / (any_value(m) * any_value(m) * {_PI})', 'density_adaptive')} FROM mn GROUP BY 1",
    ),
)
_add("j5_clusters", _on_peaks(lambda p, g: spread.clustering(p, g)))
_add(
    "j6_distribution",
    _on_peaks(spread.distribution),
    S.statement(
        f"{_PEAKS}, cd AS (SELECT *, sqrt((c0 - 25) * (c0 - 25) + (c1 - 5.5) * (c1 - 5.5)) AS d FROM pk)",
        f"SELECT peak_id, {_r('d', 'center_distance')}, {_r('d / max(d) OVER ()', 'center_distance_norm')}, {_r('c0 / 50', 'relative_0')}, {_r('c1 / 11', 'relative_1')}, {_r('abs(c0 / 50 - 0.5)', 'deviation_0')}, {_r('abs(c1 / 11 - 0.5)', 'deviation_1')} FROM cd",
    ),
)
_add(
    "j7_isolation",
    _on_peaks(spread.isolation_measures),
    S.statement(f"{_PAIRS}, mh AS (SELECT max(height)::DOUBLE AS h FROM pk)", f"SELECT peak_id, {_r('coalesce(min(d) FILTER (other_height >= height), max(d))', 'topographic')}, {_r('min(d) FILTER (d > 0)', 'general')}, {_r('min(d / (other_height / h + 0.1::DOUBLE))', 'prominence_isolation')} FROM pr CROSS JOIN mh GROUP BY 1"),
)
_add("j8_boundary", _on_peaks(spread.boundary_distances), S.statement(_PEAKS, f"SELECT peak_id, {_r('least(c0, 49 - c0, c1, 10 - c1)', 'min_boundary')}, {_r('greatest(c0, 49 - c0, c1, 10 - c1)', 'max_boundary')}, {_r('(49 + 10) / 4.0', 'mean_boundary')}, {_r('least(c0 / 50, (49 - c0) / 50, c1 / 11, (10 - c1) / 11)', 'norm_boundary')} FROM pk"))
_add(
    "j9_nearest_higher",
    _on_peaks(spread.nearest_peaks),
    S.statement(
        f"{_PAIRS}, hi AS (SELECT peak_id, other_id, d, row_number() OVER (PARTITION BY peak_id ORDER BY d, other_id) AS r FROM pr WHERE other_height > height), si AS (SELECT peak_id, other_id, d, row_number() OVER (PARTITION BY peak_id ORDER BY d, other_id) AS r FROM pr WHERE abs(other_height - height) <= abs(height) * 0.1::DOUBLE)",
        f"SELECT pk.peak_id, hi.other_id AS higher_id, {_r('hi.d', 'higher_distance')}, si.other_id AS similar_id, {_r('si.d', 'similar_distance')} FROM pk LEFT JOIN hi ON hi.peak_id = pk.peak_id AND hi.r = 1 LEFT JOIN si ON si.peak_id = pk.peak_id AND si.r = 1",
    ),
)

# K: spatial queries.
_XYZ = ["x0", "x1", "x2"]
_D3 = "sqrt((p.x0 - q.x0) * (p.x0 - q.x0) + (p.x1 - q.x1) * (p.x1 - q.x1) + (p.x2 - q.x2) * (p.x2 - q.x2))"


def _centres(s: SparkSession, f: str) -> DataFrame:
    return _points(s, f).where("id % 50 = 0").withColumnRenamed("id", "query_id")


_CENTRES = f"WITH {_POINTS}, q AS (SELECT id AS query_id, x0, x1, x2 FROM p WHERE id % 50 = 0)"
_add("k1_radius", lambda s, f: spatial.radius_join(_points(s, f), _centres(s, f), _XYZ, 0.15), f"{_CENTRES} SELECT query_id, id, {_r(_D3, 'd')} FROM q JOIN p ON {_D3} <= 0.15::DOUBLE")
_add("k2_knn", lambda s, f: spatial.knn_join(_points(s, f), _centres(s, f), _XYZ, 7), f"{_CENTRES}, r AS (SELECT query_id, id, {_D3} AS d, row_number() OVER (PARTITION BY query_id ORDER BY {_D3}, id) AS rank FROM q CROSS JOIN p) SELECT query_id, id, {_r('d', 'd')}, rank FROM r WHERE rank <= 7")
_add("k3_range", lambda s, f: spatial.range_query(_points(s, f), _XYZ, [-0.1, -0.2, -0.1], [0.2, 0.1, 0.3]).select("id"), f"WITH {_POINTS} SELECT id FROM p WHERE x0 BETWEEN -0.1::DOUBLE AND 0.2::DOUBLE AND x1 BETWEEN -0.2::DOUBLE AND 0.1::DOUBLE AND x2 BETWEEN -0.1::DOUBLE AND 0.3::DOUBLE")
_add("k4_spatial_hash", lambda s, f: spatial.hash_cells(_points(s, f), _XYZ, 0.1).groupBy("b0", "b1", "b2").agg(F.count("*").alias("n")), f"WITH {_POINTS} SELECT {', '.join(_b(f'floor(x{d} / 0.1::DOUBLE)', f'b{d}') for d in range(3))}, count(*) AS n FROM p GROUP BY 1, 2, 3")
_add("k5_grid_radius", lambda s, f: spatial.grid_radius(fx.g_qdt(s, f), [20, 5, 4], 4.5).select("cell_id", "value", "d"), S.statement(_QDT, f"SELECT cell_id, value, {_r('sqrt((i0 - 20) ** 2 + (i1 - 5) ** 2 + (i2 - 4) ** 2)', 'd')} FROM g WHERE (i0 - 20) ** 2 + (i1 - 5) ** 2 + (i2 - 4) ** 2 <= 20.25"))
_add("k6_grid_radius_coord", lambda s, f: spatial.grid_radius_coordinates(_mapped(s, f), [41.5, -0.25], 7.0).select("cell_id", "d"), S.statement(_QD, f"SELECT cell_id, {_r('sqrt((1 + 2.0 * i0 - 41.5) ** 2 + (-3 + 0.5 * i1 + 0.25) ** 2)', 'd')} FROM g WHERE sqrt((1 + 2.0 * i0 - 41.5) ** 2 + (-3 + 0.5 * i1 + 0.25) ** 2) <= 7"))
_add("k7_grid_range", lambda s, f: spatial.grid_range(_mapped(s, f), [10, -1.2], [30.5, 0.7]).select("cell_id", "value"), S.statement(_QD, "SELECT cell_id, value FROM g WHERE 1 + 2.0 * i0 BETWEEN 10 AND 30.5 AND -3 + 0.5 * i1 BETWEEN -1.2 AND 0.7"))
_add("k7_grid_range_outward", lambda s, f: spatial.grid_range(_mapped(s, f), [10, -1.2], [30.5, 0.7], True).select("cell_id", "value"), S.statement(_QD, "SELECT cell_id, value FROM g WHERE i0 BETWEEN 4 AND 15 AND i1 BETWEEN 3 AND 8"))

# L: statistics and validation.
_PROFILE = "SELECT count(*) AS cells, count(*) AS finite, {}, {}, min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, {}, count(*) FILTER (value < 5) AS below, count(*) FILTER (value > 200) AS above, (SELECT count(*) FROM g WHERE abs(value - (SELECT avg(value) FROM g)) > 3 * (SELECT stddev_pop(value) FROM g)) AS outliers FROM g"
_add("l1_profile", lambda s, f: statistics.value_profile(fx.g_qdt(s, f).cells, 5, 200).drop("grid_id"), S.statement(_QDT, _PROFILE.format(_r("avg(value)", "mean"), _r("var_pop(value)", "var"), _r("quantile_cont(value, 0.5)", "median"))))
_add(
    "l7_quality_score",
    lambda s, f: statistics.value_profile(fx.g_qdt(s, f).cells).select(statistics.quality_score(True).alias("quality")),
    S.statement(f"{_QDT}, m AS (SELECT avg(value) AS a, var_pop(value) AS v, (max(value) - min(value))::DOUBLE AS r FROM g)", f"SELECT {_r('least(1.0, least(1.0, v / (r * r) * 100) * CASE WHEN sqrt(v) / abs(a) > 0.01 AND sqrt(v) / abs(a) < 10 THEN 1.1 ELSE 1.0 END)', 'quality')} FROM m"),
)
def _gaps(s: SparkSession, f: str) -> DataFrame:
    """Values of which some are null and some NaN."""
    v = F.col("value")
    return fx.g_qdt(s, f).cells.withColumn("value", F.when(v % 5 == 0, None).when(v % 5 == 1, float("nan")).otherwise(v.cast("double")))


_add("l8_completeness", lambda s, f: statistics.completeness(_gaps(s, f)).select("coverage"), S.statement(_QDT, f"SELECT {_r('avg(CASE WHEN value % 5 IN (0, 1) THEN 0.0 ELSE 1.0 END)', 'coverage')} FROM g"))
_PCT = ", ".join(_r(f"quantile_cont(value, {p / 100})", f"p{p}") for p in statistics.PERCENTILES)
_M2 = "(count(*) * sum(CAST(value AS DOUBLE) ** 2) - sum(CAST(value AS DOUBLE)) ** 2) / count(*) ** 2"
_add(
    "l9_statistics",
    lambda s, f: statistics.statistics(fx.g_qdt(s, f).cells).drop("grid_id", "skewness", "kurtosis"),
    S.statement(
        _QDT,
        f"SELECT count(*) AS count, {_r('avg(value)', 'mean')}, {_r('stddev_pop(value)', 'std')}, {_r('var_pop(value)', 'var')}, {_r('min(value)', 'min')}, {_r('max(value)', 'max')}, {_PCT}, {_r('quantile_cont(value, 0.5)', 'median')}, {_r('max(value) - min(value)', 'range')}, {_r('quantile_cont(value, 0.75) - quantile_cont(value, 0.25)', 'iqr')}, {_r('stddev_pop(value) / abs(avg(value))', 'cv')}, 0::BIGINT AS missing, 0.0::DOUBLE AS missing_share FROM g",
    ),
)
_MOM = "m AS (SELECT avg(value) AS a, stddev_pop(value) AS s FROM g)"
_add("l9_shape", lambda s, f: statistics.statistics(fx.g_qdt(s, f).cells).select("skewness", "kurtosis"), S.statement(f"{_QDT}, {_MOM}", f"SELECT {_r('avg(((value - a) / s) ** 3)', 'skewness')}, {_r('avg(((value - a) / s) ** 4) - 3', 'kurtosis')} FROM g CROSS JOIN m"))

# M: characteristics and strategy.
_add(
    "m1_characteristics",
    lambda s, f: strategy.characteristics(fx.g_ev(s, f)).withColumn("strategy", strategy.decide_column()).drop("grid_id"),
    S.statement(
        f"{_EV}, {S.steps(2, 2)}, {S.edges(2)}, {_GRAD}, mx AS (SELECT u, max(hv) AS m, bool_or(hu = hv AND abs(u - v) IN (1, 24)) AS same FROM e GROUP BY 1)",
        f"SELECT (SELECT count(*) FROM g) AS size, (SELECT min(value) FROM g) AS low, (SELECT max(value) FROM g) AS high, {_r('(SELECT avg(CASE WHEN same THEN 1.0 ELSE 0.0 END) FROM mx)', 'plateau_ratio')}, {_r('(SELECT stddev_pop(sqrt(g0 * g0 + g1 * g1)) FROM gr)', 'noise')}, {_r('(SELECT avg(CASE WHEN m <= value THEN 1.0 ELSE 0.0 END) FROM mx JOIN g ON g.cell_id = mx.u WHERE i0 BETWEEN 1 AND 28 AND i1 BETWEEN 1 AND 22)', 'peak_density')}, 'plateau_first' AS strategy",
    ),
)

FLAGSHIP = "f1_prominence"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)



