"""Pieces of DuckDB SQL from which the queries' oracles are put together."""

from __future__ import annotations

QD_SRC = "SELECT CAST(l_quantity AS BIGINT) - 1 AS x0, CAST(round(l_discount * 100) AS BIGINT) AS x1, count(*) AS v FROM lineitem GROUP BY 1, 2"
QDT_SRC = "SELECT CAST(l_quantity AS BIGINT) - 1 AS x0, CAST(round(l_discount * 100) AS BIGINT) AS x1, CAST(round(l_tax * 100) AS BIGINT) AS x2, count(*) AS v FROM lineitem GROUP BY 1, 2, 3"
EV_SRC = "SELECT date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS x0, hour(ts) AS x1, count(*) AS v FROM events GROUP BY 1, 2"
DAY_SRC = "SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS x0, count(*) AS v FROM orders GROUP BY 1"
REV_SRC = "SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS x0, CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS v FROM orders GROUP BY 1"


def grid(name: str, shape: tuple[int, ...], src: str) -> str:
    """A CTE of dense cells ``i0 .., cell_id, value``."""
    n = len(shape)
    stride = [1] * n
    for d in range(n - 2, -1, -1):
        stride[d] = stride[d + 1] * shape[d + 1]
    axes = " CROSS JOIN ".join(f"range({s}) a{d}(i)" for d, s in enumerate(shape))
    cols = ", ".join(f"CAST(a{d}.i AS BIGINT) AS i{d}" for d in range(n))
    cell = " + ".join(f"a{d}.i * {stride[d]}" for d in range(n))
    on = " AND ".join(f"c.x{d} = a{d}.i" for d in range(n))
    return f"{name} AS (SELECT {cols}, CAST({cell} AS BIGINT) AS cell_id, CAST(coalesce(c.v, 0) AS BIGINT) AS value FROM {axes} LEFT JOIN ({src}) c ON {on})"


def steps(n: int, k: int) -> str:
    """A CTE ``st`` of the neighbour steps of k-connectivity."""
    axes = " CROSS JOIN ".join(f"range(-1, 2) r{d}(x)" for d in range(n))
    total = " + ".join(f"abs(r{d}.x)" for d in range(n))
    cols = ", ".join(f"r{d}.x AS s{d}" for d in range(n))
    return f"st AS (SELECT {cols} FROM {axes} WHERE {total} BETWEEN 1 AND {k})"


def edges(n: int, cells: str = "g", name: str = "e", st: str = "st") -> str:
    """A CTE of neighbour pairs ``u, hu, v, hv``, joined through shifted positions."""
    shifted = ", ".join(f"a.i{d} + s.s{d} AS t{d}" for d in range(n))
    on = " AND ".join(f"b.i{d} = a.t{d}" for d in range(n))
    return f"{name} AS (SELECT a.cell_id AS u, a.value AS hu, b.cell_id AS v, b.value AS hv FROM (SELECT a.cell_id, a.value, {shifted} FROM {cells} a CROSS JOIN {st} s) a JOIN {cells} b ON {on})"


#: Plateau labels: the smallest cell reached over edges of equal height.
LABELS = """lab(u, l) USING KEY (u) AS (
  SELECT cell_id, cell_id FROM g
  UNION
  SELECT e.v, min(lab.l) FROM lab JOIN e ON e.u = lab.u AND e.hu = e.hv JOIN recurring.lab cur ON cur.u = e.v WHERE lab.l < cur.l GROUP BY e.v
)"""
#: Plateaus with their highest neighbour, and the cells of regional maxima.
PLATEAUS = """pt AS (SELECT lab.l AS plateau_id, max(hu) AS height, max(hv) AS top FROM lab JOIN e ON e.u = lab.u GROUP BY 1),
pc AS (SELECT pt.plateau_id AS peak_id, g.* FROM pt JOIN lab ON lab.l = pt.plateau_id JOIN g ON g.cell_id = lab.u WHERE pt.top <= pt.height)"""


def peaks(n: int, shape: tuple[int, ...], src: str, k: int = 1) -> str:
    """Everything up to ``pk``: peak_id, height, area, c0 .., on_face; ``pc`` has their cells."""
    centre = ", ".join(f"avg(i{d}) AS c{d}" for d in range(n))
    face = " OR ".join(f"i{d} = 0 OR i{d} = {s - 1}" for d, s in enumerate(shape))
    pk = f"pk AS (SELECT peak_id, any_value(value) AS height, count(*) AS area, {centre}, bool_or({face}) AS on_face FROM pc GROUP BY 1)"
    return ",\n".join([grid("g", shape, src), steps(n, k), edges(n), LABELS, PLATEAUS, pk])


#: Best bottleneck from each peak to every cell that it can reach without passing a higher one.
FLOOD = """fl(p, c, h, b) USING KEY (p, c) AS (
  SELECT peak_id, cell_id, value, value FROM pc
  UNION
  SELECT fl.p, e.v, fl.h, max(least(fl.b, e.hv)) FROM fl JOIN e ON e.u = fl.c LEFT JOIN recurring.fl cur ON cur.p = fl.p AND cur.c = e.v
  WHERE e.hu <= fl.h AND (cur.b IS NULL OR least(fl.b, e.hv) > cur.b) GROUP BY fl.p, e.v, fl.h
),
sd AS (SELECT fl.p AS peak_id, max(fl.b) AS saddle_height FROM fl JOIN g ON g.cell_id = fl.c WHERE g.value > fl.h GROUP BY 1)"""


def statement(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"
