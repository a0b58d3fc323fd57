"""DuckDB SQL for the oracle check: the fixture views of
``tilespark.sources.fixtures`` and the operators, written as plain SQL over
the driver's tables.  Float arithmetic is spelled in the same order as in the
Spark expressions so both engines produce identical doubles."""

from __future__ import annotations

D = "CAST({} AS DOUBLE)".format
ULX, ULY, SX, SY = D(-180.0), D(90.0), D(0.25), D(-0.25)


def wx(xp: str) -> str:
    return f"({ULX} + ({xp}) * {SX})"


def wy(yp: str) -> str:
    return f"({ULY} + ({yp}) * {SY})"


CELLS_A = f"""cells_a AS (
  SELECT CAST(o_orderkey % 100 AS INTEGER) AS px, CAST(o_orderkey // 100 AS INTEGER) AS py,
         CASE WHEN o_orderstatus = 'P' THEN {D(255)} ELSE CAST(o_custkey % 25 AS DOUBLE) END AS v
  FROM orders)"""

CELLS_B = f"""cells_b AS (
  SELECT CAST(event_id % 100 AS INTEGER) AS px, CAST(event_id // 100 AS INTEGER) AS py,
         CAST(LEAST(CAST(FLOOR(value) AS INTEGER), 255) AS DOUBLE) AS v
  FROM events)"""

CELLS_F = """cells_f AS (
  SELECT CAST(vec_id AS INTEGER) AS py, CAST(g.i - 1 AS INTEGER) AS px, CAST(embedding[g.i] AS DOUBLE) AS v
  FROM embeddings, generate_series(1, len(embedding)) AS g(i))"""


#: Raster A's height, as in its header.
HEIGHT_A = "(SELECT max(o_orderkey) // 100 + 1 FROM orders)"
#: Every pixel of raster A; a pixel without a cell, or with NoData, has no value.
GRID_A = f"""grid_a AS (
  SELECT CAST(x.x AS INTEGER) AS px, CAST(y.y AS INTEGER) AS py, CASE WHEN c.v <> 255 THEN c.v END AS v
  FROM range(100) x(x), range({HEIGHT_A}) y(y) LEFT JOIN cells_a c ON c.px = x.x AND c.py = y.y)"""
STRETCH = f"(CAST({HEIGHT_A} AS DOUBLE) / {D(150.0)})"


def _diamond_edges(name: str, src: str, gid: str, nm: str, fp: str, cx: str, cy: str,
                   rx: float, ry: float, stretch: str | None = None) -> str:
    verts = f"""{name}_z AS (
  SELECT CAST({gid} AS BIGINT) AS gid, {nm} AS name, CAST({fp} AS INTEGER) AS statefp,
         CAST({cx} AS DOUBLE) AS cx, CAST({cy} AS DOUBLE) AS cy FROM {src})"""
    dy = f"{D(ry)} * {stretch}" if stretch else D(ry)
    W = (wx(f"cx - {D(rx)}"), wy("cy"))
    N = (wx("cx"), wy(f"cy - {dy}"))
    E = (wx(f"cx + {D(rx)}"), wy("cy"))
    S = (wx("cx"), wy(f"cy + {dy}"))
    parts = []
    for a, b in ((W, N), (N, E), (E, S), (S, W)):
        parts.append(f"SELECT gid, name, statefp, {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2 FROM {name}_z")
    return verts + f",\n{name} AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


EDGES_STATES = _diamond_edges("edges_states", "nation", "n_nationkey", "n_name", "n_regionkey",
                              "10 + 20 * (n_nationkey % 5)", f"CAST(15 + 30 * (n_nationkey // 5) AS DOUBLE) * {STRETCH}",
                              9.25, 13.25, STRETCH)
EDGES_TRACTS = _diamond_edges("edges_tracts", "supplier", "s_suppkey", "s_name", "s_nationkey",
                              "5 + 10 * (s_suppkey % 10)",
                              f"{D(7.25)} + {D(15.0)} * CAST(s_suppkey // 10 AS DOUBLE)", 4.3, 6.9)


def _rect_edges() -> str:
    x0 = f"({D(20.0)} * CAST(r_regionkey AS DOUBLE) + {D(0.25)})"
    x1 = f"({D(20.0)} * CAST(r_regionkey AS DOUBLE) + {D(19.75)})"
    y0, y1 = D(-1.0), f"(CAST({HEIGHT_A} AS DOUBLE) + {D(1.0)})"
    a, b, c, d = (x0, y0), (x1, y0), (x1, y1), (x0, y1)
    parts = []
    for p, q in ((a, b), (b, c), (c, d), (d, a)):
        parts.append(f"SELECT CAST(r_regionkey AS BIGINT) AS gid, r_name AS name, CAST(r_regionkey AS INTEGER) AS statefp, "
                     f"{wx(p[0])} AS x1, {wy(p[1])} AS y1, {wx(q[0])} AS x2, {wy(q[1])} AS y2 FROM region")
    return "edges_regions AS (\n  " + "\n  UNION ALL ".join(parts) + ")"


EDGES_REGIONS = _rect_edges()
EDGES = {"states": EDGES_STATES, "tracts": EDGES_TRACTS, "regions": EDGES_REGIONS}


def yc(py: str) -> str:
    return f"({ULY} + ({py} + {D(0.5)}) * {SY})"


def xc(px: str) -> str:
    return f"({ULX} + ({px} + {D(0.5)}) * {SX})"


def inside(cells: str, edges: str, name: str = "inside") -> str:
    """(gid, name, statefp, px, py, v) for every pixel centre inside a zone (even-odd)."""
    y, x = yc("c.py"), xc("c.px")
    return f"""{name} AS (
  SELECT e.gid, e.name, e.statefp, c.px, c.py, c.v
  FROM {cells} c JOIN {edges} e
    ON {y} >= LEAST(e.y1, e.y2) AND {y} <= GREATEST(e.y1, e.y2)
  WHERE ((e.y1 > {y}) <> (e.y2 > {y}))
    AND (e.x1 + ({y} - e.y1) * (e.x2 - e.x1) / (e.y2 - e.y1)) > {x}
  GROUP BY e.gid, e.name, e.statefp, c.px, c.py, c.v
  HAVING count(*) % 2 = 1)"""


def tiles_sql(cells: str, t: int, width: int, name: str = "tiles") -> str:
    """Tile key columns (no pixel arrays) of a raster cut into t x t tiles."""
    return f"""{name} AS (
  SELECT tile_col, tile_row, CAST(tile_row * {-(-width // t)} + tile_col + 1 AS BIGINT) AS rid,
         tile_col * {t} AS px0, tile_row * {t} AS py0,
         CAST(LEAST({t}, {width} - tile_col * {t}) AS INTEGER) AS width,
         CAST(LEAST({t}, (SELECT max(py) + 1 FROM {cells}) - tile_row * {t}) AS INTEGER) AS height
  FROM (SELECT DISTINCT CAST(px // {t} AS INTEGER) AS tile_col, CAST(py // {t} AS INTEGER) AS tile_row FROM {cells}))"""


def edge_hits(tiles: str, edges: str, name: str = "edge_hits") -> str:
    """(gid, rid) where a ring edge meets the closed tile footprint."""
    rx0 = wx("t.px0")
    rx1 = f"({wx('t.px0')} + t.width * {SX})"
    ry1 = wy("t.py0")
    ry0 = f"({wy('t.py0')} + t.height * {SY})"
    def side(cx, cy):
        return f"((e.x2 - e.x1) * ({cy} - e.y1) - (e.y2 - e.y1) * ({cx} - e.x1))"
    s = [side(rx0, ry0), side(rx1, ry0), side(rx1, ry1), side(rx0, ry1)]
    return f"""{name} AS (
  SELECT DISTINCT e.gid, e.name, e.statefp, t.rid
  FROM {edges} e JOIN {tiles} t
    ON GREATEST(e.x1, e.x2) >= {rx0} AND LEAST(e.x1, e.x2) <= {rx1}
   AND GREATEST(e.y1, e.y2) >= {ry0} AND LEAST(e.y1, e.y2) <= {ry1}
  WHERE NOT ({' AND '.join(x + ' > 0' for x in s)})
    AND NOT ({' AND '.join(x + ' < 0' for x in s)}))"""


def r6(e: str) -> str:
    return f"ROUND({e}, 6)"
