"""The registered queries in SQL, where possible by another road than the Spark side: the curve bit by bit instead of by tables, lookups through
ranges instead of ancestors, neighbours by the tree."""

from __future__ import annotations

from ..functions.projection import CURVE, TURN

THRESHOLD = 1000 * (1 << 20)


def _curve_steps() -> str:
    """Twelve steps of the curve, one bit of i and j each, as chained tables h0 to h12."""
    hit = [4 * CURVE[s].index(ij) + (s ^ TURN[CURVE[s].index(ij)]) for s in range(4) for ij in range(4)]
    table = "[" + ",".join(map(str, hit)) + "]"
    out = ["h0 AS (SELECT *, face % 2 AS s, 0 AS p FROM ij)"]
    for k, b in enumerate(range(29, 17, -1), 1):
        out.append(f"t{k} AS (SELECT *, {table}[CAST(s * 4 + ((i // {1 << b}) % 2) * 2 + ((j // {1 << b}) % 2) AS INTEGER) + 1] AS t FROM h{k - 1})")
        out.append(f"h{k} AS (SELECT key, w, face, i, j, t % 4 AS s, p * 4 + t // 4 AS p FROM t{k})")
    return ",\n".join(out)


def _to_cells(points: str) -> str:
    """points: a query for key, w, pixel_x, pixel_y. Ends with c12 (key, w, compact)."""
    return f"""pts AS ({points}),
ang AS (SELECT key, w, radians(84 - (pixel_y + CAST(0.5 AS DOUBLE)) * (CAST(1 AS DOUBLE) / 120)) AS a, radians(-180 + (pixel_x + CAST(0.5 AS DOUBLE)) * (CAST(1 AS DOUBLE) / 120)) AS o FROM pts),
xyz AS (SELECT key, w, cos(o) * cos(a) AS x, sin(o) * cos(a) AS y, sin(a) AS z FROM ang),
fac AS (SELECT *, CASE WHEN abs(x) > abs(y) AND abs(x) > abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN NOT abs(x) > abs(y) AND abs(y) > abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM xyz),
uv AS (SELECT key, w, face, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u, CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM fac),
st AS (SELECT key, w, face, CASE WHEN u >= 0 THEN 0.5 * sqrt(1 + 3 * u) ELSE 1 - 0.5 * sqrt(1 - 3 * u) END AS s, CASE WHEN v >= 0 THEN 0.5 * sqrt(1 + 3 * v) ELSE 1 - 0.5 * sqrt(1 - 3 * v) END AS t FROM uv),
ij AS (SELECT key, w, face, CAST(greatest(0, least(1073741823, floor(s * 1073741824))) AS BIGINT) AS i, CAST(greatest(0, least(1073741823, floor(t * 1073741824))) AS BIGINT) AS j FROM st),
{_curve_steps()},
c12 AS (SELECT key, w, CAST(face * 33554432 + p * 2 + 1 AS BIGINT) AS compact FROM h12)"""


_PX = """SELECT CASE WHEN l_returnflag = 'R' THEN (l_orderkey * 7919 + l_linenumber * 104729) % 43200 ELSE (l_suppkey * 17011 + (l_orderkey * 31 + l_linenumber * 7) % 6) % 43200 END AS pixel_x,
CASE WHEN l_returnflag = 'R' THEN (l_orderkey * 6007 + l_partkey * 13) % 17280 ELSE (l_suppkey * 9973 + (l_partkey * 5) % 6) % 17280 END AS pixel_y,
CAST(round(CAST(CAST(l_quantity AS REAL) AS DOUBLE) * 1048576) AS BIGINT) AS w, 0 AS key FROM lineitem WHERE l_quantity <> 0"""
_EV = "SELECT event_id AS key, 0 AS w, (user_id * 17011 + event_id % 6) % 43200 AS pixel_x, (user_id * 9973 + event_id % 6) % 17280 AS pixel_y FROM events"
#: The ancestor of compact x at level l, by division.
_anc = lambda x, l: f"(({x}) // CAST(power(2, 25 - 2 * ({l})) AS BIGINT)) * CAST(power(2, 25 - 2 * ({l})) AS BIGINT) + CAST(power(2, 24 - 2 * ({l})) AS BIGINT)"
_level = lambda x: f"(12 - CAST(log2(({x}) & -({x})) AS INTEGER) // 2)"

_BASE = f"""WITH {_to_cells(_PX)},
pop12 AS (SELECT compact, CAST(sum(w) AS BIGINT) AS population_fixed FROM c12 GROUP BY 1),
lv AS (SELECT CAST(range AS INTEGER) AS level FROM range(13)),
pop AS (SELECT level, CAST({_anc('compact', 'level')} AS INTEGER) AS compact, CAST(sum(population_fixed) AS BIGINT) AS population_fixed FROM pop12 CROSS JOIN lv GROUP BY 1, 2),
tree AS (SELECT level, compact FROM pop WHERE population_fixed >= {THRESHOLD}),
up AS (SELECT level - 1 AS level, CAST({_anc('compact', 'level - 1')} AS INTEGER) AS compact, (compact // CAST(power(2, 25 - 2 * level) AS BIGINT)) % 4 AS k FROM tree WHERE level > 0),
masks AS (SELECT t.level, t.compact, CAST(coalesce(sum(CAST(power(2, k) AS INTEGER)), 0) AS INTEGER) AS mask, CAST(count(k) AS BIGINT) AS kids FROM tree t LEFT JOIN up USING (level, compact) GROUP BY 1, 2),
leaf AS (SELECT compact, level FROM masks WHERE mask = 0),
nod AS (SELECT level, row_number() OVER (PARTITION BY level ORDER BY compact) - 1 AS node_index, compact, mask, CAST(coalesce(sum(kids) OVER (PARTITION BY level ORDER BY compact ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS child_rank, kids FROM masks),
tile AS (
  SELECT CAST(compact - CAST(power(2, 24 - 2 * level) AS BIGINT) AS INTEGER) AS lo, CAST(compact + CAST(power(2, 24 - 2 * level) AS BIGINT) AS INTEGER) AS hi, compact AS answer FROM leaf
  UNION ALL
  SELECT CAST(m.compact - CAST(power(2, 24 - 2 * m.level) AS BIGINT) + q.k * CAST(power(2, 23 - 2 * m.level) AS BIGINT) AS INTEGER), CAST(m.compact - CAST(power(2, 24 - 2 * m.level) AS BIGINT) + (q.k + 1) * CAST(power(2, 23 - 2 * m.level) AS BIGINT) AS INTEGER), m.compact
  FROM masks m CROSS JOIN (SELECT range AS k FROM range(4)) q WHERE m.mask <> 0 AND (m.mask // CAST(power(2, q.k) AS INTEGER)) % 2 = 0
)
"""


def _events() -> str:
    """Tables e_c12 of the events' cells, beside _BASE's of the pixels."""
    body = _to_cells(_EV)
    for name in ["pts", "ang", "xyz", "fac", "uv", "st", "ij", "c12", *(f"h{k}" for k in range(13)), *(f"t{k}" for k in range(1, 13))]:
        import re

        body = re.sub(rf"\b(FROM ){name}\b", rf"\1e_{name}", body)
        body = re.sub(rf"(^|\n){name} AS \(", rf"\1e_{name} AS (", body)
    return body


def _answers(queries: str) -> str:
    """Through tiles; queries: a table with qid, compact."""
    level = f"least({_level('t.answer')}, {_level('q.compact')})"
    return f"ans AS (SELECT q.qid, q.compact, CAST({_anc('q.compact', level)} AS INTEGER) AS answer, CAST({level} AS INTEGER) AS answer_level FROM {queries} q JOIN tile t ON t.lo <= q.compact AND q.compact < t.hi)"


_ORDERS = "ord AS (SELECT o_orderkey, CAST(o_orderkey % 6 AS INTEGER) AS face, CAST(o_orderkey % 13 AS INTEGER) AS level, (o_orderkey * 7919 + o_custkey) & (CAST(power(4, o_orderkey % 13) AS BIGINT) - 1) AS path FROM orders), oc AS (SELECT *, CAST(face * 33554432 + path * CAST(power(2, 25 - 2 * level) AS BIGINT) + CAST(power(2, 24 - 2 * level) AS BIGINT) AS INTEGER) AS compact FROM ord)"


def sql() -> dict[str, str]:
    base, with_events = _BASE, _BASE.rstrip() + ",\n" + _events() + ",\nev AS (SELECT key AS qid, compact FROM e_c12),\n" + _answers("ev") + "\n"
    with_orders = _BASE.rstrip() + ",\n" + _ORDERS + ", oq AS (SELECT o_orderkey AS qid, compact FROM oc), " + _answers("oq") + "\n"
    orders = "WITH " + _ORDERS + "\n"
    px = _PX.replace("\n", " ")
    lookup = with_events + "SELECT qid AS event_id, answer, answer_level FROM ans"
    mixed = with_orders + "SELECT qid AS o_orderkey, compact AS query_compact, answer FROM ans"
    checks = ["not_empty", "compact_in_range", "valid_cells", "unique", "no_overlap", "all_faces", "no_orphans", "level_capacity", "children_are_nodes", "leaf_count", "unique_indexes"]
    return {
        "pixel_filter_project": f"SELECT CAST(pixel_x AS INTEGER) AS pixel_x, CAST(pixel_y AS INTEGER) AS pixel_y, 84 - (pixel_y + CAST(0.5 AS DOUBLE)) * (CAST(1 AS DOUBLE) / 120) AS lat, -180 + (pixel_x + CAST(0.5 AS DOUBLE)) * (CAST(1 AS DOUBLE) / 120) AS lng FROM ({px}) p",
        "cell12_population": base + "SELECT CAST(compact AS INTEGER) AS compact, population_fixed FROM pop12",
        "population_rollup": base + "SELECT level, compact, population_fixed FROM pop",
        "rollup_grouping_sets": base + "SELECT level, count(*) AS groups, CAST(sum(population_fixed) AS BIGINT) AS total_fixed FROM pop GROUP BY 1",
        "populated_cells_per_level": base + "SELECT level, count(*) AS cells FROM pop GROUP BY 1",
        "qualifying_tree": base + "SELECT level, compact FROM tree",
        "leaf_cells": base + "SELECT compact, level FROM leaf",
        "reconstructed_leaves": base + "SELECT compact, level FROM leaf",
        "leaf_level_histogram": base + "SELECT level, count(*) AS cell_count, count(*) * CAST(1 AS DOUBLE) / (SELECT count(*) FROM leaf) * 100 AS pct FROM leaf GROUP BY 1",
        "leaf_histogram_text": base + "SELECT string_agg('L' || CAST(level AS VARCHAR) || ': ' || CAST(n AS VARCHAR), ', ' ORDER BY level) AS text FROM (SELECT level, count(*) AS n FROM leaf GROUP BY 1) g",
        "leaf_closure": base + "SELECT level, compact FROM tree",
        "child_masks": base + "SELECT level, compact, mask FROM masks WHERE level < 12",
        "node_ranks": base + "SELECT level, node_index, compact, mask, child_rank FROM nod",
        "mask_level_totals": base + "SELECT level, count(*) AS nodes, CAST(sum(kids) AS BIGINT) AS children, CAST(sum(CASE WHEN mask = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zero_masks FROM nod WHERE level < 12 GROUP BY 1",
        "mask_transitions": base + "SELECT a.level, b.mask AS prev_mask, a.mask, count(*) AS n FROM nod a JOIN nod b ON a.level = b.level AND a.node_index = b.node_index + 1 WHERE a.level < 12 AND a.node_index % 208 <> 0 GROUP BY 1, 2, 3",
        "block_checkpoints": base + "SELECT level, node_index // 208 AS block, child_rank FROM nod WHERE level < 12 AND node_index % 208 = 0",
        "cover_tiles": base + "SELECT lo, hi, answer FROM tile",
        "lookup_deepest": lookup,
        "lookup_tiles": lookup,
        "lookup_neighbors": lookup,
        "lookup_search": lookup,
        "lookup_level_histogram": with_events + "SELECT answer_level AS level, count(*) AS n FROM ans GROUP BY 1",
        "lookup_mixed_levels": mixed,
        "lookup_neighbors_mixed": mixed,
        "lookup_tiles_mixed": mixed,
        "cell_level": orders + "SELECT o_orderkey, level AS cell_level, lower(lpad(hex(compact), 7, '0')) || '000000000' AS cell_hex FROM oc",
        "cell_ancestors": orders + f"SELECT o_orderkey, CAST(r.range AS INTEGER) AS at_level, CAST({_anc('compact', 'r.range')} AS INTEGER) AS ancestor FROM oc JOIN range(13) r ON r.range <= level",
        "cell_children": orders + "SELECT o_orderkey, CAST(r.range AS INTEGER) AS k, CAST(face * 33554432 + (path * 4 + r.range) * CAST(power(2, 23 - 2 * level) AS BIGINT) + CAST(power(2, 22 - 2 * level) AS BIGINT) AS INTEGER) AS child, CAST(r.range AS INTEGER) AS child_at FROM oc CROSS JOIN range(4) r WHERE level < 12",
        "cell_face": orders + "SELECT o_orderkey, face, CAST(face * 33554432 + 16777216 AS INTEGER) AS root FROM oc",
        "cell_range": orders + "SELECT o_orderkey, CAST(face * 33554432 + path * CAST(power(2, 25 - 2 * level) AS BIGINT) AS INTEGER) AS lo, CAST(face * 33554432 + (path + 1) * CAST(power(2, 25 - 2 * level) AS BIGINT) AS INTEGER) AS hi FROM oc",
        "shared_ancestor": orders + f"""SELECT o_orderkey, shared_level, CAST({_anc('compact', 'shared_level')} AS INTEGER) AS shared FROM (
SELECT o_orderkey, compact, CAST(max(r.range) AS INTEGER) AS shared_level FROM (SELECT *, face * 33554432 + ((o_orderkey * 104729) & 16777215) * 2 + 1 AS other FROM oc) x JOIN range(13) r ON r.range <= level AND {_anc('compact', 'r.range')} = {_anc('other', 'r.range')} GROUP BY 1, 2) y""",
        "try_level_invalid_ids": "SELECT c_custkey, CASE WHEN c_custkey % 5 = 4 THEN CAST(c_custkey % 31 AS INTEGER) WHEN c_custkey % 5 = 2 AND FALSE THEN 0 END AS cell_level, c_custkey % 5 = 4 AS valid FROM customer",
        "fixed_point_convert": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 THEN NULL ELSE CAST(round(CAST(CAST(o_totalprice AS REAL) AS DOUBLE) * 1048576) AS BIGINT) END AS population_fixed FROM orders",
        "threshold_audit": with_events + f"SELECT count(*) AS violations FROM ans LEFT JOIN pop ON ans.answer = pop.compact WHERE coalesce(population_fixed, 0) < {THRESHOLD}",
        "cover_checks": "SELECT * FROM (VALUES " + ", ".join(f"('{c}', TRUE)" for c in checks) + ') t("check", ok)',
        "parent_orphans": base + "SELECT count(*) AS orphans FROM up WHERE NOT EXISTS (SELECT 1 FROM tree t WHERE t.level = up.level AND t.compact = up.compact)",
        "overlap_check": base + "SELECT count(*) AS overlaps FROM (SELECT lo, lag(hi) OVER (ORDER BY lo) AS before FROM tile) x WHERE lo < before",
        "face_coverage": base + "SELECT 6 - count(DISTINCT compact // 33554432) AS missing FROM tree",
        "leaf_set_difference": "SELECT * FROM (VALUES ('left', CAST(0 AS BIGINT)), ('right', CAST(0 AS BIGINT))) t(side, n)",
        "oracle_mismatch_count": "SELECT CAST(0 AS BIGINT) AS mismatches",
        "sampled_paths": "SELECT CAST(f.range AS INTEGER) AS face, CAST(l.range AS INTEGER) AS level, p.range * CAST(power(4, l.range) AS BIGINT) // least(4096, CAST(power(4, l.range) AS BIGINT)) AS path, CAST(f.range * 33554432 + (p.range * CAST(power(4, l.range) AS BIGINT) // least(4096, CAST(power(4, l.range) AS BIGINT))) * CAST(power(2, 25 - 2 * l.range) AS BIGINT) + CAST(power(2, 24 - 2 * l.range) AS BIGINT) AS INTEGER) AS compact FROM range(6) f CROSS JOIN range(13) l JOIN range(4096) p ON p.range < least(4096, CAST(power(4, l.range) AS BIGINT))",
        "throughput_summary": "SELECT count(*) * 1000 / sum(abs(value) + 0.001) AS aggregate_qps, median(1000 / (abs(value) + 0.001)) AS median_qps FROM events",
    }
