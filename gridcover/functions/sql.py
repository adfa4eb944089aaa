"""The cell functions for SQL text: temporary functions of a session, each a RETURN expression that Catalyst inlines.

They say the same as the column functions of `cells`; a test compares them. Names that begin with try_ give null for invalid ids.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Parameters, type and expression of each function; later ones use earlier ones.
FUNCTIONS = {
    "cell_trailing_zeros": ("id BIGINT", "INT", "CASE WHEN id = 0 THEN 64 WHEN id = -9223372036854775808 THEN 63 ELSE bit_count((id & -id) - 1) END"),
    "cell_face": ("id BIGINT", "INT", "CAST(shiftrightunsigned(id, 61) AS INT)"),
    "cell_is_valid": ("id BIGINT", "BOOLEAN", "id IS NOT NULL AND id <> 0 AND cell_face(id) < 6 AND cell_trailing_zeros(id) <= 60 AND cell_trailing_zeros(id) % 2 = 0"),
    "try_cell_level": ("id BIGINT", "INT", "CASE WHEN cell_is_valid(id) THEN (60 - cell_trailing_zeros(id)) div 2 END"),
    "cell_level": ("id BIGINT", "INT", "CASE WHEN id IS NULL OR cell_is_valid(id) THEN try_cell_level(id) ELSE CAST(raise_error(concat('not a cell id: ', lower(lpad(hex(id), 16, '0')))) AS INT) END"),
    "cell_ancestor_unchecked": ("id BIGINT, at INT", "BIGINT", "shiftleft(shiftrightunsigned(id, 60 - 2 * at), 60 - 2 * at) | shiftleft(1L, 60 - 2 * at)"),
    "try_cell_ancestor": ("id BIGINT, at INT", "BIGINT", "CASE WHEN at BETWEEN 0 AND try_cell_level(id) THEN cell_ancestor_unchecked(id, at) END"),
    "cell_ancestor": ("id BIGINT, at INT", "BIGINT", "CASE WHEN id IS NULL OR at BETWEEN 0 AND cell_level(id) THEN cell_ancestor_unchecked(id, at) ELSE CAST(raise_error(concat('no ancestor at level ', at)) AS BIGINT) END"),
    "cell_child_index": ("id BIGINT, parent_level INT", "INT", "CAST(shiftrightunsigned(id, 59 - 2 * parent_level) & 3 AS INT)"),
    "cell_children": ("id BIGINT", "ARRAY<BIGINT>", "CASE WHEN cell_level(id) < 30 THEN transform(sequence(0, 3), k -> (id ^ (id & -id)) | shiftleft(CAST(2 * k + 1 AS BIGINT), cell_trailing_zeros(id) - 2)) WHEN id IS NOT NULL THEN CAST(raise_error('no children at this level') AS ARRAY<BIGINT>) END"),
    "cell_face_root": ("face INT", "BIGINT", "shiftleft(CAST(face AS BIGINT), 61) | shiftleft(1L, 60)"),
    "cell_from_path": ("face INT, at INT, path BIGINT", "BIGINT", "shiftleft(CAST(face AS BIGINT), 61) | shiftleft(path, 61 - 2 * at) | shiftleft(1L, 60 - 2 * at)"),
    "cell_range_low": ("id BIGINT", "BIGINT", "id - (shiftleft(1L, cell_trailing_zeros(id)) - 1)"),
    "cell_range_high": ("id BIGINT", "BIGINT", "id + (shiftleft(1L, cell_trailing_zeros(id)) - 1)"),
    "cell_hex": ("id BIGINT", "STRING", "lower(lpad(hex(id), 16, '0'))"),
    "cell_to_compact": ("id BIGINT", "INT", "CAST(shiftrightunsigned(cell_ancestor_unchecked(id, least((60 - cell_trailing_zeros(id)) div 2, 12)), 36) AS INT)"),
    "cell_from_compact": ("compact INT", "BIGINT", "shiftleft(CAST(compact AS BIGINT), 36)"),
    "compact_level": ("compact INT", "INT", "12 - bit_count((compact & -compact) - 1) div 2"),
    "compact_ancestor": ("compact INT, at INT", "INT", "shiftleft(shiftrightunsigned(compact, 24 - 2 * at), 24 - 2 * at) | shiftleft(1, 24 - 2 * at)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    for name, (parameters, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
