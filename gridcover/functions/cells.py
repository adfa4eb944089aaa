"""Column functions over cell ids.

A cell id has 64 bits: face (3), two bits of path per level, then a single 1; Spark holds it as a signed long. Levels 0 to 12 also
have a compact id, the id without its lowest 36 bits: a non-negative int, whose order is the order along the curve. All tree work is
done on compact ids; long ids only come in and go out.

Functions named try_* give null where their strict counterpart raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the cell scheme.
MAX_LEVEL, MAX_COVER_LEVEL, FACES = 30, 12, 6
BITS_PER_LEVEL, POSITION_BITS, FACE_BITS, FACE_SHIFT, COMPACT_SHIFT = 2, 60, 3, 61, 36
MAX_COMPACT = 0x0FFFFFFF
_LEAST = -(1 << 63)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _as(c: Column | str | int, kind: str) -> Column:
    return (F.lit(c) if isinstance(c, int) else col(c)).cast(kind)


def shl(value: Column, by: Column | int) -> Column:
    return F.call_function("shiftleft", value, _as(by, "int"))


def shr(value: Column, by: Column | int) -> Column:
    """Unsigned."""
    return F.call_function("shiftrightunsigned", value, _as(by, "int"))


def _long(v: int) -> Column:
    return F.lit(v).cast("long")


def trailing_zeros(x: Column | str) -> Column:
    """Of a long; 64 for 0. The least long has no negation, so that it is told apart."""
    x = _as(x, "long")
    y = F.nullif(x, F.lit(_LEAST))
    return F.when(x == 0, 64).when(x == _LEAST, 63).otherwise(F.bit_count(y.bitwiseAND(-y) - 1))


def significant_bits(x: Column) -> Column:
    """How many bits a number takes, 0 for 0 (numbers from 0)."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x)))


def required_width(x: Column | str) -> Column:
    """Bits for numbers up to x, at least one."""
    return F.greatest(significant_bits(_as(x, "long")), F.lit(1))


def maximum_nodes(level: Column | str) -> Column:
    return 6 * shl(_long(1), 2 * _as(level, "int"))


# -- long ids


def face(cell: Column | str) -> Column:
    return shr(_as(cell, "long"), FACE_SHIFT).cast("int")


def _problem(cell: Column) -> Column:
    """What is wrong with an id, null if nothing is."""
    zeros = trailing_zeros(cell)
    return (
        F.when(cell.isNull(), F.lit(None).cast("string"))
        .when(cell == 0, "cell id is zero")
        .when(face(cell) >= FACES, "cell id has an invalid face")
        .when(zeros > POSITION_BITS, "cell id has its marker in the face bits")
        .when(zeros % 2 == 1, "cell id has a misplaced marker")
    )


def is_valid(cell: Column | str) -> Column:
    cell = _as(cell, "long")
    return cell.isNotNull() & _problem(cell).isNull()


def _level(cell: Column) -> Column:
    return ((POSITION_BITS - trailing_zeros(cell)) / 2).cast("int")


def try_level(cell: Column | str) -> Column:
    cell = _as(cell, "long")
    return F.when(is_valid(cell), _level(cell))


def level(cell: Column | str) -> Column:
    cell = _as(cell, "long")
    wrong = _problem(cell)
    return F.when(wrong.isNotNull(), F.raise_error(F.concat(wrong, F.lit(": "), hex_id(cell))).cast("int")).otherwise(_level(cell))


def _ancestor(cell: Column, at: Column) -> Column:
    marker = POSITION_BITS - 2 * at
    return shl(shr(cell, marker), marker).bitwiseOR(shl(_long(1), marker))


def try_ancestor(cell: Column | str, at: Column | int | str) -> Column:
    cell, at = _as(cell, "long"), _as(at, "int")
    return F.when(is_valid(cell) & (at >= 0) & (at <= _level(cell)), _ancestor(cell, at))


def ancestor(cell: Column | str, at: Column | int | str) -> Column:
    """The cell that contains cell at a level not below its own."""
    cell, at = _as(cell, "long"), _as(at, "int")
    wrong = F.when((at < 0) | (at > level(cell)), F.raise_error(F.concat(F.lit("no ancestor at level "), at)).cast("long"))
    return F.when(wrong.isNotNull(), wrong).otherwise(_ancestor(cell, at))


def parent(cell: Column | str, at: Column | int | str) -> Column:
    """Another name for ancestor: the level is that of the result."""
    return ancestor(cell, at)


def children(cell: Column | str, at: Column | int | str | None = None) -> Column:
    """The four children, in the order of the curve. `at`, if given, must be the cell's level."""
    cell = _as(cell, "long")
    own = level(cell)
    bad = own >= MAX_LEVEL if at is None else (own >= MAX_LEVEL) | (own != _as(at, "int"))
    marker = POSITION_BITS - 2 * own
    base = cell.bitwiseXOR(shl(_long(1), marker))
    kids = F.array(*[base.bitwiseOR(shl(_long(2 * k + 1), marker - 2)) for k in range(4)])
    return F.when(bad, F.raise_error(F.lit("no children at this level")).cast("array<bigint>")).otherwise(kids)


def child_index(cell: Column | str, parent_level: Column | int | str) -> Column:
    """Which child of its ancestor at parent_level contains the cell."""
    return shr(_as(cell, "long"), POSITION_BITS - 2 * _as(parent_level, "int") - 1).bitwiseAND(_long(3)).cast("int")


def face_root(f: Column | int | str) -> Column:
    return shl(_as(f, "long"), FACE_SHIFT).bitwiseOR(_long(1 << POSITION_BITS))


def from_path(f: Column | str, at: Column | str, path: Column | str) -> Column:
    """The cell of a face at a level, by its position along the curve."""
    marker = POSITION_BITS - 2 * _as(at, "int")
    return shl(_as(f, "long"), FACE_SHIFT).bitwiseOR(shl(_as(path, "long"), marker + 1)).bitwiseOR(shl(_long(1), marker))


def lowest_bit(cell: Column | str) -> Column:
    return shl(_long(1), trailing_zeros(cell))


def cell_range(cell: Column | str) -> Column:
    """First and last level-30 cell inside, as a struct (lo, hi)."""
    cell = _as(cell, "long")
    return F.struct((cell - (lowest_bit(cell) - 1)).alias("lo"), (cell + (lowest_bit(cell) - 1)).alias("hi"))


def descendant_30(cell: Column | str, random: Column | str) -> Column:
    """A level-30 cell inside, chosen by a number from 0."""
    cell = _as(cell, "long")
    return cell - lowest_bit(cell) + 1 + 2 * F.pmod(_as(random, "long"), lowest_bit(cell))


def common_level(a: Column | str, b: Column | str) -> Column:
    """Level of the deepest common ancestor; null for different faces or invalid ids."""
    a, b = _as(a, "long"), _as(b, "long")
    most = F.least(try_level(a), try_level(b))
    differ = shr(a.bitwiseXOR(b), 1).bitwiseAND(_long((1 << POSITION_BITS) - 1))
    differ = shr(differ, POSITION_BITS - 2 * most)
    return F.when(face(a) == face(b), ((2 * most - significant_bits(differ)) / 2).cast("int"))


def common_ancestor(a: Column | str, b: Column | str) -> Column:
    return _ancestor(_as(a, "long"), common_level(a, b))


def hex_id(cell: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(_as(cell, "long")), 16, "0"))


# -- compact ids


def to_compact(cell: Column | str) -> Column:
    """Of a cell at a level up to 12, or of its ancestor at level 12."""
    cell = _as(cell, "long")
    return shr(_ancestor(cell, F.least(_level(cell), F.lit(MAX_COVER_LEVEL))), COMPACT_SHIFT).cast("int")


def from_compact(compact: Column | str) -> Column:
    return shl(_as(compact, "long"), COMPACT_SHIFT)


def compact_level(compact: Column | str) -> Column:
    c = _as(compact, "int")
    return (12 - F.bit_count(c.bitwiseAND(-c) - 1) / 2).cast("int")


def compact_lowest(compact: Column | str) -> Column:
    c = _as(compact, "int")
    return c.bitwiseAND(-c)


def compact_ancestor(compact: Column | str, at: Column | int | str) -> Column:
    c, marker = _as(compact, "int"), 24 - 2 * _as(at, "int")
    return shl(shr(c, marker), marker).bitwiseOR(shl(F.lit(1), marker))


def compact_child(compact: Column | str, parent_level: Column | int | str) -> Column:
    """Which child of its ancestor at parent_level contains the cell."""
    return shr(_as(compact, "int"), 23 - 2 * _as(parent_level, "int")).bitwiseAND(F.lit(3))


def compact_face(compact: Column | str) -> Column:
    return shr(_as(compact, "int"), 25)


def compact_from_path(f: Column | str, at: Column | str, path: Column | str) -> Column:
    marker = 24 - 2 * _as(at, "int")
    return shl(_as(f, "int"), 25).bitwiseOR(shl(_as(path, "int"), marker + 1)).bitwiseOR(shl(F.lit(1), marker))


def compact_valid(compact: Column | str) -> Column:
    c = _as(compact, "int")
    return c.isNotNull() & (c > 0) & (c <= MAX_COMPACT) & (compact_face(c) < FACES) & (F.bit_count(c.bitwiseAND(-c) - 1) % 2 == 0) & (F.bit_count(c.bitwiseAND(-c) - 1) <= 24)
