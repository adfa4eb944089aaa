"""From pixels to coordinates, and from coordinates to cells, in column expressions.

The cell of a point: the face of the unit cube that its direction meets, the quadratic projection of the two other coordinates
to 0..2^30 - 1, and the position along the Hilbert curve. The curve is followed four bits at a time through a
table of 1,024 entries that is built from the four orders of a quadrant; each step is a column of its own,
so that expressions stay small.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cells import shl, shr

#: For each orientation, the quadrants (2 i + j) in the order of the curve, and how each turns it.
CURVE = ((0, 1, 3, 2), (0, 2, 3, 1), (3, 2, 0, 1), (3, 1, 0, 2))
TURN = (1, 0, 0, 3)
#: The grid of the source raster.
WIDTH, HEIGHT, NORTH, WEST = 43_200, 17_280, 84.0, -180.0


@cache
def curve_table(bits: int) -> list[int]:
    """For orientation, bits of i and bits of j: the position along the curve times 4, plus the new orientation."""
    out = []
    for state in range(4):
        for i in range(1 << bits):
            for j in range(1 << bits):
                pos, o = 0, state
                for b in reversed(range(bits)):
                    p = CURVE[o].index(2 * (i >> b & 1) + (j >> b & 1))
                    pos, o = 4 * pos + p, o ^ TURN[p]
                out.append(4 * pos + o)
    return out


def latitude(pixel_y: Column | str) -> Column:
    y = F.col(pixel_y) if isinstance(pixel_y, str) else pixel_y
    return F.lit(NORTH) - (y + F.lit(0.5)) * F.lit(1.0 / 120.0)


def longitude(pixel_x: Column | str) -> Column:
    x = F.col(pixel_x) if isinstance(pixel_x, str) else pixel_x
    return F.lit(WEST) + (x + F.lit(0.5)) * F.lit(1.0 / 120.0)


def with_face_ij(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Adds _face, _i and _j (30 bits each)."""
    keep = [c for c in df.columns if c not in ("_face", "_i", "_j")]
    df = df.select(*keep, F.radians(lat).alias("_p"), F.radians(lng).alias("_q"))
    df = df.select(*keep, (F.cos("_q") * F.cos("_p")).alias("_x"), (F.sin("_q") * F.cos("_p")).alias("_y"), F.sin("_p").alias("_z"))
    x, y, z = F.col("_x"), F.col("_y"), F.col("_z")
    axis = F.when((F.abs(x) > F.abs(y)) & (F.abs(x) > F.abs(z)), 0).when(~(F.abs(x) > F.abs(y)) & (F.abs(y) > F.abs(z)), 1).otherwise(2)
    df = df.select(*keep, "_x", "_y", "_z", axis.alias("_axis"))
    major = F.when(F.col("_axis") == 0, x).when(F.col("_axis") == 1, y).otherwise(z)
    df = df.select(*keep, "_x", "_y", "_z", (F.col("_axis") + F.when(major < 0, 3).otherwise(0)).alias("_face"))
    pairs = [(y / x, z / x), (-x / y, z / y), (-x / z, -y / z), (z / x, y / x), (z / y, -x / y), (-y / z, -x / z)]
    choose = lambda k: F.coalesce(*[F.when(F.col("_face") == f, p[k]) for f, p in enumerate(pairs)])
    df = df.select(*keep, "_face", choose(0).alias("_u"), choose(1).alias("_v"))

    def grid(c: str) -> Column:
        s = F.when(F.col(c) >= 0, 0.5 * F.sqrt(1 + 3 * F.col(c))).otherwise(1 - 0.5 * F.sqrt(1 - 3 * F.col(c)))
        return F.greatest(F.lit(0), F.least(F.lit((1 << 30) - 1), F.floor(s * float(1 << 30)).cast("int")))

    return df.select(*keep, "_face", grid("_u").alias("_i"), grid("_v").alias("_j"))


def _step(df: DataFrame, keep: list[str], low: int, bits: int) -> DataFrame:
    """Follows the curve through bits low..low + bits - 1 of _i and _j; _path and _state go on."""
    mask = F.lit((1 << bits) - 1)
    at = shl(F.col("_state"), 2 * bits).bitwiseOR(shl(shr(F.col("_i"), low).bitwiseAND(mask), bits)).bitwiseOR(shr(F.col("_j"), low).bitwiseAND(mask))
    table = F.array(*[F.lit(v) for v in curve_table(bits)])
    df = df.select(*keep, "_face", "_i", "_j", "_path", F.element_at(table, at + 1).alias("_hit"))
    return df.select(*keep, "_face", "_i", "_j", shl(F.col("_path"), 2 * bits).bitwiseOR(shr(F.col("_hit"), 2)).alias("_path"), F.col("_hit").bitwiseAND(F.lit(3)).alias("_state"))


def with_compact12(df: DataFrame, lat: str = "lat", lng: str = "lng", out: str = "compact") -> DataFrame:
    """Adds the compact id of the level-12 cell of each point."""
    keep = [c for c in df.columns if c != out]
    df = with_face_ij(df, lat, lng).select(*keep, "_face", "_i", "_j", F.lit(0).alias("_path"), F.col("_face").bitwiseAND(F.lit(1)).alias("_state"))
    for low in (26, 22, 18):
        df = _step(df, keep, low, 4)
    return df.select(*keep, shl(F.col("_face"), 25).bitwiseOR(shl(F.col("_path"), 1)).bitwiseOR(F.lit(1)).alias(out))


def with_cell30(df: DataFrame, lat: str = "lat", lng: str = "lng", out: str = "cell_id") -> DataFrame:
    """Adds the long id of the level-30 cell of each point."""
    keep = [c for c in df.columns if c != out]
    df = with_face_ij(df, lat, lng).select(*keep, "_face", "_i", "_j", F.lit(0).cast("long").alias("_path"), F.col("_face").bitwiseAND(F.lit(1)).alias("_state"))
    df = _step(df, keep, 28, 2)
    for low in range(24, -1, -4):
        df = _step(df, keep, low, 4)
    return df.select(*keep, shl(F.col("_face").cast("long"), 61).bitwiseOR(shl(F.col("_path"), 1)).bitwiseOR(F.lit(1).cast("long")).alias(out))
