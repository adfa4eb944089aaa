"""Lookups of streaming queries against a stored cover."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import lookup


def resolve(queries: DataFrame, members: DataFrame, compact: str = "compact") -> DataFrame:
    """queries (streaming or not) with answer and answer_level. Each query meets exactly one tile, so that no state is kept: a plain
    stream-static join. A cover of more than lookup.BROADCAST_ROWS tiles is refused for streams."""
    if queries.isStreaming and not lookup.small(lookup._tile_keys(members))[1]:
        raise ValueError(f"more than {lookup.BROADCAST_ROWS} tiles")
    return lookup.by_tiles(queries, members, compact)
