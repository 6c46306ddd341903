"""Deterministic uniform draws.

draw = first 32 bits of md5(id ':' seed) / 2^32.  It depends only on the id
and the seed: not on partitioning, task retries or evaluation order, so a
re-run after executor loss gives the same sample.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform_draw(id_col: Column, seed: str) -> Column:
    h = F.md5(F.concat(id_col.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def duckdb_draw(id_sql: str, seed: str) -> str:
    """The same draw in DuckDB SQL (for oracles)."""
    return f"(('0x' || substr(md5(CAST({id_sql} AS VARCHAR) || ':{seed}'), 1, 8))::UBIGINT / 4294967296.0)"
