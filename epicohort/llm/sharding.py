"""Sharding with a hierarchical weighted hash tree, with DataFrame functions only.

Shards stand in racks and racks in regions, each with a fixed number of places.
A region draws for a key by a race of weighted hash draws: its draws come at the
rate of its places, and each descends rack and shard levels by further draws to
one place, with a share of the place's weight. A draw that lands on an empty
place, or that the weight turns down, is passed over and the region draws again.
The region whose first standing draw comes earliest wins, and the draw says
which rack and shard. A subtree's chance is its weight, and a place that is
added or made heavier only lets draws stand that end in that very place: rows
move into it and nowhere else, and all other subtrees keep what they have.

The law is ``key``: a row's shard depends on its id and the shards alone.

Defined results: a null id is the key of its own (all such rows share a shard);
a null text has size 16 and checksum 0; repeated rows get a slot each; with no
rows there is no slot; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epicohort.llm.common import stash

#: Places: racks of a region, shards of a rack.
RACKS, PLACES = 4, 4
#: Draws of a region before it gives up; a region with one place of 16 fails so with chance 7e-8 a key.
DRAWS = 256
#: Rows of one block of a shard that are numbered together, at about.
BLOCK_ROWS = 20_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _region_draw(key: Column, region: int, table: Column) -> Callable[[Column, Column], Column]:
    """One more draw of a region, unless one stands already; ``table`` has the weights of its places."""
    def draw(state: Column, attempt: Column) -> Column:
        named = lambda level: uniform(F.concat_ws("/", key, F.lit(f"{level}{region}"), attempt.cast("string")))
        rack = F.floor(named("rack") * RACKS)
        place = (rack * PLACES + F.floor(named("shard") * PLACES)).cast("int")
        stands = named("weight") < F.get(table, place)
        time = state["time"] - F.log(named("region")) / F.lit(float(RACKS * PLACES))
        return F.when(state["place"] >= 0, state).otherwise(F.struct(
            time.alias("time"), F.when(stands, place).otherwise(F.lit(-1)).alias("place")))
    return draw


def _shard_found(first: int) -> Callable[[Column], Column]:
    """A region's end state as (time, shard); without a standing draw its time is infinite."""
    return lambda e: F.struct(F.when(e["place"] >= 0, e["time"]).otherwise(F.lit(float("inf"))).alias("time"),
                              F.when(e["place"] >= 0, e["place"] + F.lit(first)).alias("shard"))


def choose_shard(doc_id: Column, weights: Sequence[float]) -> Column:
    """Shard of a key; ``weights[i]`` is the weight of shard i, above 0 and at most 1."""
    if not weights or min(weights) <= 0 or max(weights) > 1:
        raise ValueError("weights lie above 0 and at most at 1")
    key = F.coalesce(doc_id.cast("string"), F.lit("null"))
    size = RACKS * PLACES
    best = None
    for region in range(-(-len(weights) // size)):
        own = [*weights[region * size:(region + 1) * size]]
        full = len(own) == size and min(own) == 1
        table = F.array(*[F.lit(float(w)) for w in own + [0.0] * (size - len(own))])

        start = F.struct(F.lit(0.0).alias("time"), F.lit(-1).alias("place"))
        attempts = F.sequence(F.lit(0), F.lit(0 if full else DRAWS - 1))
        end = F.aggregate(attempts, start, _region_draw(key, region, table))
        found = F.transform(F.array(end), _shard_found(region * size))
        best = found if best is None else F.concat(best, found)
    # only a key that no region has placed comes to the last resort: a race of all shards
    resort = F.array(*[F.struct((-F.log(uniform(F.concat_ws("/", key, F.lit(f"last{i}")))) / F.lit(float(w))).alias("time"),
                                F.lit(i).alias("shard")) for i, w in enumerate(weights)])
    winner = F.array_min(best)
    return F.when(F.isnan(winner["time"]) | (winner["time"] == float("inf")), F.array_min(resort)["shard"]) \
        .otherwise(winner["shard"]).cast("int")


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard and, where ``grown`` weights are given, the shard under those."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    out = [F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + 16).cast("long").alias("size"),
           F.crc32(raw).alias("text_crc32"), choose_shard(F.col(doc_id), weights).alias("shard")]
    if grown is not None:
        out.append(choose_shard(F.col(doc_id), grown).alias("grown_shard"))
    return docs.select(*out)


def number_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with a ``slot``, gapless from 0 in each shard, in the order of a hash of
    the row. Equal rows are counted first and dealt out last, and a shard is
    numbered in blocks behind the counts of those before, so neither a large
    shard nor a row with many copies is sorted in one task."""
    names = rows.columns
    counted = stash(rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.xxhash64(*names).alias("_h")), "rows")
    total = counted.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(shard).alias("s")).first()
    blocks = max(1, -(-total["n"] // (BLOCK_ROWS * max(1, total["s"]))))
    block = F.pmod(F.col("_h"), F.lit(blocks))
    sizes = counted.groupBy(shard, block.alias("_block")).agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_shard"), F.col("_block").alias("_at"),
                          F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(shard, "_block").orderBy("_h", *names).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_block", block).withColumn("_before", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = placed.join(starts, (F.col(shard).eqNullSafe(F.col("_shard"))) & (F.col("_block") == F.col("_at")))
    first = F.col("_start") + F.col("_before")
    return placed.select(*names, F.explode(F.sequence(first, first + F.col("_n") - 1)).alias("slot"))


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, doc_id: str = "doc_id") -> None:
    """Write whole documents, one folder for each shard."""
    docs.withColumn("shard", choose_shard(F.col(doc_id), weights)).write.partitionBy("shard").parquet(path)
