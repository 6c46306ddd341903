"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epicohort.session import ensure_checkpoint_dir, ship_package

#: Rows and bytes of one slice of an Arrow batch that a worker holds as Python objects (one row at least).
SLICE, SLICE_BYTES = 256, 2 << 20


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under ``spark.checkpoint.dir`` and read it back: the lineage
    ends at files that every executor reads, so a lost executor costs one task."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), "llm", f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch, where the session does not say: whole texts can be long, and a task holds a batch and its results.
BATCH_ROWS = 1_000


def ready(spark: SparkSession) -> None:
    """What a job with Python tasks needs: the package on the workers, and batches that fit in their memory."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", None) is None:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name, k = base, 0
    while name.lower() in taken:
        k += 1
        name = f"{base}_{k}"
    return name


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows of the held-out fold: crc32 of the id as text, modulo ``folds``.
    A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold


def hash_share(key: Column, salt: str) -> Column:
    """A uniform number in [0, 1) that depends on the key alone."""
    h = F.xxhash64(F.coalesce(key.cast("string"), F.lit("")), F.lit(salt))
    return F.shiftrightunsigned(h, 11).cast("double") / F.lit(float(1 << 53))


def slices(values: Sequence, size: int = SLICE, most: int | None = None) -> Iterator[tuple[int, Sequence]]:
    """(start, slice) of at most ``size`` values in a row that are, where they are an Arrow array of texts or
    bytes, at most ``most`` (``SLICE_BYTES``) bytes together; a longer value is a slice of its own."""
    n = len(values)
    if not isinstance(values, pa.Array):
        for start in range(0, n, size):
            yield start, values[start:start + size]
        return
    until = np.cumsum(pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < n:
        before = until[start - 1] if start else 0
        stop = int(np.searchsorted(until, before + (most or SLICE_BYTES), "right"))
        stop = min(max(stop, start + 1), start + size)
        yield start, values[start:stop]
        start = stop


_BUILT: dict[str, object] = {}


class Shared:
    """A broadcast value and what each Python worker builds from it, once."""

    def __init__(self, spark: SparkSession, value, build: Callable):
        self.key, self.build = uuid.uuid4().hex, build
        self.value = spark.sparkContext.broadcast(value)

    def get(self):
        if self.key not in _BUILT:
            if len(_BUILT) > 1:
                _BUILT.clear()
            _BUILT[self.key] = self.build(self.value.value)
        return _BUILT[self.key]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
