"""SimHash near-duplicates through pigeonhole blocks.

A text's fingerprint has a bit for each of 64 majorities over the XXH64 hashes
of its word shingles. Fingerprints are split into ``distance + 2`` blocks; two
that differ in at most ``distance`` bits agree in two blocks or more, so they
meet under the key of some pair of blocks, and the Hamming distance of those
that meet is checked. Equal fingerprints count once in all of this.

A key that very many distinct fingerprints share is not paired out: under it
each fingerprint is listed beside every fingerprint one bit away, and all that
are listed for one centre are tied to the least of them and checked, which
connects exactly the same fingerprints without their pairs (at ``distance`` 2,
the only one at which it would; at others all keys are paired).

Defined results: a null or empty text has fingerprint zero and links like any
other; a null doc_id takes part, but is no component's name unless there is no
other id; repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import fresh_name, ready, slices, stash
from epicohort.llm.components import connected_components

SEED = 42
#: A block key with more distinct fingerprints than this goes by centres and not by pairs.
PAIRED = 256


def _bits():
    import numpy as np
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def fingerprint(text: bytes, words: int, table=None) -> int:
    """The fingerprint as a signed 64-bit number; A-Z are lower-cased."""
    import numpy as np
    from xxhash import xxh64_digest
    own = text.lower().split()
    if not own:
        return 0
    if len(own) <= words:
        digests = xxh64_digest(b" ".join(own), SEED)
    else:
        line = b" ".join(own)
        ends, at = [], -1
        for w in own:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *[e + 1 for e in ends]]
        digests = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1:])])
    table = _bits() if table is None else table
    each = np.frombuffer(digests, np.uint8).reshape(-1, 8)
    counts = np.bincount((each + np.arange(8) * 256).ravel(), minlength=2048).reshape(8, 256) @ table
    majority = np.packbits(2 * counts.ravel() > len(each))
    return int.from_bytes(majority.tobytes(), "big", signed=True)


def fingerprints(text: Column, words: int) -> Column:
    """Fingerprint (bigint) of a text; null counts as empty."""
    def run(texts: pa.Array) -> pa.Array:
        table, out = _bits(), []
        for _, part in slices(texts):
            out += [fingerprint(t or b"", words, table) for t in part.cast(pa.binary()).to_pylist()]
        return pa.array(out, pa.int64())
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "bigint")(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def block_keys(fp: Column, distance: int) -> tuple[Column, list[int]]:
    """Keys that hold two blocks each, and the masks of the blocks they hold."""
    blocks = distance + 2
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    mask = [((1 << cuts[i + 1]) - 1) ^ ((1 << cuts[i]) - 1) for i in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    pairs = [signed(mask[a] | mask[b]) for a, b in combinations(range(blocks), 2)]
    return F.array(*[F.struct(F.lit(i).alias("no"), fp.bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(pairs)]), pairs


def near_links(distinct: DataFrame, distance: int) -> DataFrame:
    """Edges (u, v) that connect the fingerprints (column ``fp``, each once) at most ``distance`` bits apart."""
    keys, masks = block_keys(F.col("fp"), distance)
    keyed = distinct.select("fp", F.explode(keys).alias("k")).select("fp", "k.no", "k.bits")
    close = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance
    crowd = 0
    if distance == 2:  # the distance at which centres connect all that is near, and only that
        crowded = stash(keyed.groupBy("no", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PAIRED)
                        .select("no", "bits"), "crowded")
        crowd = crowded.count()
    thin = keyed.join(crowded, ["no", "bits"], "left_anti") if crowd else keyed
    left, right = thin.select("no", "bits", F.col("fp").alias("u")), thin.select("no", "bits", F.col("fp").alias("v"))
    links = left.join(right, ["no", "bits"]).where((F.col("u") < F.col("v")) & close).select("u", "v")
    if not crowd:
        return links
    # centres: a fingerprint and those one flipped bit away, among the bits that the key leaves open
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
    open_bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("mask").bitwiseAND(bit(i)) == 0)
    centres = F.concat(F.array("fp"), F.transform(open_bits, lambda i: F.col("fp").bitwiseXOR(bit(i))))
    mask = F.get(F.array(*[F.lit(m) for m in masks]), F.col("no"))
    spread = keyed.join(crowded, ["no", "bits"]).withColumn("mask", mask).select("fp", "no", F.explode(centres).alias("centre"))
    spread = stash(spread, "centres")
    least = stash(spread.groupBy("no", "centre").agg(F.min("fp").alias("u")), "least")
    tied = spread.join(least, ["no", "centre"]).select("u", F.col("fp").alias("v")).where((F.col("u") < F.col("v")) & close)
    return links.unionByName(tied).distinct()


def components(own: DataFrame, distance: int) -> DataFrame:
    """_fp, root (the component's least fingerprint), component_id (its least doc_id): a row for each ``fp`` of ``own``."""
    distinct = stash(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = connected_components(near_links(distinct, distance))
    linked = roots.join(distinct, F.col("node") == F.col("fp")).select("fp", "root", "least")
    linked = stash(linked, "linked")
    names = stash(linked.groupBy("root").agg(F.min("least").alias("name")), "names")
    named = linked.join(names, "root").select(F.col("fp").alias("_fp"), "root", "name")
    every = distinct.join(named, F.col("fp") == F.col("_fp"), "left") \
        .select(F.col("fp").alias("_fp"), F.coalesce("root", "fp").alias("root"), F.coalesce("name", "least").alias("component_id"))
    return stash(every, "components")


def near_duplicates(docs: DataFrame, words: int, distance: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, fp (bigint), component_id (the
    least id of the documents that can be reached over links)."""
    ready(docs.sparkSession)
    own = stash(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")), "fingerprints")
    every = components(own, distance).select("_fp", "component_id")
    return own.join(every, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int, distance: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each component: that of its least id, or of no id where it has none,
    and of the least hash of its text among those; of rows equal in both any one."""
    ready(docs.sparkSession)
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    own = docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp"), digest.alias("digest"))
    own = stash(own, "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = own.groupBy("fp").agg(F.min(order).alias("first"))  # a text has one fingerprint, and so one component
    stay = first.join(components(own, distance), F.col("fp") == F.col("_fp")).groupBy("root").agg(F.min("first").alias("first"))
    stay = stash(stay.select(F.col("first.doc_id").alias("_keep"), F.col("first.digest").alias("_digest")), "stay")
    repeated = own.join(stay, F.col("doc_id").eqNullSafe(F.col("_keep")) & (F.col("digest") == F.col("_digest")), "left_semi") \
        .groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    repeated = stash(repeated.select(F.col("doc_id").alias("_keep"), F.col("digest").alias("_digest")), "repeated")
    name = fresh_name(docs, "digest_of_text")
    same = F.col(doc_id).eqNullSafe(F.col("_keep")) & (F.col(name) == F.col("_digest"))
    kept = docs.withColumn(name, digest).join(stay, same, "left_semi")
    if repeated.limit(1).count():
        several = kept.join(repeated, same, "left_semi").dropDuplicates([doc_id, name])
        kept = kept.join(repeated, same, "left_anti").unionByName(several)
    return kept.drop(name)
