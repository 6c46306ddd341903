"""Conversation prefix trie by van Emde Boas recursion.

Sequences of up to 2 ** K items are cut at half depth. Every cut prefix gets
a name; the sequences above the cuts make the upper trie, those below make a
forest with one tree for each name, and both are cut again at their half, all
of one level in one job, until a tree has a single level. So after K rounds
every prefix has a name: at a cut it is the digest of the name of its tree's
root and of the block of items between. Blocks are digested two by two before
(a block of 2 ** k items out of two of half the length), so a round at blocks of
2 ** k items reads 1 / 2 ** k of the rows.

A node is a distinct name. Totals over subtrees go the other way: a tree of one
level has its own value; two levels are grafted at their cut, the total of each
lower tree going to the nodes above its root in the upper tree, and so on
upward. A node passes its total on to less than 2 ** k nodes in round k, so a
chain of n nodes costs n log n additions, where one to all of its ancestors
would cost n squared.

No conversation, node or list of children is gathered in one task: rows are
keyed by (sequence, place), which no two share, nodes are counted before they
are shuffled, and a parent with very many children is looked up in a
broadcast of at most ``numbering.HOT_KEYS`` rows. What a node's members digest to is
one SHA-256 over all their ids: the ids are sorted and joined in chunks of at most
``CHUNK_IDS`` and the chunks then run through the digest as a stream, in
bounded memory, whatever the number of members.

Defined results: a null role or text is empty; turns that tie keep the order of
their (role, text) digest and repeated rows are turns of their own; a row without
conv_id belongs to no conversation and is left out; a conversation without turns is a
member of the root; an empty table has no members, so no node either; a very
long text is digested where it stands and not moved; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import ready, stash
from epicohort.operators.numbering import lookup_join, number_within

#: Most ids that are joined in one row before they are digested.
CHUNK_IDS = 1_024
#: The name of the empty prefix.
ROOT = b""


def item_digest(*parts: str) -> Column:
    """A digest of several texts that no other texts share: each comes with its length."""
    texts = [F.coalesce(F.col(p).cast("string"), F.lit("")).cast("binary") for p in parts]
    return F.unhex(F.sha2(F.concat(*[x for t in texts for x in (F.octet_length(t).cast("string").cast("binary"),
                                                                 F.lit(":").cast("binary"), t)]), 256))


def _joined(a: str | Column, b: str | Column) -> Column:
    """The name of what is named ``a`` with ``b`` behind it."""
    return F.unhex(F.sha2(F.concat(a, b), 256))


def ordered_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """seq, pos (from 0), item, weight (code points of the text) of every turn with a key."""
    rows = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("seq"), F.col(turn).alias("_turn"), item_digest(role, text).alias("item"),
        F.coalesce(F.char_length(F.col(text)), F.lit(0)).cast("long").alias("weight"))
    return number_within(rows, "seq", [F.col("_turn").asc_nulls_first(), F.col("item")], "pos").select("seq", "pos", "item", "weight")


def name_prefixes(items: DataFrame) -> tuple[DataFrame, int]:
    """(seq, depth, name) of every prefix but the empty one, for (seq, pos, item) rows
    with gapless places, and the K of the recursion."""
    longest = items.agg(F.max("pos")).first()[0]
    if longest is None:
        return items.select("seq", F.col("pos").alias("depth"), F.col("item").alias("name")), 0
    levels = (longest + 1).bit_length()
    # blocks[k]: full blocks of 2 ** k items, by number
    blocks = [stash(items.select("seq", F.col("pos").alias("block"), F.col("item").alias("name")), "blocks")]
    for _ in range(1, levels):
        pair = blocks[-1].groupBy("seq", F.floor(F.col("block") / 2).cast("long").alias("half")).agg(
            F.max(F.when(F.col("block") % 2 == 0, F.col("name"))).alias("a"), F.max(F.when(F.col("block") % 2 == 1, F.col("name"))).alias("b"))
        blocks.append(stash(pair.where(F.col("a").isNotNull() & F.col("b").isNotNull())
                            .select("seq", F.col("half").alias("block"), _joined("a", "b").alias("name")), "blocks"))
    named: DataFrame | None = None
    for k in reversed(range(levels)):
        # the trees of 2 ** (k + 1) levels are cut at depth 2 ** k below their roots
        cuts = blocks[k].where(F.col("block") % 2 == 0)
        first = cuts.where(F.col("block") == 0).select("seq", F.lit(1 << k).cast("long").alias("depth"),
                                                       _joined(F.lit(ROOT), "name").alias("name"))
        if named is None:
            named = stash(first, "named")
            continue
        roots = named.select("seq", (F.col("depth") / (1 << k)).cast("long").alias("block"), F.col("name").alias("root"))
        below = cuts.join(roots, ["seq", "block"]).select("seq", ((F.col("block") + 1) * (1 << k)).alias("depth"),
                                                          _joined("root", "name").alias("name"))
        named = stash(named.unionByName(first).unionByName(below), "named")
    return named, levels


def build_nodes(items: DataFrame, named: DataFrame) -> DataFrame:
    """The nodes below the root: depth, name, parent (a name), least (the smallest
    member), n_members, weight (that of the last item)."""
    steps = named.join(items.select("seq", (F.col("pos") + 1).alias("depth"), "weight"), ["seq", "depth"])
    above = named.select("seq", (F.col("depth") + 1).alias("depth"), F.col("name").alias("parent"))
    steps = steps.join(above, ["seq", "depth"], "left").withColumn("parent", F.coalesce("parent", F.lit(ROOT)))
    return steps.groupBy("depth", "name").agg(
        F.min("seq").alias("least"), F.count(F.lit(1)).alias("n_members"), F.min("parent").alias("parent"),
        F.min("weight").alias("weight"))


def graft_totals(nodes: DataFrame, named: DataFrame, levels: int, values: list[str]) -> DataFrame:
    """(depth, name, *values) with each value summed over the node's subtree, its
    own included, for the nodes below the root."""
    sums = [F.sum(v).alias(v) for v in values]
    totals = nodes.select("depth", "name", "least", *values)
    for k in range(levels):
        size = 1 << k
        # lower trees are rooted at odd multiples of their height; the ways up end with the upper tree, or below the root of all
        roots = totals.where((F.col("depth") % (2 * size) == size) & (F.col("depth") > 1))
        up = F.sequence(F.greatest(F.col("depth") - size, F.lit(1)), F.col("depth") - 1)
        ways = roots.select(F.col("least").alias("seq"), *values, F.explode(up).alias("depth"))
        upper = named.where(F.col("depth").bitwiseAND(F.lit(size)) == 0)
        gains = ways.join(upper, ["seq", "depth"]).groupBy("depth", "name").agg(*sums)
        both = totals.unionByName(gains.withColumn("least", F.lit(None).cast("long")))
        totals = stash(both.groupBy("depth", "name").agg(F.min("least").alias("least"), *sums), "totals")
    return totals.drop("least")


def _digest_stream(batches):
    """One SHA-256 for each name over its chunks, which come one after another, sorted."""
    name, running = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if running is not None and own == name:
                running.update(b",")
            else:
                if running is not None:
                    done.append((name, running.hexdigest()))
                name, running = own, hashlib.sha256()
            running.update(ids.encode())
        yield _digest_batch(done)
    if running is not None:
        yield _digest_batch([(name, running.hexdigest())])


def _digest_batch(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                                      ["name", "ends_sha256"])


def digest_ends(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256): the digest of the comma-joined ascending sequences
    that end under each name, for rows (name, seq)."""
    ready(ends.sparkSession)
    chunk = F.floor(F.col("seq") / F.lit(CHUNK_IDS)).cast("long")
    chunks = ends.groupBy("name", chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("ids"))
    inorder = chunks.repartition("name").sortWithinPartitions("name", "chunk")
    return inorder.select("name", "ids").mapInArrow(_digest_stream, "name binary, ends_sha256 string")


def prefix_trie(items: DataFrame, sequences: DataFrame) -> DataFrame:
    """The trie of the sequences: one row for each node, the root included.

    ``items``: (seq, pos, item, weight) with places from 0 without gaps;
    ``sequences``: (seq), each once, those without items too. Returns depth, name,
    least (the smallest member), parent_least, n_members, n_children, n_leaves
    (childless nodes in the subtree), saved_weight (over the subtree, the weight
    of a node's last item for each member but one), ends_sha256."""
    named, levels = name_prefixes(items)
    nodes = stash(build_nodes(items, named), "nodes")
    n_children = nodes.groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    top = sequences.agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("n_members")).where(F.col("n_members") > 0)
    top = top.select(F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("name"), "least", "n_members",
                     F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("weight"))
    below = nodes.select(top.columns).join(n_children.withColumnRenamed("parent", "name"), "name", "left")
    of_root = n_children.where(F.col("parent") == F.lit(ROOT)).select("n_children")  # one row at most
    top = top.join(F.broadcast(of_root), F.lit(True), "left")
    every = stash(below.unionByName(top).withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("n_leaves", (F.col("n_children") == 0).cast("long"))
                  .withColumn("saved_weight", (F.col("n_members") - 1) * F.col("weight")), "every")
    values = ["n_leaves", "saved_weight"]
    totals = graft_totals(every.where(F.col("depth") > 0), named, levels, values)
    whole = every.agg(*[F.sum(v).alias(v) for v in values]).where(F.col(values[0]).isNotNull())
    totals = totals.select("name", *values).unionByName(whole.select(F.lit(ROOT).alias("name"), *values))
    parents = every.select(F.col("name").alias("parent"), F.col("least").alias("parent_least"))
    found = lookup_join(every.drop(*values, "weight"), parents, "parent")
    lengths = items.groupBy("seq").agg(F.count(F.lit(1)).alias("depth"))
    last = named.join(lengths, ["seq", "depth"]).select("name", "seq") \
        .unionByName(sequences.join(lengths, "seq", "left_anti").select(F.lit(ROOT).alias("name"), "seq"))
    found = found.join(totals, "name").join(digest_ends(last), "name", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("depth", "name", "least", "parent_least", "n_members", "n_children", *values,
                        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
