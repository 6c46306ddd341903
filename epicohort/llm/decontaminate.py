"""Benchmark decontamination by greedy string tiling.

Words are lower-cased runs of letters, digits and underscores; in scripts that
set no spaces between words each letter counts as a word. A document and
a benchmark item that share a seed (``MIN_TILE`` words in a row) are tiled:
the longest common runs of words are marked one after another, each word once.
An item leaks if tiles of ``MIN_TILE`` words or more cover at least
``MIN_COVERAGE`` of its words, in whatever order they stand in the document.

The items, equal ones once with their number, are taken in blocks of at most
``BLOCK_WORDS`` words (a longer item has a block of its own); each block's index is broadcast and every document is read against it, so
documents are never shuffled and a passage that many documents share costs
each of them its own tiling alone. More items make more blocks.

Defined results: null and empty texts match nothing, items without a word too;
an item with fewer than ``MIN_TILE`` words leaks where it stands as a whole, and
has one tile, at its first place; a null id is carried as null; repeated rows and items each match for themselves;
other columns are ignored by ``leaks`` and kept by ``decontaminate``.
"""

from __future__ import annotations

import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import Shared, fresh_name, ready, slices, stash, union_all
from epicohort.llm.tiling import Rolling, greedy_tiles, powers

MIN_TILE, MIN_COVERAGE = 5, 0.5
BLOCK_WORDS = 1_000_000
#: Bits of the table that answers most seed look-ups.
FILTER_BITS = 20

#: Thai, Lao, Myanmar, Khmer, kana, bopomofo and Han letters.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u312f\u31a0-\u31bf\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_WORDS = re.compile(rf"[^\W{_UNSPACED}]+|(?=[{_UNSPACED}])\w").findall

LEAKS = "array<struct<item_id:bigint,item_words:int,covered_words:int,coverage:double,tiles:array<struct<item_word:int,doc_word:int,words:int>>>>"
_TILE = pa.struct([("item_word", pa.int32()), ("doc_word", pa.int32()), ("words", pa.int32())])
_LEAK = pa.list_(pa.struct([("item_id", pa.int64()), ("item_words", pa.int32()), ("covered_words", pa.int32()),
                            ("coverage", pa.float64()), ("tiles", pa.list_(_TILE))]))


class TileIndex:
    """Seeds of one block of items (id, text, number of copies). Words get numbers from 1; 0 is any other word."""

    def __init__(self, items: list[tuple[int | None, str, int]], least: int = MIN_TILE, coverage: float = MIN_COVERAGE):
        self.least, self.coverage = least, coverage
        self.words: dict[str, int] = {}
        self.items = []
        #: Items below ``least`` words, by their number of words: the ids of each.
        self.short: dict[int, dict[tuple[int, ...], list[int | None]]] = {}
        for item_id, text, copies in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in _WORDS(text.lower())]
            if len(ids) >= least:
                self.items.append((item_id, np.array(ids, np.int32), copies))
            elif ids:
                self.short.setdefault(len(ids), {}).setdefault(tuple(ids), []).extend([item_id] * copies)
        self.power = powers(least)
        hashes = [self.seed_hashes(ids) for _, ids, _ in self.items]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        owner = np.concatenate([np.full(len(h), i) for i, h in enumerate(hashes)]) if hashes else np.zeros(0, np.int64)
        place = np.concatenate([np.arange(len(h)) for h in hashes]) if hashes else np.zeros(0, np.int64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owner, self.place = every[order], owner[order], place[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._low(every)] = True

    @staticmethod
    def _low(hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def seed_hashes(self, ids: np.ndarray, length: int | None = None) -> np.ndarray:
        """A hash of every window of ``length`` (else ``least``) words, the same wherever it stands."""
        length = length or self.least
        n = len(ids) - length + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        wide = ids.astype(np.uint64)
        out = np.zeros(n, np.uint64)
        for k in range(length):
            out += wide[k:n + k] * self.power[k]
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """For each text its leaking items: (item_id, words, covered, coverage, tiles)."""
        get, gap = self.words.get, [0] * self.least
        numbers: list[int] = []
        starts = []
        for t in texts:
            starts.append(len(numbers))
            if t:
                numbers += [get(w, 0) for w in _WORDS(t.lower())]
            numbers += gap  # no seed reaches over to the next text
        ids = np.array(numbers, np.int32)
        out: list[list[tuple]] = [[] for _ in texts]
        self._whole(ids, np.array(starts), out)
        hashes = self.seed_hashes(ids)
        at = np.flatnonzero(self.filter[self._low(hashes)])
        left = np.searchsorted(self.hashes, hashes[at], "left")
        right = np.searchsorted(self.hashes, hashes[at], "right")
        at, left, right = at[right > left], left[right > left], right[right > left]
        if not len(at):
            return out
        found: dict[tuple[int, int], list[tuple[int, int]]] = {}
        doc = np.searchsorted(np.array(starts), at, "right") - 1
        for a, lo, hi, d in zip(at.tolist(), left.tolist(), right.tolist(), doc.tolist()):
            for k in range(lo, hi):
                found.setdefault((d, int(self.owner[k])), []).append((a, int(self.place[k])))
        for (d, i), seeds in found.items():
            item_id, item, copies = self.items[i]
            reach = np.zeros(len(item), bool)
            for _, p in seeds:
                reach[p:p + self.least] = True
            if reach.sum() < self.coverage * len(item):
                continue  # tiles lie within shared seeds, so they cannot cover more
            tiles = self._tiles(item, ids, sorted({a for a, _ in seeds}))
            covered = sum(n for _, _, n in tiles)
            if covered >= self.coverage * len(item):
                out[d] += [(item_id, len(item), covered, covered / len(item),
                            [(p, t - starts[d], n) for p, t, n in tiles])] * copies
        return out

    def _whole(self, ids: np.ndarray, starts: np.ndarray, out: list[list[tuple]]) -> None:
        """Adds the short items that stand in each text."""
        for length, items in self.short.items():
            wanted = np.concatenate([self.seed_hashes(np.array(key), length) for key in items])
            at = np.flatnonzero(np.isin(self.seed_hashes(ids, length), wanted))
            seen = set()
            for a, d in zip(at.tolist(), (np.searchsorted(starts, at, "right") - 1).tolist()):
                key = tuple(ids[a:a + length].tolist())
                if key in items and (d, key) not in seen:
                    seen.add((d, key))
                    out[d] += [(item_id, length, length, 1.0, [(0, a - int(starts[d]), length)]) for item_id in items[key]]

    def _tiles(self, item: np.ndarray, ids: np.ndarray, seeds: list[int]) -> list[tuple[int, int, int]]:
        """Tiles of an item over the stretches of a text that its seeds cover."""
        parts, places, end = [], [], -1
        for a in seeds:
            if a > end:
                if parts:
                    parts.append(np.zeros(1, ids.dtype))
                    places.append(np.full(1, -1))
                end = a
            parts.append(ids[end:a + self.least])
            places.append(np.arange(end, a + self.least))
            end = a + self.least
        return [(p, int(where[t]), n) for where in (np.concatenate(places),)
                for p, t, n in greedy_tiles(item, np.concatenate(parts), self.least)]


def _leaks_of(text: Column, shared: Shared) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        index, out = shared.get(), []
        for _, part in slices(texts):
            rows = index.leaks(part.to_pylist())
            out.append(pa.array([[dict(zip(("item_id", "item_words", "covered_words", "coverage"), x[:4]),
                                       tiles=[dict(zip(("item_word", "doc_word", "words"), t)) for t in x[4]])
                                  for x in row] for row in rows], _LEAK))
        return pa.concat_arrays(out) if out else pa.array([], _LEAK)
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, LEAKS)(text)


def _word_count(texts: pa.Array) -> pa.Array:
    return pa.array([len(_WORDS(t.lower())) for _, part in slices(texts) for t in part.to_pylist()], pa.int64())


_word_count.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def _blocks(benchmark: DataFrame, item_id: str, text: str, least: int, coverage: float):
    """Broadcast item blocks, one after another. Equal items come once with their number, and a block ends
    before its words, counted as the index counts them, would go beyond BLOCK_WORDS."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    items = items.groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    items = stash(items.withColumn("words", F.arrow_udf(_word_count, "bigint")(F.col("text"))).where(F.col("words") > 0), "items")
    build = partial(TileIndex, least=least, coverage=coverage)
    block, held, some = [], 0, False
    for r in items.toLocalIterator():
        if block and held + r["words"] > BLOCK_WORDS:
            yield Shared(spark, block, build)
            block, held, some = [], 0, True
        block.append((r["item_id"], r["text"], r["copies"]))
        held += r["words"]
    if block or not some:
        yield Shared(spark, block, build)


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", least: int = MIN_TILE, coverage: float = MIN_COVERAGE) -> DataFrame:
    """One row for each document row and item that leaks into it."""
    ready(docs.sparkSession)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    return union_all(
        own.select("doc_id", F.explode(_leaks_of(F.col("_text"), shared)).alias("l")).select("doc_id", "l.*")
        for shared in _blocks(benchmark, item_id, item_text, least, coverage))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", least: int = MIN_TILE, coverage: float = MIN_COVERAGE) -> DataFrame:
    """The rows of ``docs`` into which no item leaks."""
    ready(docs.sparkSession)
    found = fresh_name(docs, "leaks")
    for shared in _blocks(benchmark, item_id, item_text, least, coverage):
        docs = docs.withColumn(found, _leaks_of(F.col(text), shared)).where(F.size(found) == 0).drop(found)
    return docs
