"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Merges of one pre-token are taken in the order of their rank, leftmost first
among equal ranks. The queue keeps one bucket of positions for each rank and a
tree of bitmap words that says which buckets hold something; find-first-set
on one word of each level gives the lowest rank, whatever the length of the
pre-token, and its bucket is emptied from left to right. An entry whose pair has
changed since it was queued is stale and is skipped when it comes up, so nothing
is ever searched for or removed early. All pre-tokens of some texts that are not
remembered go through one queue, whatever their length, each once.

Defined results: a null text encodes to null (callers who want it empty
coalesce it), the empty text to no ids; a very long text or pre-token goes through
the same queue; repeated rows each get their own result; an empty table gives an empty one.
"""

from __future__ import annotations

import base64
from functools import partial
from operator import add
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epicohort.llm.common import Shared, fresh_name, ready, slices

#: Ranks under one word of the bitmap's lower level: 2 ** SHIFT.
SHIFT = 8
#: Pre-tokens of each of the two generations that a worker remembers, and the longest that it does.
MEMO_ENTRIES, MEMO_CHARS = 200_000, 48
#: Bytes of new pre-tokens that are merged in one queue (one pre-token at least).
QUEUE_BYTES = 1 << 14
#: Stands between two pre-tokens: no Latin-1 character, so part of no token.
GAP = "\u0100"
#: Letters and numbers newer than Unicode 16, the version of the library's own tables.
NEWER_LETTERS = ("\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
                 "\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee"
                 "\U00011b0a\U00011db0-\U00011ddb\U00011df1\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3"
                 "\U00016ff2-\U00016ff3\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
                 "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168"
                 "\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
                 "\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed"
                 "\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead"
                 "\U000323b0-\U00033479\U0003d000-\U0003fc3f")
NEWER_NUMBERS = ("\U00011de0-\U00011de9\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ff4-\U00016ff6")


_NOTHING: dict[int, int] = {}


class Codec(dict):
    """Encoder and decoder for one rank table; as a dict it remembers the packed
    ids (little-endian unsigned 32-bit) of recent short pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        super().__init__()
        #: Ranks by the token's bytes as Latin-1 characters, so that a gap can be a character of its own.
        self.ranks = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.newer = regex.compile(f"[{NEWER_LETTERS}{NEWER_NUMBERS}]").search
        older = pattern.replace(r"^\s\p{L}\p{N}", rf"[^\s\p{{L}}\p{{N}}]||[{NEWER_LETTERS}{NEWER_NUMBERS}]")
        older = older.replace(r" ?\p{L}", rf" ?[\p{{L}}--[{NEWER_LETTERS}]]").replace(r" ?\p{N}", rf" ?[\p{{N}}--[{NEWER_NUMBERS}]]")
        self.split_older = regex.compile(older, regex.V1).findall
        n = max(ranks.values(), default=-1) + 1
        # the rank queue: positions by rank, a bit for each rank that has any; a bit for each word that has any is merge()'s
        self.buckets: list[list[int] | None] = [None] * n
        self.words = [0] * ((n >> SHIFT) + 1)
        self.vocabulary: list[bytes | None] = [None] * n
        #: By token: what it becomes with the token behind it, and with the token before it.
        self.with_next: list[dict[int, int]] = [_NOTHING] * n
        self.with_last: list[dict[int, int]] = [_NOTHING] * n
        for token, rank in ranks.items():
            self.vocabulary[rank] = token
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    if self.with_next[a] is _NOTHING:
                        self.with_next[a] = {}
                    if self.with_last[b] is _NOTHING:
                        self.with_last[b] = {}
                    self.with_next[a][b] = self.with_last[b][a] = rank
        #: What was remembered before the last change of generations.
        self.before: dict[str, bytes] = {}

    def merge(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of several pre-tokens, each the Latin-1 text of its bytes.
        All share one queue: it takes the lowest rank of all, leftmost first, which for
        each pre-token alone is its own order. A gap between two is in no token, so no pair reaches over it."""
        rank_of, buckets, words, mask = self.ranks.get, self.buckets, self.words, (1 << SHIFT) - 1
        text = GAP + GAP.join(pieces) + GAP
        n = len(text)
        token = list(map(rank_of, text))  # rank of the part that starts here; -1 inside a part, None at a gap
        if token.count(None) != len(pieces) + 1:
            raise ValueError("the rank table lacks a single byte")
        end = list(range(1, n + 1))  # where the part that starts here ends
        before = list(range(-1, n - 1))  # where the part to the left of here starts
        pair = list(map(rank_of, map(add, text, text[1:])))  # rank of the part that starts here joined with the next one
        pair.append(None)
        top = self._fill(pair)
        while top:
            w = (top & -top).bit_length() - 1
            low = words[w] & -words[w]
            rank = (w << SHIFT) + low.bit_length() - 1
            bucket = buckets[rank]
            bucket.sort()
            with_next, with_last = self.with_next[rank].get, self.with_last[rank].get
            rest = None
            for at, i in enumerate(bucket):
                if pair[i] != rank:
                    continue  # stale
                j = end[i]
                k = end[i] = end[j]
                before[k] = i
                h = before[i]
                token[i], token[j], pair[j] = rank, -1, None
                pair[i] = right = with_next(token[k])
                if right is not None:
                    others = buckets[right]
                    if others is None:
                        buckets[right] = [i]
                        words[right >> SHIFT] |= 1 << (right & mask)
                        top |= 1 << (right >> SHIFT)
                    else:
                        others.append(i)
                    if right < rank:
                        rest = bucket[at + 1:]
                pair[h] = left = with_last(token[h])
                if left is not None:
                    others = buckets[left]
                    if others is None:
                        buckets[left] = [h]
                        words[left >> SHIFT] |= 1 << (left & mask)
                        top |= 1 << (left >> SHIFT)
                    else:
                        others.append(h)
                    if left < rank:
                        rest = bucket[at + 1:]
                if rest is not None:
                    break  # a lower rank comes before the rest of this bucket
            if rest:
                buckets[rank] = rest
            else:
                buckets[rank] = None
                words[w] ^= low
                if not words[w]:
                    top ^= 1 << w
        parts = np.array([-2 if t is None else t for t in token], np.int64)
        parts = parts[parts != -1]
        gaps = (4 * np.flatnonzero(parts == -2)).tolist()
        packed = parts.astype("<u4").tobytes()
        return [packed[a + 4:b] for a, b in zip(gaps, gaps[1:])]

    def _fill(self, pair: list[int | None]) -> int:
        """Queue every pair that has a rank; the bits of the words in use."""
        ranks = np.array([-1 if r is None else r for r in pair], np.int64)
        order = np.argsort(ranks, kind="stable")
        order = order[np.searchsorted(ranks[order], 0):]
        if not len(order):
            return 0
        inorder = ranks[order]
        cuts = np.flatnonzero(np.diff(inorder)) + 1
        top = 0
        for rank, positions in zip(inorder[np.concatenate([[0], cuts])].tolist(), np.split(order, cuts)):
            self.buckets[rank] = positions.tolist()
            self.words[rank >> SHIFT] |= 1 << (rank & ((1 << SHIFT) - 1))
            top |= 1 << (rank >> SHIFT)
        return top

    def learn(self, pre_tokens: set[str]) -> list[str]:
        """Remember the ids of these pre-tokens; returns the long ones, to be forgotten after use.
        When the memory is full, the pre-tokens of before make room but can still be asked for until it is full again."""
        missing = pre_tokens.difference(self)
        if len(self) + len(missing) > MEMO_ENTRIES:
            self.before = dict(self)
            self.clear()
            missing = pre_tokens
        fresh, held = [], 0
        waiting: list[tuple[str, str]] = []
        for t in missing:
            known = self.before.get(t)
            if known is not None:
                self[t] = known
                continue
            piece = t.encode().decode("latin-1")
            whole = self.ranks.get(piece)
            if whole is not None:
                self[t] = pack("<I", whole)
                continue
            if waiting and held + len(piece) > QUEUE_BYTES:
                self._settle(waiting)
                waiting, held = [], 0
            waiting.append((t, piece))
            held += len(piece)
            if len(t) > MEMO_CHARS:
                fresh.append(t)
        if waiting:
            self._settle(waiting)
        return fresh

    def _settle(self, waiting: list[tuple[str, str]]) -> None:
        for (t, _), packed in zip(waiting, self.merge([piece for _, piece in waiting])):
            self[t] = packed

    def pre_tokens(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if self.newer(text):
                return self.split_older(text)
        return self.split(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; every pre-token of all of them is merged once at most."""
        split = [self.pre_tokens(t) for t in texts]
        long = self.learn(set().union(*split))
        ids_of = self.__getitem__
        out = [b"".join(map(ids_of, own)) for own in split]
        for t in long:
            del self[t]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def read_ranks(path: str) -> bytes:
    """The rank file's bytes (one base64 token and its rank on each line, some MB at most)."""
    with open(path, "rb") as f:
        return f.read()


def codec_of(rank_file: bytes, pattern: str) -> Codec:
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, rank_file.splitlines())}
    return Codec(ranks, pattern)


class BytePairEncoding:
    """BPE column functions for one rank file; the file is read on the driver and broadcast."""

    def __init__(self, spark: SparkSession, ranks_path: str, pattern: str):
        ready(spark)
        self._shared = Shared(spark, read_ranks(ranks_path), partial(codec_of, pattern=pattern))

    def encode(self, text: Column) -> Column:
        """Packed ids of a text: 4 bytes each, little-endian, unsigned."""
        shared = self._shared

        def run(texts: pa.Array) -> pa.Array:
            codec, out = shared.get(), []
            for _, part in slices(texts):
                own = part.to_pylist()
                coded = iter(codec.encode_all([t for t in own if t is not None]))
                out += [None if t is None else next(coded) for t in own]
            return pa.array(out, pa.binary())
        run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
        # not deterministic, as far as Spark is told: or it would encode once for the ids and again for decode(ids)
        return F.arrow_udf(run, "binary").asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """The bytes that packed ids stand for."""
        shared = self._shared

        def run(packed: pa.Array) -> pa.Array:
            codec, out = shared.get(), []
            for _, part in slices(packed):
                out += [None if t is None else codec.decode(t) for t in part.to_pylist()]
            return pa.array(out, pa.binary())
        run.__annotations__ = {"packed": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "binary")(ids)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text",
                     ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the packed ids of each whole text (null: as the empty text)
    and, if asked for, the bytes they decode to. A new column whose name is taken
    gets a number behind it."""
    bpe = BytePairEncoding(docs.sparkSession, ranks_path, pattern)
    ids = fresh_name(docs, ids)
    out = docs.withColumn(ids, bpe.encode(F.coalesce(F.col(text), F.lit(""))))
    return out if decoded is None else out.withColumn(fresh_name(out, decoded), bpe.decode(F.col(ids)))
