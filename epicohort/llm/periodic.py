"""Periodic runs of words by the dictionary of basic factors.

A run is a stretch of words with smallest period q that is at least ``LEAST_POWER``
periods and ``LEAST_WORDS`` words long and that no neighbouring word extends.
The dictionary of basic factors names every stretch of 2 ** k words: equal
stretches have equal names, and a name of level k + 1 is a pair of names of level
k. Inside a run of period q, the stretch of 2 ** k >= q words at a place comes
again q words later and not before (else the period would be smaller), then again, as far
as the run goes: its successors form an arithmetic progression. So on each level
the places whose next two successors are equally far, at most twice the
stretch's length, propose that distance as period; a proposal is extended both
ways as far as words are equal that far apart, kept if it is long enough, and found
runs are counted once. A place whose stretch comes only once in its text is
part of no longer stretch that comes twice, so it leaves the dictionary; of
ordinary prose little is left after three levels.

The texts of a batch are worked on together, in parts of at most ``PART_BYTES`` of
text (one text at least): what a worker holds is set by that, or by its longest text.

Defined results: a null or empty text, or one without words, has no runs and
collapses to the empty text; runs that overlap or nest each count and a word goes
if one of them says so; repeated rows each get a result; a column whose name is taken gets a
number behind it; an empty table gives an empty one. ``repeat_tail`` leaves a
text without an id as it is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import fresh_name, ready, slices

LEAST_WORDS, LEAST_POWER = 6, 4
#: Text that is worked on at a time.
PART_BYTES = 1 << 20
#: Words are runs of bytes other than ASCII white space.
WHITE = r"[\x20\x09-\x0D]+"

RUNS = "struct<runs:array<struct<start:bigint,length:bigint,period:bigint>>,collapsed:string>"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = pa.struct([("runs", pa.list_(_RUN)), ("collapsed", pa.string())])


def _proposals(words: np.ndarray):
    """(place, distance) of the progressions of every level, for word names in
    which a text's words are its own and a stretch over two texts never comes twice."""
    n = len(words)
    distance = np.zeros(n, np.int64)  # to the next place with the same name, where that is near
    at_place = np.full(n, -1, np.int64)
    names, places, length = words, np.arange(n), 1
    while len(places) > 1:
        order = np.argsort(names, kind="stable")
        differs = names[order[1:]] != names[order[:-1]]
        # the next place with the same name
        some, after = places[order[:-1][~differs]], places[order[1:][~differs]]
        far = after - some
        near = (far <= 2 * length) & (2 * far > length)
        some, far = some[near], far[near]
        distance[some] = far
        # three equal names in a row, equally far; of neighbouring places with one distance the first
        chained = distance[some + far] == far
        starts, steps = some[chained], far[chained]
        distance[some] = 0
        if len(starts):
            by_place = np.argsort(starts)
            starts, steps = starts[by_place], steps[by_place]
            first = np.ones(len(starts), bool)
            first[1:] = (starts[1:] != starts[:-1] + 1) | (steps[1:] != steps[:-1])
            yield from zip(starts[first].tolist(), steps[first].tolist())
        # names that come once are done; the others pair up for the next level
        in_order = np.concatenate([[0], np.cumsum(differs)])
        number = np.empty(len(places), np.int64)
        number[order] = in_order
        again = np.bincount(in_order)[number] > 1
        places, number = places[again], number[again]
        if not len(places):
            return
        at_place[places] = number
        second = np.where(places + length < n, at_place[np.minimum(places + length, n - 1)], -1)
        at_place[places] = -1
        pairs = second >= 0
        names = number[pairs] * np.int64(in_order[-1] + 1) + second[pairs]
        places, length = places[pairs], 2 * length


def _reach(words: np.ndarray, a: int, b: int, step: int, most: int) -> int:
    """How many words from a and b on, in direction ``step``, are equal, ``most`` at most."""
    done, size = 0, 64
    while done < most:
        size = min(size, most - done)
        if step > 0:
            differ = np.flatnonzero(words[a + done:a + done + size] != words[b + done:b + done + size])
            if len(differ):
                return done + int(differ[0])
        else:
            differ = np.flatnonzero(words[a - done - size + 1:a - done + 1] != words[b - done - size + 1:b - done + 1])
            if len(differ):
                return done + size - 1 - int(differ[-1])
        done, size = done + size, 2 * size
    return most


def runs_of(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs, by start and period, for word names as in ``_proposals``."""
    found: set[tuple[int, int, int]] = set()
    last: dict[int, tuple[int, int]] = {}  # by period: the stretch that was extended last
    for place, period in _proposals(words):
        start, end = last.get(period, (0, 0))
        if not start <= place < end - period:
            start = place - _reach(words, place - 1, place - 1 + period, -1, place)
            end = place + period + _reach(words, place, place + period, 1, len(words) - place - period)
            last[period] = start, end
        if end - start >= max(LEAST_WORDS, LEAST_POWER * period):
            found.add((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _judge(texts: list[bytes | None]) -> tuple[list[list[tuple[int, int, int]]], list[str]]:
    """Runs and collapsed text of some texts, found in one dictionary."""
    split = [(t or b"").split() for t in texts]
    number: dict[bytes, int] = {}
    ids: list[int] = []
    starts = []
    for words in split:
        starts.append(len(ids))
        ids += [number.setdefault(w, len(number)) for w in words]
        ids.append(-1)  # no stretch reaches over the end of a text
    names = np.array(ids, np.int64)
    owner = np.repeat(np.arange(len(split)), np.diff(np.array([*starts, len(ids)])))
    ends = names < 0
    names = owner * np.int64(len(number) + 1) + names
    names[ends] = -1 - np.arange(int(ends.sum()))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in split]
    for start, length, period in runs_of(names):
        d = int(owner[start])
        runs[d].append((start - starts[d], length, period))
    collapsed = []
    for words, own in zip(split, runs):
        if own:
            keep = np.ones(len(words), bool)
            for start, length, period in own:
                keep[start + period:start + length] = False
            words = [words[i] for i in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(words).decode())
    return runs, collapsed


def _run(texts: pa.Array) -> pa.Array:
    out = []
    for _, part in slices(texts.cast(pa.binary()), most=PART_BYTES):
        runs, collapsed = _judge(part.to_pylist())
        lists = pa.array([[dict(zip(("start", "length", "period"), r)) for r in own] for own in runs], _RESULT.field("runs").type)
        out.append(pa.StructArray.from_arrays([lists, pa.array(collapsed, pa.string())], fields=list(_RESULT)))
    return pa.concat_arrays(out) if out else pa.array([], _RESULT)


_run.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with two more columns, the last ones: the runs of each text (by
    start, then period) and the text without the words that a run repeats,
    joined by one space."""
    ready(docs.sparkSession)
    found = fresh_name(docs, "periodic")
    judged = docs.withColumn(found, F.arrow_udf(_run, RUNS).asNondeterministic()(F.col(text)))
    runs, collapsed = fresh_name(docs, "runs"), fresh_name(docs, "collapsed")
    return judged.select(*docs.columns, F.col(f"{found}.runs").alias(runs), F.col(f"{found}.collapsed").alias(collapsed))


def repeat_tail(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the text of every tenth id (by h, the crc32 of its decimal) made
    periodic from a word on: of n words each word i >= a becomes word
    a + (i - a) % p, where g = h // 10, a = g % n, p = 1 + (n - a) // (3 + g % 8)."""
    w, n, a, p = (fresh_name(docs, c) for c in ("_w", "_n", "_a", "_p"))
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    chosen = (h % 10 == 0) & F.rlike(F.col(text), F.lit(r"[^\x20\x09-\x0D]"))
    trimmed = F.regexp_replace(F.col(text), rf"^{WHITE}|{WHITE}$", "")
    cut = docs.withColumn(w, F.when(chosen, F.split(trimmed, WHITE, -1))).withColumn(n, F.when(F.col(w).isNotNull(), F.size(w)))
    cut = cut.withColumn(a, (g % F.col(n)).cast("int"))
    cut = cut.withColumn(p, (1 + F.floor((F.col(n) - F.col(a)) / (3 + g % 8))).cast("int"))
    copies = F.ceil((F.col(n) - F.col(a)) / F.col(p)).cast("int")
    tail = F.flatten(F.array_repeat(F.slice(w, F.col(a) + 1, F.col(p)), copies))
    repeated = F.array_join(F.slice(F.concat(F.slice(w, F.lit(1), F.col(a)), tail), F.lit(1), F.col(n)), " ")
    return cut.withColumn(text, F.when(F.col(w).isNotNull(), repeated).otherwise(F.col(text))).drop(w, n, a, p)
