"""Language identification as a mixture of languages.

Each language is a distribution over hashed letter trigrams, counted on
labelled texts. A document's trigrams come from a mixture of languages, whose
proportions expectation-maximisation finds. Which languages belong to the
document is settled by penalised likelihood: starting from all of them, the
least language is put out, and the rest fitted again, as long as the
log-likelihood lost is below the penalty for a language. The prediction is
the largest proportion left, and the score that proportion; the languages left
and their proportions are results too. A fit ends when its log-likelihood is
known to be within ``SETTLED`` of the greatest one: it is concave in the
proportions, so its steepest slope bounds what is missing.

Trigrams run over lower-cased letters with one space between words, so each
letter counts about three times; log-likelihoods are divided by three before
the penalty (half the log of the letters, for each language) is set against them.

Defined results: a null text or one without a letter is ``und`` with score 0,
as is every text where nothing was learned; equal proportions go to the
language with more training documents, then to the first by name; rows without
a language are not learned from; repeated rows each get a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import Shared, fresh_name, hash_share, ready, slices

#: Trigram buckets: the model of a language has so many numbers, whatever the corpus.
BUCKETS = 1 << 15
#: Training documents of a language that are counted, in expectation (a bounded sample by hash of the id).
SAMPLE_PER_LANGUAGE = 5_000
SMOOTHING = 0.2
#: What a fit's log-likelihood (in letters, as the penalty) may be short of the greatest one.
SETTLED = 0.01
#: Bytes of text times languages that are worked on at a time (one text at least).
SLICE_TRIGRAMS = 8 << 20
UNKNOWN = "und"

_SEEN: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if "letters" not in _SEEN:
        table = np.zeros(0x110000, bool)
        table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
        _SEEN["letters"] = table
    return _SEEN["letters"]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all trigrams of the texts, one text behind the other, and where each text starts (one more entry)."""
    joined = "\0" + "\0".join(t.lower().replace("\0", " ") if t else "" for t in texts) + "\0"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[cps]
    before = np.concatenate(([False], letter[:-1]))
    stop = cps == 0
    keep = letter | before | stop
    folded = np.where(letter, cps, np.uint32(32))[keep].astype(np.uint32)
    bounds = np.flatnonzero(stop[keep])
    a, b, c = folded[:-2], folded[1:-1], folded[2:]
    hashed = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + (c * np.uint32(0xC2B2AE3D)))
    hashed ^= hashed >> np.uint32(15)
    buckets = ((hashed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 15)).astype(np.int32)
    # a text's trigrams lie between its bounds, which stand for the spaces around it; those of two texts are left out
    at = np.arange(len(buckets))
    own = np.searchsorted(bounds, at, "right") - 1
    inside = at + 2 <= np.append(bounds, len(folded))[np.minimum(own + 1, len(bounds))]
    some = folded[1:-1] != 32  # a trigram has its letter in the middle
    use = inside & some
    return buckets[use], np.searchsorted(own[use], np.arange(len(texts) + 1), "left")


def profile_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """lang, bucket, n over the documents; each task adds up its own before the shuffle."""
    schema = "lang string, bucket int, n bigint"

    def run(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for start, part in slices(batch.column("text")):
                buckets, starts = trigrams(part.to_pylist())
                for k in range(len(part)):
                    add = np.bincount(buckets[starts[k]:starts[k + 1]], minlength=BUCKETS)
                    totals[langs[start + k]] = totals.get(langs[start + k], 0) + add
            if len(totals) * BUCKETS > 1 << 23:
                yield from _rows(totals)
                totals = {}
        yield from _rows(totals)

    def _rows(totals):
        for name, counts in totals.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int32()),
                                              pa.array(counts[at], pa.int64())], ["lang", "bucket", "n"])
    own = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return own.mapInArrow(run, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Languages:
    """Learned trigram distributions: ``chance[l, bucket]``, languages in the order of their training documents."""

    def __init__(self, names: list[str], counts: np.ndarray):
        self.names = names
        smooth = counts + SMOOTHING
        self.chance = smooth / smooth.sum(axis=1, keepdims=True) if len(names) else counts

    def mixtures(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Prediction and score of each text."""
        return [own[0] if own else (UNKNOWN, 0.0) for own in self.compositions(texts)]

    def compositions(self, texts: list[str | None]) -> list[list[tuple[str, float]]]:
        """The languages that belong to each text with their proportions, largest first."""
        buckets, starts = trigrams(texts)
        out: list[list[tuple[str, float]]] = [[] for _ in texts]
        rows = np.flatnonzero(np.diff(starts) > 0)
        if not len(rows) or not self.names:
            return out
        cols, counts, sizes = [], [], []
        for r in rows.tolist():
            own = np.bincount(buckets[starts[r]:starts[r + 1]], minlength=BUCKETS)
            at = np.flatnonzero(own)
            cols.append(at)
            counts.append(own[at])
            sizes.append(len(at))
        chance = self.chance.T[np.concatenate(cols)]
        n = np.concatenate(counts).astype(np.float64)
        share, chosen = self._select(chance, n, np.array(sizes))
        order = np.argsort(np.where(chosen, -share, 2), axis=1, kind="stable")
        for k, r in enumerate(rows.tolist()):
            out[r] = [(self.names[j], float(min(1.0, share[k, j]))) for j in order[k, :chosen[k].sum()].tolist()]
        return out

    @staticmethod
    def _fit(chance, n, sizes, share):
        """Proportions of the greatest likelihood among the languages that have any in ``share``, where
        expectation-maximisation (with squared extrapolation) begins, and each document's log-likelihood under them."""
        share, like, left = share.copy(), np.empty(len(sizes)), np.arange(len(sizes))

        def layout():
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            return first, np.repeat(np.arange(len(sizes)), sizes), np.add.reduceat(n, first)

        def step(p):
            """Log-likelihoods under ``p``, their slopes, and the next proportions."""
            part = np.einsum("ij,ij->i", chance, p[doc])
            slope = np.add.reduceat(chance * (n / part)[:, None], first)
            return np.add.reduceat(n * np.log(part), first), slope, p * slope / total[:, None]
        first, doc, total = layout()
        p = share
        while True:
            now, slope, p1 = step(p)
            # SETTLED is in letters; sums of many terms are no nearer than their rounding
            short = np.where(p > 0, slope, 0).max(axis=1) - total
            done = short <= np.maximum(3 * SETTLED, 1e-12 * np.abs(now))
            share[left[done]], like[left[done]] = p[done], now[done]
            if done.any():
                keep = np.repeat(~done, sizes)
                chance, n, sizes, left = chance[keep], n[keep], sizes[~done], left[~done]
                p, p1 = p[~done], p1[~done]
                if not len(left):
                    return share, like
                first, doc, total = layout()
            base, _, p2 = step(p1)
            r, v = p1 - p, p2 - 2 * p1 + p
            size = np.sqrt((v * v).sum(axis=1))
            far = np.maximum(1.0, np.sqrt((r * r).sum(axis=1)) / np.where(size > 0, size, np.inf))[:, None]
            ahead = np.maximum(p + 2 * far * r + far * far * v, 0.1 * p2)
            ahead /= ahead.sum(axis=1, keepdims=True)
            reached, _, ahead = step(ahead)
            p = np.where((reached >= base)[:, None], ahead, p2)

    def _select(self, chance, n, sizes):
        n_docs, n_langs = len(sizes), len(self.names)
        doc = np.repeat(np.arange(n_docs), sizes)
        penalty = 0.5 * np.log(np.maximum(np.bincount(doc, n) / 3, 2))
        share, like = self._fit(chance, n, sizes, np.full((n_docs, n_langs), 1 / n_langs))
        chosen = np.ones((n_docs, n_langs), bool)
        rest = np.arange(n_docs if n_langs > 1 else 0)
        while len(rest):
            least = np.where(chosen[rest], share[rest], 2).argmin(axis=1)
            fewer = chosen[rest].copy()
            fewer[np.arange(len(rest)), least] = False
            begin = np.where(fewer, np.maximum(share[rest], 1e-6), 0)
            begin /= begin.sum(axis=1, keepdims=True)
            use = np.isin(doc, rest)
            new, new_like = self._fit(chance[use], n[use], sizes[rest], begin)
            drop = (like[rest] - new_like) / 3 < penalty[rest]
            gone = rest[drop]
            share[gone], like[gone], chosen[gone] = new[drop], new_like[drop], fewer[drop]
            rest = gone[chosen[gone].sum(axis=1) > 1]
        return share, chosen


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
          sample: int = SAMPLE_PER_LANGUAGE) -> Languages:
    """Languages of the labelled rows of ``docs``. About ``sample`` documents of each are counted, chosen by a hash of their id."""
    ready(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(F.col(lang).cast("string")).count().collect()}
    names = sorted(sizes, key=lambda k: (-sizes[k], k))
    if not names:
        return Languages([], np.zeros((0, BUCKETS)))
    rate = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, sample / sizes[k]))])
    picked = labelled.where(hash_share(F.col(doc_id), "language") < rate[F.col(lang).cast("string")])
    counts = np.zeros((len(names), BUCKETS))
    place = {k: i for i, k in enumerate(names)}
    table = profile_counts(picked, text, lang).toArrow()  # languages times buckets rows at most
    if table.num_rows:
        row = np.array([place[k] for k in table["lang"].to_pylist()])
        counts[row, table["bucket"].to_numpy()] = table["n"].to_numpy()
    return Languages(names, counts)


def predict(text: Column, model: Languages, spark) -> Column:
    """struct(lang_pred, score, languages, proportions) of a whole text; the last two are arrays of the
    languages that belong to it and of their proportions, largest first (empty for ``und``)."""
    shared = Shared(spark, model, lambda own: own)

    def run(texts: pa.Array) -> pa.Array:
        languages, out = shared.get(), []
        # a trigram takes a number for each language
        for _, part in slices(texts, most=max(SLICE_TRIGRAMS // max(len(languages.names), 1), 1)):
            out += languages.compositions(part.to_pylist())
        top = [own[0] if own else (UNKNOWN, 0.0) for own in out]
        return pa.StructArray.from_arrays([pa.array([x[0] for x in top], pa.string()), pa.array([x[1] for x in top], pa.float64()),
                                           pa.array([[x[0] for x in own] for own in out], pa.list_(pa.string())),
                                           pa.array([[x[1] for x in own] for own in out], pa.list_(pa.float64()))],
                                          ["lang_pred", "score", "languages", "proportions"])
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "struct<lang_pred:string,score:double,languages:array<string>,proportions:array<double>>") \
        .asNondeterministic()(text)


def keep_identified(docs: DataFrame, model: Languages, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` most of whose text is in one learned language."""
    name = fresh_name(docs, "language")
    judged = docs.withColumn(name, predict(F.col(text), model, docs.sparkSession))
    return judged.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).drop(name)
