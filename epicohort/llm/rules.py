"""Quality rules, line first: judge every line, drop those that fail, then
reject documents that lose too much of their text.

Words are runs of bytes other than ASCII white space (space and \\x09-\\x0d).
A line fails if it is
* boilerplate: it holds one of the phrases of ``BOILERPLATE``;
* navigation: at least three ``|`` or ``>`` separators that stand as words, and no more than four words for each;
* badly punctuated: more than one of ``!?`` for every two words over at least three words, or symbols of ``#*$%&|<>`` that are more than a tenth of its characters in words;
* a repeat of an earlier line of at least three words.
A document is rejected if the lines that fail hold more than half of its word
characters, or if fewer than ``MIN_WORDS`` words stay, besides the base rules.

Defined results: a null text has no words and is rejected, as is the empty one;
a document of one very long line is one line; equal lines are ties of which the
first stays; repeated rows each get a result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from epicohort.llm.common import fresh_name, ready, slices

#: Phrases that mark a line as boilerplate, compared without case.
BOILERPLATE = ("all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies",
               "enable javascript", "javascript is disabled", "subscribe to our newsletter", "sign up for our newsletter",
               "click here to", "lorem ipsum", "skip to content", "back to top", "powered by")
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT, LOST_SHARE = 50, 0.5

_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)).encode(), re.IGNORECASE)

RESULT = ("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,"
          "lines_removed:bigint,lost_chars:bigint,base_failed:boolean,kept:boolean,cleaned:string>")
_ARROW = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
                    ("n_repeat_words", pa.int64()), ("lines_removed", pa.int64()), ("lost_chars", pa.int64()),
                    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())])


def word_code_points(words: list[bytes]) -> int:
    joined = b"".join(words)
    return len(joined) if joined.isascii() else len(joined.decode())


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    total, covered = 0, 0  # covered: words up to here are counted
    for i, w in enumerate(windows):
        if w in twice:
            total += i + 3 - max(covered, i)
            covered = i + 3
    return total


def line_fails(line: bytes, words: list[bytes]) -> bool:
    """The rules that need the line alone."""
    n = len(words)
    if n >= 3 and 2 * (line.count(b"!") + line.count(b"?")) > n:
        return True
    if line.translate(None, SYMBOLS) != line:
        bars = words.count(b"|") + words.count(b">")
        if bars >= 3 and n <= 5 * bars:
            return True
        symbols = len(line) - len(line.translate(None, SYMBOLS))
        if 10 * symbols > word_code_points(words):
            return True
    return _BOILERPLATE.search(line) is not None


def judge(text: bytes | None) -> tuple:
    """The result's fields for one document."""
    text = text or b""
    words = text.split()
    word_chars = word_code_points(words)
    lines = [(line, own) for line in text.split(b"\n") if (own := line.split())]
    seen: set[bytes] = set()
    stays, lost, duplicates = [], 0, 0
    for line, own in lines:
        again = line in seen
        seen.add(line)
        duplicates += again
        if (again and len(own) >= 3) or line_fails(line, own):
            lost += word_code_points(own)
        else:
            stays.append((line, len(own)))
    repeats = repeated_words(words)
    base_failed = len(words) < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    kept = not base_failed and lost <= LOST_SHARE * word_chars and sum(n for _, n in stays) >= MIN_WORDS
    cleaned = b"\n".join(line for line, _ in stays)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    return (len(words), word_chars, symbols, duplicates, repeats, len(lines) - len(stays), lost, base_failed, kept, cleaned.decode())


def _run(texts: pa.Array) -> pa.Array:
    out = []
    for _, part in slices(texts):
        rows = [judge(t) for t in part.cast(pa.binary()).to_pylist()]
        out.append(pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], fields=list(_ARROW)))
    return pa.concat_arrays(out) if out else pa.array([], _ARROW)


_run.__annotations__ = {"texts": pa.Array, "return": pa.Array}


def clean_lines(text: Column) -> Column:
    """RESULT of a text: counts, verdict, and the text of the lines that stay."""
    # not deterministic, as far as Spark is told: or a filter on the verdict would judge the text once more
    return F.arrow_udf(_run, RESULT).asNondeterministic()(text)


def quality_results(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the result in a column of a free name (see ``clean_lines``); it is the last one."""
    ready(docs.sparkSession)
    return docs.withColumn(fresh_name(docs, "quality_result"), clean_lines(F.col(text)))


def clean_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """The documents that are kept, with the text of their lines that stay (and its length)."""
    judged = quality_results(docs, text)
    result = judged.columns[-1]
    out = {text: F.col(f"{result}.cleaned")}
    if n_chars in docs.columns:
        out[n_chars] = F.char_length(F.col(f"{result}.cleaned")).cast(docs.schema[n_chars].dataType)
    return judged.where(F.col(f"{result}.kept")).withColumns(out).drop(result)
