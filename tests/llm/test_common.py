"""Slices are bounded by rows and bytes, and results do not depend on where they are cut."""
import pyarrow as pa
import pytest

from epicohort.llm import common as C


def cut(values, **kw):
    got = [(start, part.to_pylist() if isinstance(part, pa.Array) else list(part)) for start, part in C.slices(values, **kw)]
    assert [x for _, part in got for x in part] == (values.to_pylist() if isinstance(values, pa.Array) else list(values))
    assert [s for s, _ in got] == [sum(len(p) for _, p in got[:i]) for i in range(len(got))]
    return [len(p) for _, p in got]


def test_slices_end_at_rows_and_bytes():
    texts = pa.array(["aaaa", None, "", "bbbb", "c" * 100, "dd", "é" * 4, "f"])
    assert cut(texts, most=8) == [4, 1, 1, 1, 1]
    assert cut(texts, size=3, most=1000) == [3, 3, 2]
    assert cut(texts.slice(2, 4), most=8) == [2, 1, 1]
    assert cut(texts.cast(pa.binary()), most=1) == [1, 2, 1, 1, 1, 1, 1]
    assert cut([1, 2, 3, 4], size=3) == [3, 1]
    assert cut(pa.array([], pa.string())) == []


TEXTS = ["", None, "Plain prose about rivers and hills, and nothing else. " * 30, "menu | home | about\n" * 9, "x" * 5_000, "wörter ähnlich " * 80,
         "you damn f00l!! " * 40, "one\ntwo\none\ntwo three four", "a b c a b c a b c a b c"]


@pytest.mark.parametrize("module", ["rules", "periodic"])
def test_results_do_not_depend_on_the_byte_bound(monkeypatch, module):
    import importlib
    texts = pa.array(TEXTS * 3, pa.string())
    m = importlib.import_module(f"epicohort.llm.{module}")
    whole = m._run(texts)
    monkeypatch.setattr(C, "SLICE_BYTES", 64)
    if module == "periodic":
        monkeypatch.setattr(m, "PART_BYTES", 64)
    assert m._run(texts) == whole


def test_languages_and_codec_do_not_depend_on_the_cut():
    import numpy as np

    from epicohort.llm import langid
    draw = np.random.default_rng(0)
    model = langid.Languages(["aa", "bb", "cc"], draw.integers(0, 50, (3, langid.BUCKETS)).astype(float))
    texts = [t or "" for t in TEXTS]
    assert model.compositions(texts) == [model.compositions([t])[0] for t in texts]
    from epicohort.llm import bpe
    ranks = {bytes([i]): i for i in range(256)} | {b"he": 256, b"in": 257, b" a": 258, b"an": 259, b" an": 260, b"and": 261, b" and": 262}
    codec = bpe.Codec(ranks, r" ?\w+|\s+|[^\w\s]+")
    together = codec.encode_all(texts)
    assert together == [bpe.Codec(ranks, r" ?\w+|\s+|[^\w\s]+").encode(t) for t in texts]
