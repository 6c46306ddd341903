import base64
import hashlib
import random
import struct

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from epicohort.llm import bpe  # noqa: E402

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def both():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.Codec(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_random_texts_match_the_library(both):
    codec, library = both
    draw = random.Random(1)
    for _ in range(400):
        text = "".join(draw.choice("aAbeé ñß\n\t  's'reа語1½٣aaaaааа!?\U00018d80") for _ in range(draw.choice([0, 1, 5, 60, 400])))
        assert ids(codec.encode(text)) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)).decode() == text


@pytest.mark.parametrize("text", ["a" * 20_000, "ab" * 10_000, " " * 10_000, "é" * 8_000, "thequickbrownfox" * 1_500])
def test_very_long_pre_tokens(both, text):
    codec, library = both
    assert ids(codec.encode(text)) == library.encode_ordinary(text)
    assert not any(x is not None for x in codec.buckets) and not any(codec.words)


def test_stale_entries_and_ties_with_a_small_table():
    ranks = {bytes([i]): i for i in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"aaaa": 259}
    library = tiktoken.Encoding("small", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    codec, draw = bpe.Codec(ranks, r"\S+|\s+"), random.Random(2)
    for _ in range(500):
        text = "".join(draw.choice("aab c") for _ in range(draw.randint(0, 30)))
        assert ids(codec.encode(text)) == library.encode_ordinary(text)


def test_documents_with_nulls_repeats_and_taken_names(spark, both):
    _, library = both
    texts = [None, "", "hello  world", "hello  world", "naïve — ünï\n\n"]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, TOKEN_IDS string, decoded string")
    out = bpe.encode_documents(docs, PATH, PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "text", "TOKEN_IDS", "decoded", "token_ids_1", "decoded_1"]
    for r in out.collect():
        text = r["text"] or ""
        assert ids(r["token_ids_1"]) == library.encode_ordinary(text) and r["decoded_1"] == text.encode()
    assert bpe.encode_documents(docs.limit(0), PATH, PATTERN).count() == 0


def test_query_digests(spark, both):
    from epicohort.llm.queries import op1_bpe
    _, library = both
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = op1_bpe(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = library.encode_ordinary(docs[r["doc_id"]])
        assert r["n_tokens"] == len(want) and r["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(docs[r["doc_id"]].encode()).hexdigest()
