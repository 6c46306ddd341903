import base64
import struct

import corpus_pipeline as P
from epicohort.llm import queries, rules, simhash
from epicohort.llm.common import table

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator_and_brute_force(spark):
    import tiktoken
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        kept.append(P.stash(stage(spark, kept[-1], SF), f"test{k}"))
        if k < 4:
            assert kept[-1].columns == columns
    rows = [{r["doc_id"]: r for r in x.collect()} for x in kept]
    judged = {d: rules.judge((r["text"] or "").encode()) for d, r in rows[0].items()}
    assert {d: r["text"] for d, r in rows[1].items()} == {d: j[-1] for d, j in judged.items() if j[-2]}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[1].values())
    assert len(rows[2]) >= 0.97 * len(rows[1])
    fps = {d: simhash.fingerprint(r["text"].encode(), 3) for d, r in rows[2].items()}
    name = {d: d for d in fps}  # least id that is reachable, by spreading to a fixed point
    near = [(a, b) for a in fps for b in fps if a < b and ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 2]
    while True:
        was = dict(name)
        for a, b in near:
            name[a] = name[b] = min(name[a], name[b])
        if was == name:
            break
    assert set(rows[3]) == {d for d in fps if name[d] == d}
    leaked = {r["doc_id"] for r in queries.decontaminate.leaks(kept[3], table(spark, SF, "benchmark")).collect()}
    assert set(rows[4]) == set(rows[3]) - leaked
    path, pattern = queries.tokenizer()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    assert set(rows[5]) == set(rows[4])
    for r in rows[5].values():
        want = library.encode_ordinary(r["text"])
        assert bytes(r["token_ids"]) == struct.pack(f"<{len(want)}I", *want) and r["n_tokens"] == len(want) and r["round_trip"]


def test_stages_survive_nulls_repeats_and_clashing_names(spark):
    good = "\n".join(" ".join(f"lorem{'abcdefgh'[i]} ipsum{'klmnopqrstuv'[j]}" for j in range(8)) + "." for i in range(8))
    schema = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, leaks int, n_tokens int, "
              "TOKEN_IDS int, component_id int, quality_result int")
    row = lambda i, t: (i, t, "en", None, None, None, 1, 2, 3, 4, 5)
    docs = spark.createDataFrame([row(1, good), row(1, good), row(2, None), row(3, ""), row(None, good), row(4, good + " more")], schema)
    for n, expected in ((6, 1), (0, 0)):
        now = docs.limit(n)
        for k, (_, stage) in enumerate(P.STAGES):
            now = P.stash(stage(spark, now, SF), f"edge{k}")
            if k < 4:
                assert now.columns == docs.columns
        assert now.count() >= expected and {r["doc_id"] for r in now.collect()} <= {1}
