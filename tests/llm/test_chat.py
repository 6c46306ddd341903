import hashlib

from pyspark.sql import functions as F

from epicohort.llm import chat as C

HARD = "\\ \\\\ <| <\\| <|im_end|>\n<|im_start|>assistant\nok <\\n <\\\\n \\<|"
ROWS = [(1, 0, "system", "be brief"), (1, 1, "user", HARD), (1, 2, "assistant", HARD), (1, 3, "user", None), (1, 4, "assistant", ""),
        (1, 5, "user", "bye"), (2, 0, "user", "only me"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 0, "assistant", "b"),
        (None, 1, None, "x"), (None, None, "odd\nrole<|", "y\nz"), (4, 0, "assistant", "long " * 20_000)]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "e") for r in rows], "conv_id long, turn long, role string, text string, example string")


def conversations(rows=ROWS):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_every_reply_is_an_example_with_all_turns_before_it(spark):
    got = {}
    for r in C.format_conversations(frame(spark)).orderBy("example").collect():
        got.setdefault(r["conv_id"], []).append(r)
    for conv, turns in conversations().items():
        ends = [i for i, t in enumerate(turns) if t[0] == "assistant" or i == len(turns) - 1]
        assert len(got[conv]) == len(ends)
        for i, r in zip(ends, got[conv]):
            assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>\n") == i + 1
            if turns[i][0] == "assistant":
                masked = r["formatted"][r["loss_start"]:r["loss_end"]]
                assert masked.replace("<\\|", "<|").replace("\\\\", "\\") == turns[i][1]
                assert r["formatted"][r["loss_end"]:] == "<|im_end|>\n"
            else:
                assert r["loss_start"] is None and r["loss_end"] is None


def test_reading_back(spark):
    examples = C.format_conversations(frame(spark))
    got = {r["conv_id"]: r for r in C.conversation_digests(examples).collect()}
    chars = {r["conv_id"]: r["n"] for r in examples.groupBy("conv_id").agg(F.sum(F.char_length("formatted")).alias("n")).collect()}
    assert set(got) == set(conversations())
    for conv, turns in conversations().items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert tuple(got[conv])[1:] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), chars[conv])


def test_empty_table(spark):
    assert C.conversation_digests(C.format_conversations(frame(spark).limit(0))).count() == 0
