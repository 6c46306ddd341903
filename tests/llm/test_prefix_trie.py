import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from epicohort.llm import prefix_trie as T
from epicohort.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string, name string, depth long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "extra", 7) for r in rows], SCHEMA)


def rebuilt(rows):
    """Every conversation's (role, text) turns, with the borrowed head."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # % takes the sign of c, as in SQL
    return out


def brute(conversations):
    """(least, depth, parent's least, members, children, leaves, saved, ends) of every node."""
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, who in members.items():
        below = [n for n in members if n[:len(node)] == node]
        childless = [n for n in below if not any(len(m) == len(n) + 1 and m[:len(n)] == n for m in members)]
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(node))
        out.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who),
                    sum(len(n) == len(node) + 1 for n in below), len(childless),
                    sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, rows):
    turns = T.ordered_turns(frame(spark, rows))
    ids = frame(spark, rows).select(F.col("conv_id").alias("seq")).where("seq IS NOT NULL").distinct()
    nodes = T.prefix_trie(Q.rebuilt_conversations(turns, ids), ids)
    return sorted(((r["least"], r["depth"], r["parent_least"], r["n_members"], r["n_children"], r["n_leaves"], r["saved_weight"], r["ends_sha256"])
                   for r in nodes.collect()), key=lambda r: (r[1], r[0]))


def test_random_conversations_match_brute_force(spark):
    draw = random.Random(5)
    rows = []
    for c in [*range(0, 12), *range(95, 112), *range(300, 306), 451, -7]:
        for t in range(draw.choice([0, 1, 2, 3, 5, 8, 9, 17])):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice(["a", "bé", "", None])))
    rows += [(1, None, "user", "first"), (1, None, "user", "first"), (2, 0, "user", "tie"), (2, 0, "assistant", "tie"), (None, 0, "user", "lost")]
    # ties are ordered by a digest, so rows that tie are the same here but for those of conversation 2
    rows = [r for r in rows if r[0] != 2]
    assert found(spark, rows) == brute(rebuilt(rows))


def test_long_chain_with_a_branch_at_every_depth(spark):
    rows = [(0, t, "user", f"turn {t}") for t in range(70)]
    rows += [(100 * k, t, "user", f"turn {t}" if t < k else "other") for k in range(1, 70) for t in range(k + 1)]
    assert found(spark, rows) == brute(rebuilt(rows))


def test_hot_sequence_many_ends_and_long_text(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_IDS", 16)
    rows = [(c, 0, "user", "same") for c in range(300)] + [(1000, t, "user", "x" * 200_000) for t in range(2)]
    assert found(spark, rows) == brute(rebuilt(rows))


def test_turnless_and_empty(spark):
    # there is no conversation 0, so c loses its only turn
    c = next(c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0)
    assert found(spark, [(c, 0, "user", "gone")]) == brute({c: []})
    assert found(spark, []) == []


def test_ties_and_repeated_rows_keep_one_order(spark):
    rows = [(0, 0, "user", "b"), (0, 0, "user", "a"), (0, 0, "user", "a"), (0, None, "user", "z")]
    first = T.ordered_turns(frame(spark, rows)).orderBy("pos").collect()
    again = T.ordered_turns(frame(spark, rows[::-1])).orderBy("pos").collect()
    assert first == again and [r["pos"] for r in first] == [0, 1, 2, 3]
