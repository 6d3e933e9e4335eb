"""Prefix trie and grafting against plain Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from phasemill.llm import prefixtrie as trie
from phasemill.llm.queries import graft

ROWS = "conv_id bigint, turn bigint, role string, text string"


def rebuilt(rows, grafting):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    plain = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    if not grafting:
        return plain
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - c % 5, [])[:h] + own[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = set()
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = sorted(c for c in cs if len(convs[c]) == len(p))
        out.add((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in below),
            sum(not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in members) for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return out


def columns(out):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in out.select(*names).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made(seed, n=120):
    """Shared first turns, copies, one path on which a conversation ends at every depth, nulls and repeated rows."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        kind = r.random()
        if kind < 0.3:
            rows += [(c, t, "user", f"copy {t}") for t in range(4)]
        elif kind < 0.6:
            rows += [(c, t, "user", f"path {t}") for t in range(r.randrange(1, 12))]
        else:
            rows += [(c, t, r.choice(["user", "assistant", None]), r.choice(["é", "b", None, ""])) for t in range(r.randrange(1, 5))]
    rows += [(1000, None, "user", "first"), (1000, 0, "user", "then"), (1000, 0, "user", "then"), (1000, 0, None, "then"), (None, 0, "user", "lost"), (-7, 0, "user", "x" * 100_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("most, chunk", [(1, 2), (3, 5), (40, 50_000), (10_000, 50_000)])
@pytest.mark.parametrize("grafting", [False, True])
def test_trie_equals_brute_force(spark, monkeypatch, most, chunk, grafting):
    monkeypatch.setattr(trie, "CHUNK_IDS", chunk)
    monkeypatch.setattr(trie, "BATCH_ROWS", 7)
    rows = made(most)
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    for name in ("key", "t", "turns", "digest"):
        df = df.withColumn(name, F.lit("mine"))
    lists = trie.turn_lists(df)
    got = columns(trie.prefix_trie(graft(lists) if grafting else lists, most))
    assert got == brute(rebuilt(rows, grafting))


def test_joins_beyond_the_broadcast_give_the_same(spark, monkeypatch):
    from phasemill.llm import texts

    monkeypatch.setattr(texts, "BROADCAST_BYTES", 0)
    rows = made(9, 60)
    got = columns(trie.prefix_trie(trie.turn_lists(spark.createDataFrame(rows, ROWS)), 4))
    assert got == brute(rebuilt(rows, False))


def test_turnless_and_empty(spark):
    assert trie.prefix_trie(trie.turn_lists(spark.createDataFrame([], ROWS))).count() == 0
    some = spark.createDataFrame([(5, []), (3, []), (4, [(b"x" * 16, 3)])], f"conv_id bigint, turns {trie.TURNS}")
    ends = hashlib.sha256(b"3,5").hexdigest()
    assert columns(trie.prefix_trie(some)) == {
        (3, 0, None, 3, 1, 1, 0, ends), (4, 1, 3, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())
    }
