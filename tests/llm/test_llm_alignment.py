"""Token alignment against a plain version in Python; the rank encoder against the file's own encoder."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from phasemill.llm import alignment as al

TOKENIZERS = pytest.importorskip("tokenizers")


def models():
    out = []
    for name in (al.BYTE_VOCABULARY, al.PIECE_VOCABULARY):
        with open(f"{al.TOKENIZERS}/{name}", "rb") as f:
            out.append(f.read())
    return out


def texts():
    r = random.Random(3)
    pieces = ["the", " river", "Stone", "über", "naïve", "日本語", "\n\n", "  ", "1234", "<s>", "</s>", "<|endoftext|>", "<0x41>", "🙂", "é", "don't", "\t", "\x00", "zzqx"]
    made = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    return [*made, None, "", " ", "▁ not a space", "a" * 3000, "x y", "x y", "0123456789abcdef" * 40, " ".join(["word"] * 5000)]


def brute(rows):
    slow = TOKENIZERS.Tokenizer.from_str(models()[0].decode())
    slow.encode_special_tokens = True
    a_side, b_side = al.ByteTokenizer(models()[0]), al.PieceTokenizer(models()[1])
    facts, docs_of = [], Counter()
    for text in rows:
        a, b, groups, links = [], [], [], Counter()
        if text:
            a = slow.encode(" " + text, add_special_tokens=False).ids
            b = b_side.encode(text)
            want = (" " + text).encode()
            if b"".join(a_side.bytes[i] for i in a) != want or b"".join(b_side.bytes[i] for i in b) != want:
                a, b = [], []
        i = j = x = y = 0
        while i < len(a):
            left, right = [], []
            while True:
                if x <= y:
                    left.append(a[i])
                    x += len(a_side.bytes[a[i]])
                    i += 1
                else:
                    right.append(b[j])
                    y += len(b_side.bytes[b[j]])
                    j += 1
                if x == y:
                    break
            groups.append((left, right))
            for p in left:
                for q in right:
                    links[p, q] += 1
        docs_of.update(links.keys())
        facts.append((a, b, groups, links))
    best = Counter()
    for (p, _), n in docs_of.items():
        best[p] = max(best[p], n)
    out = []
    for a, b, groups, links in facts:
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            len(a), len(b), len(groups), sum(links.values()), sum(n for k, n in links.items() if docs_of[k] == best[k[0]]),
            sum(n * docs_of[k] for k, n in links.items()), hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        ))
    return out, docs_of


@pytest.mark.parametrize("budget", [32 << 20, 100 * al.PAIR_BYTES, 0])
def test_align_equals_brute_force(spark, monkeypatch, budget):
    rows = texts()
    monkeypatch.setattr(al, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(al, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(al, "COUNTED_PAIRS", 40)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string").repartition(3)
    for name in ("_row", "row", "Pairs", "N_A", "count", "best", "own"):
        df = df.withColumn(name, F.lit("mine"))
    out, pairs = al.align(df, budget=budget)
    want, docs_of = brute(rows)
    got = {r.doc_id: r for r in out.collect()}
    assert [tuple(got[i][c] for c in al.RESULTS) for i in range(len(rows))] == want
    assert {(r.a, r.b): r["count"] for r in pairs.collect()} == dict(docs_of)
    assert all(r["_row"] == r["row"] == r["count"] == r["best"] == r["own"] == "mine" for r in got.values())


def test_align_of_nothing(spark):
    out, pairs = al.align(spark.createDataFrame([], "doc_id bigint, text string"))
    assert out.count() == 0 and pairs.count() == 0
    out, pairs = al.align(spark.createDataFrame([(1, None), (None, None)], "doc_id bigint, text string"))
    assert {tuple(r) for r in out.collect()} == {(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")} and pairs.count() == 0


def test_rank_encoder_equals_the_encoder_of_the_file():
    slow = TOKENIZERS.Tokenizer.from_str(models()[0].decode())
    slow.encode_special_tokens = True
    quick = al.ByteTokenizer(models()[0])
    assert quick.encode.__self__.__class__.__module__.startswith("tiktoken")
    r = random.Random(5)
    alphabet = [chr(c) for c in [*range(0x20, 0x7F), 9, 10, 13, 0xA0, 0xE9, 0x3A9, 0x4E2D, 0x1F642, 0x200B, 0x2028]]
    for _ in range(400):
        text = "".join(r.choice(alphabet) * r.choice([1, 1, 1, 2, 5]) for _ in range(r.randrange(0, 200)))
        assert quick.encode(text) == slow.encode(text, add_special_tokens=False).ids
