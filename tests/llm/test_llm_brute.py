"""Operators against brute force, and classifiers on held-out rows."""

import random
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasemill.llm import decontaminate, linededup, repetition, superminhash
from phasemill.llm.queries import QUERIES
from phasemill.llm.texts import WordHashes

SF = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")


def near_copies(n_groups=12, copies=14, seed=5):
    """Groups of texts that differ from an original, or from each other, around the threshold."""
    r = random.Random(seed)
    texts = []
    for _ in range(n_groups):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([6, 40, 120, 300]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randrange(0, max(2, len(own) // 14))):
                own[r.randrange(len(own))] = f"x{r.randrange(4000)}"
            texts.append(" ".join(own))
            base = own if r.random() < 0.2 else base
    r.shuffle(texts)
    return list(enumerate(texts))


def brute_components(rows, shingle, percent):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or {tuple(w)}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("progress, chunk", [(0.05, 500_000), (1e9, 7)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, shingle, percent, progress, chunk):
    monkeypatch.setattr(superminhash, "PROGRESS", progress)  # a huge value leaves all but one round to the exact rest
    monkeypatch.setattr(superminhash, "CHUNK_LINKS", chunk)
    rows = near_copies()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in superminhash.near_duplicates(df, shingle, percent).collect()}
    assert got == brute_components(rows, shingle, percent)


def test_superminhash_estimates_jaccard():
    r = np.random.default_rng(3)
    for n, share in ((3, 0.5), (40, 0.9), (500, 0.7), (3000, 0.2)):
        both = int(n * share)
        a = r.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[:both], r.integers(0, 2**63, n - both, dtype=np.uint64)])
        value = np.concatenate([np.sort(a), np.sort(b)])
        h = superminhash.superminhash(value, np.array([0, n, 2 * n]), 512)
        assert (h < np.uint64(512) << np.uint64(32)).all()
        assert abs((h[0] == h[1]).mean() - both / (2 * n - both)) < 0.09


def test_thresholds_of_banding():
    b = superminhash.bands_for(0.85)
    assert (1 - 0.85**4) ** b <= 1e-5 < (1 - 0.85**4) ** (b - 1)
    assert superminhash.least_agreement(64, 0.85) in range(36, 44)


def test_line_dedup_across_partition_borders(spark):
    r = random.Random(1)
    pool = [f"a shared line number {i}" for i in range(30)] + ["short", "   ", "A SHARED LINE NUMBER 3  "]
    rows = [
        (d, "\n".join([pool[0]] * (d % 3 == 0) + [r.choice(pool) for _ in range(r.randrange(6))] + [f"own line of {d}"] * 2))
        for d in range(600)
    ]
    head = {}
    for d, t in rows:
        for line in t.split("\n"):
            k = line.strip().lower()
            if len(k) >= 10:
                head.setdefault(k, d)
    want = {
        d: "\n".join(x for x in t.split("\n") if head.get(x.strip().lower(), d) == d) for d, t in rows
    }
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "23", "spark.sql.execution.arrow.maxRecordsPerBatch": "7"}
    old = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        assert {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("reach", [None, 4])
def test_search_equals_scan(spark, monkeypatch, reach):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", 500)
    r = random.Random(2)
    texts = [(d, " ".join(r.choice("abcdefg") for _ in range(r.randrange(60)))) for d in range(80)]
    queries = [(q, " ".join(r.choice("abcdefg") for _ in range(3))) for q in range(25)] + [(25, "a zz b"), (26, "a")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    items = spark.createDataFrame(queries, "item_id bigint, text string")
    source = docs.select("doc_id", F.xxhash64("text"), "text")
    index = decontaminate.cut(decontaminate.build_index(source))
    hits = decontaminate.search(index, decontaminate.phrases(items, 3), reach)
    places = index.filter("term IS NULL").select("segment", F.posexplode("ids").alias("slot", "doc_id"))
    got = {(r.doc_id, i) for r in hits.join(places, ["segment", "slot"]).collect() for i in r["items"]}

    def found(words, q):
        if reach is None:
            return any(words[i : i + len(q)] == q for i in range(len(words) - len(q) + 1))
        rare = [i for i, w in enumerate(words) if w in q]
        return all(w in words for w in q) and any(
            all(any(words[j] == w for j in range(max(0, i - reach), min(len(words), i + reach + 1))) for w in q) for i in rare
        )

    want = {(d, str(q)) for d, t in texts for q, p in queries if found(t.split(), p.split())}
    assert got == want


def test_ngram_cover_equals_scan():
    r = random.Random(4)
    docs = [[r.choice("abc").encode() for _ in range(r.randrange(40))] for _ in range(60)]
    words = WordHashes().of([w for d in docs for w in d])
    starts = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    for n, inside in repetition.ngram_cover(words, starts, [2, 3, 5, 6]):
        for d, s, e in zip(docs, starts[:-1], starts[1:]):
            grams = [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
            want = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)}
            assert set(np.flatnonzero(inside[s:e])) == want


def held_out(spark, name, label, modulus, remainder):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/{'documents' if label == 'lang' else 'labels'}.parquet").select("doc_id", label).collect()}
    rows = [r for r in QUERIES[name](spark, SF).collect() if r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == remainder) for r in rows)
    return [(labels[r.doc_id], r) for r in rows if r.held_out]


@needs_tables
def test_language_accuracy(spark):
    got = held_out(spark, "op5_language", "lang", 3, 1)
    assert np.mean([y == r.lang_pred for y, r in got if r.lang_pred != "und"]) > 0.97


@needs_tables
@pytest.mark.parametrize("name, label, modulus, remainder, least", [("op9_quality", "quality", 4, 2, 0.9), ("op10_toxicity", "toxic", 5, 0, 0.9)])
def test_classifier_accuracy(spark, name, label, modulus, remainder, least):
    got = held_out(spark, name, label, modulus, remainder)
    assert np.mean([y == r.predicted for y, r in got]) > least
    one = [r.score for y, r in got if y]
    zero = [r.score for y, r in got if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero]) > 0.85


@needs_tables
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in p.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = p.cut(stage(spark, docs, sf))
        kept[name] = before, {r.doc_id: r for r in docs.collect()}
    before, after = kept["language"]
    assert set(before) - set(after) <= {d for d, r in before.items() if not any(map(str.isalpha, (r.text or "")))} or len(after) > 0.98 * len(before)
    before, after = kept["lines"]
    assert set(before) == set(after)
    before, after = kept["near_duplicates"]
    roots = brute_components([(d, r.text.lower()) for d, r in before.items() if r.text.split()], 5, 80)
    assert set(after) == {d for d in before if roots.get(d, (0, d))[1] == d}
    before, after = kept["mix"]
    assert set(before) == set(after) and all(r.taken <= 2 * r.size for r in after.values())
