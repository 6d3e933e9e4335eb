"""Proximity search equals a scan of each document, however the index is cut into segments."""

import random

import pytest
from pyspark.sql import functions as F

from phasemill.llm import decontaminate


def scan(words, terms, reach):
    return [
        i for i, w in enumerate(words)
        if w in terms and all(t in words[max(0, i - reach) : i + reach + 1] for t in terms)
    ]


def hits(spark, texts, items, reach, parts):
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(parts)
    index = decontaminate.cut(decontaminate.build_index(docs.select("doc_id", F.xxhash64("text"), "text")))
    phrases = decontaminate.phrases(spark.createDataFrame(items, "item_id bigint, text string"), 3)
    found = decontaminate.search(index, phrases, reach)
    places = index.filter("term IS NULL").select("segment", F.posexplode("ids").alias("slot", "doc_id"))
    names = {r.phrase: r["items"] for r in phrases.collect()}
    return {
        (r.doc_id, item, s.start) for r in found.join(places, ["segment", "slot"]).collect()
        for s in r.spans for item in names[s.phrase]
    }


@pytest.mark.parametrize("reach", [0, 4, 64])
@pytest.mark.parametrize("segment_words, parts", [(1, 1), (500, 3), (1_000_000, 1)])
def test_proximity_equals_scan(spark, monkeypatch, reach, segment_words, parts):
    monkeypatch.setattr(decontaminate, "SEGMENT_WORDS", segment_words)
    r = random.Random(2)
    texts = [(d, " ".join(r.choice("abcdefghij") for _ in range(r.randrange(40)))) for d in range(60)] + [(60, "a b x x x c")]
    items = [(q, " ".join(r.choice("abcdefghij") for _ in range(3))) for q in range(20)] + [(20, "a b c"), (21, "a zz b"), (22, "a")]
    want = {
        (d, str(q), i) for d, t in texts for q, p in items for i in scan(t.split(), set(p.split()), reach)
    }
    assert hits(spark, texts, items, reach, parts) == want


def test_a_reach_above_the_gap_is_refused(spark):
    with pytest.raises(ValueError, match="gap"):
        hits(spark, [(1, "a b c"), (2, "a b c")], [(1, "a b c")], decontaminate.GAP + 1, 1)
