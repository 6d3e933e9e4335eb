"""Nulls, empty and very long texts, repeated rows, empty tables and clashing columns, for every operator."""

import random

import pytest
from pyspark.sql import functions as F

from phasemill.llm import (
    decontaminate, langid, linededup, mixing, quality, repetition, superminhash, toolcalls, toxicity, urls,
)

WORDS = "the of and river stone light winter garden letter music window market ocean bridge".split()
CLASH = [
    "text_key", "keep", "_n", "_root", "_id", "_doc_key", "_copy", "_dense", "_raw", "segment", "rows", "_items", "_n_hit", "_n_words",
    "_spans", "_did", "_dkey", "_left_id", "_left_key", "_mix_source", "_reach",
]


def sentence(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


def rows():
    long_text = sentence(7, 60_000)
    return [
        (1, sentence(1), "en", "a"), (1, sentence(1), "en", "a"), (2, sentence(1), "en", "b"), (3, None, None, None),
        (4, "", "en", "a"), (5, " \n\t ", "de", None), (None, sentence(1), "de", "a"), (6, long_text, "en", "b"),
        (7, "1234 %% 99", None, "b"), (8, "\n".join([sentence(3, 6)] * 3), "de", "c"), (9, "wort", "de", "c"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(rows(), "doc_id bigint, text string, lang string, source string").repartition(3)
    for c in (*CLASH, "N_Words", "Kept", "Score", "Size", "Target", "N_LINES", "Cover", "Predicted", "Lang_Pred"):
        df = df.withColumn(c, F.lit("mine"))
    return df


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame(
        [(1, sentence(1, 20)), (2, None), (3, ""), (None, sentence(1, 20)), (4, "wort"), (4, "wort")], "item_id bigint, text string"
    )


def kept_columns(out, names=CLASH):
    return all(r[c] == "mine" for r in out.collect() for c in names)


def test_decontaminate(docs, none, items):
    out = decontaminate.decontaminate(docs, items)
    got = {(r.doc_id, r.text): r for r in out.collect()}
    assert out.count() == docs.count() and kept_columns(out)
    assert got[(1, sentence(1))].n_hit == 20 and got[(1, sentence(1))].matched_items == ["1"]
    assert got[(None, sentence(1))].contaminated
    assert (got[(3, None)].n_words, got[(3, None)].n_hit, got[(3, None)].contaminated) == (0, 0, False)
    assert got[(9, "wort")].matched_items == ["4"] and not got[(4, "")].contaminated
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(docs, items.limit(0)).filter("contaminated").count() == 0


def test_near_duplicates(docs, none):
    out = superminhash.near_duplicates(docs)
    got = [(r.doc_id, r.text, r.n_shingles, r.component_id, r.kept) for r in out.collect()]
    assert len(got) == docs.count() and kept_columns(out)
    same = [g for g in got if g[1] == sentence(1)]
    assert {(g[0], g[3], g[4]) for g in same} == {(1, 1, True), (2, 1, False), (None, None, True)}
    assert all(g[2] == 0 and g[3] == g[0] and g[4] for g in got if g[0] in (3, 4, 5))
    assert next(g[2] for g in got if g[0] == 9) == 1
    assert superminhash.near_duplicates(none).count() == 0


def test_line_dedup(docs, none):
    out = linededup.dedup_lines(docs)
    got = [(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()]
    assert len(got) == docs.count() and kept_columns(out)
    assert sorted(g[1:] for g in got if g[0] == 1) == [(sentence(1), 1, 0)] * 2
    assert next(g[1:] for g in got if g[0] == 2) == ("", 1, 1)
    assert next(g[1:] for g in got if g[0] is None) == (sentence(1), 1, 0)
    assert next(g[1:] for g in got if g[0] == 3) == (None, 1, 0)
    assert next(g[2:] for g in got if g[0] == 8) == (3, 0)
    assert linededup.dedup_lines(none).count() == 0


def test_mix(docs, none):
    out = mixing.plan_mix(docs)
    assert out.count() == docs.count() and kept_columns(out)
    got = out.collect()
    assert all(r.taken <= 2 * r.size for r in got)
    assert {r.doc_id: r.size for r in got}[3] == 0
    assert {r.source for r in got} == {"a", "b", "c", None}
    total = sum({r.source: r.target for r in got}.values())
    assert total == pytest.approx(1.5 * sum({r.source: r.source_size for r in got}.values()))
    assert mixing.plan_mix(none).count() == 0
    assert mixing.emit_mix(docs).columns == docs.columns
    assert mixing.emit_mix(docs).count() == sum(r.copies for r in got)


def test_repetition(docs, none):
    out = repetition.repetition(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and kept_columns(out)
    assert got[3].n_words == 0 and got[3].base_failed and not got[3].kept
    assert got[1].kept and got[8].n_dup_lines == 2 and got[8].n_repeat_words == 18 and not got[8].kept
    assert got[6].n_words == 60_000
    assert repetition.repetition(none).count() == 0


def test_language(docs, none):
    out = langid.identify(docs, langid.fit(docs))
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == docs.count() and kept_columns(out)
    assert all(got[i].lang_pred == "und" and got[i].rejected and got[i].score == 0 for i in (3, 4, 5, 7))
    assert got[1].lang_pred in ("de", "en") and got[6].lang_pred == "en"
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(none, langid.fit(docs)).count() == 0


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers(spark, docs, none, module):
    labelled = docs.select("text", F.when(F.col("doc_id") % 2 == 0, 1).when(F.col("doc_id") < 7, 0).alias("label"))
    for train in (labelled, labelled.limit(0), labelled.filter("label = 1")):
        out = module.score(docs, module.fit(train))
        got = out.collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
        assert kept_columns(out)
        assert len({r.score for r in got if r.doc_id in (3, 4, 5)}) == 1
    assert module.score(none, module.fit(labelled)).count() == 0


def test_urls(spark):
    pages = [
        (1, "https://a.org/x/12?q=1"), (2, None), (3, "no scheme"), (4, "http://A.ORG"), (5, "http://b.net/es/1"), (5, "http://b.net/es/1"),
        (6, "http:///p"), (7, "http://x.com://y/#f"), (8, "http://b.net/" + "deep/" * 300), (None, "http://net/fr/"),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("shape", F.lit("mine")).withColumn("host", F.lit(1))
    rules = [("block", "net", "/es/"), ("block", "net", "/fr/"), ("allow", "com", "/")]
    out = urls.filter_urls(df, rules)
    got = {(r.page_id): r for r in out.collect()}
    assert out.count() == len(pages) and {r["shape"] for r in got.values()} == {"mine"}
    assert (got[2].host, got[2].path, got[2].rule, got[2].verdict) == ("", "", None, "allow")
    assert (got[4].host, got[4].path) == ("a.org", "") and got[1].path == "/x/12"
    assert got[5].rule == "net/es/" and got[5].verdict == "block" and got[None].verdict == "block"
    assert (got[7].host, got[7].rule) == ("x.com:", None)
    assert urls.filter_urls(df.limit(0), rules).count() == 0


def test_url_templates_judge_unruled_pages(spark):
    pages = [(i, f"http://www.shop.net/{'promo' if i % 2 else 'item'}/{i}") for i in range(100, 140)]
    rules = [("block", "shop.net", f"/promo/{i}") for i in range(101, 120, 2)] + [("allow", "shop.net", f"/item/{i}") for i in range(100, 120, 2)]
    df = spark.createDataFrame(pages, "page_id bigint, url string")
    got = {r.page_id: r for r in urls.filter_urls(df, rules).collect()}
    assert got[139].rule is None and got[139].verdict == "block" and got[139].template == "/promo/{n}"
    assert got[138].verdict == "allow"


def test_tool_calls(spark):
    def call(i, after=(), name="f", **arguments):
        import json

        return "<tool_call>" + json.dumps({"id": i, "name": name, "arguments": arguments, "after": list(after)}) + "</tool_call>"

    def result(i, content):
        import json

        return json.dumps({"id": i, "content": content})

    messages = [
        (1, 0, "assistant", call("a", n=1) + call("b", ["a"], n="x")), (1, 1, "tool", result("a", {"z": 1, "y": "é"})),
        (1, 2, "tool", result("a", 2)), (1, 3, "assistant", call("a", n=3)), (1, 4, "tool", result("q", None)),
        (2, 0, "assistant", call("p", ["r"], n=1)), (2, 1, "assistant", call("r", n=2)), (2, 2, "assistant", call("s", ["t"], name="g")),
        (2, 3, "assistant", call("t", ["s"])), (2, 4, "tool", "not json"), (3, 0, "tool", result("m", 1)), (3, 1, "assistant", call("m", n=1)),
        (None, None, None, None), (None, 1, "assistant", call("k", n=5)), (4, 0, "user", "plain"),
    ]
    df = spark.createDataFrame(messages, "conv_id bigint, turn bigint, role string, text string").withColumn("level", F.lit("mine"))
    schema = {"f": {"type": "object", "properties": {"n": {"type": "integer", "minimum": 1}}, "required": ["n"]}}
    got = [(r.conv, r.id, r.status, r.level, r.valid, r.line) for r in toolcalls.link_calls(df, schema).collect()]
    of = {(g[0], g[1], g[2]): g for g in got}
    assert of[("1", "a", "linked")][5] == '{"arguments":{"n":1},"id":"a","name":"f","result":{"y":"é","z":1},"status":"linked"}'
    assert of[("1", "b", "unanswered")][4] is False and ("1", "q", "orphan") in of
    assert sum(g[1:3] == ("a", "repeated") for g in got) == 2
    assert of[("2", "r", "unanswered")][3] == 0 and of[("2", "p", "unanswered")][3] == 1
    assert {("2", "s", "cyclic"), ("2", "t", "cyclic"), ("2", None, "nameless"), ("3", "m", "misplaced")} <= set(of)
    assert of[("2", "s", "cyclic")][4] is False and of[("", "k", "unanswered")][4] is True
    assert len(got) == 12
    assert toolcalls.link_calls(df.limit(0), schema).count() == 0
