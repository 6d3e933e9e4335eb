"""One query per operator, over whole tables, and its SQL twin where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasemill.llm import (
    alignment, decontaminate, langid, linededup, mixing, prefixtrie, quality, repetition, secrets, sql, superminhash, toolcalls, toxicity,
    urls,
)
from phasemill.llm.texts import cut, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents hit by windows of 13 words of benchmark items."""
    out = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), width=13, percent=5)
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("matched_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("matched_items", ","), 256).alias("items_sha256"), "contaminated",
    )


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page url."""
    out = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


@_query
def op4_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles overlap to 85 % or more."""
    out = superminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return out.select("doc_id", "n_shingles", "component_id", "kept")


@_query
def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix by weight takes of every document."""
    out = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", F.col("source_size"), "target", "taken")


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without lines that an earlier document holds."""
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=10)
    return out.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    )


@_query
def op8_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition counts and verdict of every document."""
    out = repetition.repetition(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )

def _remainder(n: int):
    """crc32 of the doc_id as text, modulo n."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@_query
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; two thirds of them are learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(_remainder(3) != 1))
    out = langid.identify(docs.select("doc_id", "text", (_remainder(3) == 1).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def _labelled(spark: SparkSession, sf_dir: str, label: str, keep, most: int) -> DataFrame:
    """Texts and labels of about `most` labelled documents at most, chosen by a hash of the id on both sides
    of the join, so that only their texts are moved."""
    labels = table(spark, sf_dir, "labels").filter(keep).filter(F.col(label).isNotNull())
    share = quality.sample_share(labels, most)
    chosen = quality.in_share(share, "doc_id")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").filter(chosen)
    return cut(docs.join(labels.filter(chosen).select("doc_id", F.col(label).alias("label")), "doc_id").select("text", "label"))


@_query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; labels of three quarters of the ids are learned from."""
    model = quality.fit(_labelled(spark, sf_dir, "quality", _remainder(4) != 2, quality.SAMPLE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(4) == 2).alias("held_out"))
    return quality.score(docs, model, threshold=0.7).select("doc_id", "held_out", "score", "predicted")


@_query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels of four fifths of the ids are learned from."""
    model = toxicity.fit(_labelled(spark, sf_dir, "toxic", _remainder(5) != 0, toxicity.SAMPLE))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(5) == 0).alias("held_out"))
    return toxicity.score(docs, model, threshold=0.5).select("doc_id", "held_out", "score", "predicted")

# a reply quotes the turn before it, so its length is bounded
TOOLS = {
    "reply": {
        "type": "object", "required": ["text", "chars"], "additionalProperties": False,
        "properties": {"text": {"type": "string"}, "chars": {"type": "integer", "minimum": 1, "maximum": 1000}},
    }
}


def as_tool_log(conversations: DataFrame) -> DataFrame:
    """Conversations as a tool log, one event per turn: an assistant turn is a call, a user turn the result of the call before it.

    The length of a text says what its event is like, so that every case of the operator arises and no turn is dropped.
    Calls name the call behind them, the one before, the next and the second before, or none; so some conversations
    have to be ordered and some hold cycles. Some calls have no id or the id of the call before, some state their length as
    a string, and some results answer the call that still follows. Other roles stay as they are.
    """
    n, turn = F.length("text"), F.col("turn")

    def name(at: Column) -> Column:
        return F.concat_ws("-", "conv_id", at)

    own = F.when(n % 17 == 0, F.lit(None)).when(n % 11 == 5, name(turn - 2)).otherwise(name(turn))
    after = (
        F.when(n % 4 == 0, F.array(name(turn + 2))).when(n % 4 == 1, F.array(name(turn - 2)))
        .when(n % 4 == 2, F.array(name(turn + 2), name(turn - 4))).otherwise(F.array().cast("array<string>"))
    )

    def call(chars: Column) -> Column:
        arguments = F.struct("text", chars.alias("chars"))
        return F.to_json(F.struct(own.alias("id"), F.lit("reply").alias("name"), arguments.alias("arguments"), after.alias("after")))

    calls = F.when(n % 7 == 3, call(n.cast("string"))).otherwise(call(n))
    answered = name(F.when(n % 13 == 2, turn + 1).otherwise(turn - 1))
    result = F.to_json(F.struct(answered.alias("id"), F.col("text").alias("content")))
    asks = F.col("role") == "assistant"
    return conversations.select(
        "conv_id", "turn", F.when(F.col("role") == "user", "tool").otherwise(F.col("role")).alias("role"),
        F.when(asks, F.concat(F.lit("<tool_call>"), calls, F.lit("</tool_call>")))
        .when(F.col("role") == "user", result).otherwise(F.col("text")).alias("text"),
    )


@_query
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a tool log, linked, ordered, validated and written as canonical JSON."""
    out = toolcalls.link_calls(as_tool_log(table(spark, sf_dir, "conversations")), TOOLS)
    return out.select(
        F.col("conv").cast("bigint").alias("conv_id"), F.coalesce("level", F.lit(-1)).alias("level"), "turn", "id", "status", "valid",
        F.sha2("line", 256).alias("line_sha256"),
    )


def graft(turns: DataFrame) -> DataFrame:
    """Conversations of shared beginnings: c starts with the first crc32(c) % 9 turns of c - c % 5, then goes on with its own."""
    conv = F.col("conv_id")
    begin = (F.crc32(conv.cast("string").cast("binary")) % 9).cast("int")
    heads = turns.select(conv.alias("_base"), F.slice("turns", 1, 8).alias("_head"))
    head = F.coalesce(F.slice("_head", F.lit(1), begin), F.array().cast(prefixtrie.TURNS))
    rest = F.slice("turns", begin + 1, F.greatest(F.size("turns") - begin, F.lit(0)))
    return turns.withColumn("_base", conv - conv % 5).join(heads, "_base", "left").select("conv_id", F.concat(head, rest).alias("turns"))


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of grafted conversations."""
    out = prefixtrie.prefix_trie(graft(cut(prefixtrie.turn_lists(table(spark, sf_dir, "conversations")))))
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


def _equals(value: str, column: Column) -> Column:
    return column == value


@_query
def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document. The ledger grows in two scans: the base rules, then all rules, of which only the new ones run."""
    versions = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("version"), "text")
    ledger = secrets.Ledger(spark)
    held = secrets.scan(versions, ledger, secrets.BASE)
    secrets.scan(versions, ledger, secrets.BASE + secrets.MORE, held)
    out = secrets.findings(held, ledger)
    base = F.filter("spans", lambda s: s["place"] <= len(secrets.BASE))
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, partial(_equals, rule.kind))).cast("bigint").alias(f"n_{rule.kind}") for rule in secrets.BASE
    ]
    return out.select(
        F.col("path").alias("doc_id"), *counts, F.sha2(secrets.span_list(base), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans")
    )


@_query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token alignment of every document between the byte-level and the piece vocabulary."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"))[0]


ORACLES["op1_decontaminate"] = sql.decontaminate(13, 5)
ORACLES["op2_url_filter"] = sql.url_filter(RULES, urls.MANY, urls.RARE, urls.SIMILAR, urls.PRIOR, urls.REJECT)
ORACLES["op4_superminhash"] = sql.near_duplicates(3, 85)
ORACLES["op6_mix_sources"] = sql.mix_sources(mixing.WEIGHTS, mixing.SHARE_PERCENT, mixing.MOST_REPEATS)
ORACLES["op7_line_dedup"] = sql.line_dedup(10)
ORACLES["op8_repetition"] = sql.repetition(
    repetition.NGRAM_LIMITS, repetition.LINE_LIMIT, repetition.LEAST_WORDS, repetition.REPEAT_PERCENT
)
ORACLES["op3_tool_calls"] = sql.tool_calls(1000)
ORACLES["op11_prefix_trie"] = sql.prefix_trie()
ORACLES["op12_secret_scan"] = sql.secret_scan([(r.kind, r.pattern, r.value, r.least) for r in secrets.BASE + secrets.MORE], len(secrets.BASE))
