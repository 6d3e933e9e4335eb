"""URL filter: explicit rules first, then per-host path templates judged by the labels the rules give.

Built-in column functions throughout. Paths are reduced to shapes (digits and long hexadecimal runs become
placeholders) and counted per host before anything else, so a hot host is a few rows per shape. In the tree
of a host, a level with many rare children becomes a wildcard, and siblings whose subtrees have the same
depth and whose block rates do not differ significantly are merged. A template whose labelled pages are
block to a smoothed share of at least `reject` is blocked; one without labelled pages never is.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import cut, unused

Rule = tuple[str, str, str]  # verdict, host, path prefix

MANY = 10  # children from which a level may be variable
RARE = 3  # mean pages per child below which it is
SIMILAR = 1.96  # standard errors within which block rates count as equal
PRIOR = 2.0  # allowed pages that smoothing adds to every template
REJECT = 0.7


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for a url without `://`."""
    start = F.locate("://", url)
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; null where none fits."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in ordered]
    text = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, ordered)])
    verdict = F.coalesce(F.lit(None).cast("string"), *[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, ordered)])
    return text, verdict


def _shape(path: Column) -> Column:
    """The path's non-empty segments with long hexadecimal runs as {h} and digits as {n}, joined by /."""
    s = F.regexp_replace(path, r"[0-9a-fA-F]{16,}", "{h}")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[0-9]+", "{n}"), r"/+", "/"), r"^/|/$", "")


def path_templates(shapes: DataFrame) -> DataFrame:
    """Adds `template` to rows (host, shape, n, n_block, n_allow), one row per host and shape."""
    parts = F.split("shape", "/")
    nodes = shapes.select(
        "host", "shape", "n", "n_block", "n_allow", F.size(parts).alias("depth"), F.posexplode(parts).alias("at", "segment")
    ).withColumn("parent", F.array_join(F.slice(parts, F.lit(1), F.col("at")), "/"))
    below = F.col("depth") - F.col("at")
    children = nodes.groupBy("host", "at", "parent", "segment").agg(
        F.sum("n").alias("n"), F.sum("n_block").alias("block"), F.sum(F.col("n_block") + F.col("n_allow")).alias("seen"),
        F.min(below).alias("lo"), F.max(below).alias("hi"),
    )
    level = ["host", "at", "parent"]
    width = children.groupBy(*level).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n").alias("n_level"))
    # siblings to compare: same depth below, labels present or not, mostly block or mostly allow
    kin = [*level, "lo", "hi", "labelled", "mostly"]
    children = children.withColumn("labelled", F.col("seen") > 0).withColumn("mostly", F.col("block") * 2 > F.col("seen"))
    pools = children.groupBy(*kin).agg(
        F.count(F.lit(1)).alias("n_kin"), (F.sum("block") / F.greatest(F.sum("seen"), F.lit(1))).alias("rate")
    )
    error = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.greatest("seen", F.lit(1)))
    off = F.abs(F.col("block") / F.greatest("seen", F.lit(1)) - F.col("rate"))
    variable = (F.col("n_children") >= MANY) & (F.col("n_level") < F.col("n_children") * RARE) & (F.col("n") < RARE)
    alike = (F.col("n_kin") > 1) & (off <= error * SIMILAR + 1e-12)
    named = (
        children.join(width, level).join(pools, kin)
        .withColumn("name", F.when(variable, "**").when(alike & F.col("labelled"), "*").when(alike, "+").otherwise(F.col("segment")))
        .select(*level, "segment", "name")
    )
    return (
        nodes.join(named, [*level, "segment"]).groupBy("host", "shape", "n", "n_block", "n_allow")
        .agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("names"))
        .select("host", "shape", "n", "n_block", "n_allow", F.concat(F.lit("/"), F.array_join("names.name", "/")).alias("template"))
    )


def filter_urls(pages: DataFrame, rules: Sequence[Rule], url: str = "url", reject: float = REJECT) -> DataFrame:
    """`pages` with `host`, `path`, `rule`, `template`, `purity` and `verdict` (allow or block).

    A url that no rule fits gets its template's verdict: block if `blocked / (labelled + 2)` reaches
    `reject`, both counted over the template's pages that a rule fits. Null urls and
    urls without `://` have empty host and path and are judged like others of that host and path. Result
    columns replace input columns of the same name.
    """
    kept = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "template", "purity", "verdict")]
    shape, ruled = unused(pages, "_shape"), unused(pages, "_ruled")
    host, path = split_url(F.col(url))
    rows = pages.withColumns({"host": host, "path": path})
    text, verdict = first_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": text, ruled: verdict, shape: _shape(F.col("path"))})
    counts = rows.groupBy("host", F.col(shape).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(ruled) == "block", 1)).alias("n_block"),
        F.count(F.when(F.col(ruled) == "allow", 1)).alias("n_allow"),
    )
    made = cut(path_templates(cut(counts)))
    purity = F.sum("n_block") / (F.sum(F.col("n_block") + F.col("n_allow")) + PRIOR)
    judged = made.join(made.groupBy("host", "template").agg(purity.alias("purity")), ["host", "template"]).select(
        F.col("host").alias("_host"), F.col("shape").alias("_of"), "template", "purity"
    )
    out = rows.join(judged, (rows["host"] == judged["_host"]) & (rows[shape] == judged["_of"]), "left")
    own = F.when(F.col("purity") >= reject, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(
        *[rows[c] for c in kept], rows["host"], rows["path"], rows["rule"], judged["template"], judged["purity"],
        F.coalesce(rows[ruled], own).alias("verdict"),
    )
