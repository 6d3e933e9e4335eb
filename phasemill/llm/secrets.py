"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger holds the pairs of blob and
rule version that were scanned, and the spans found. A scan takes the blobs whose pairs are not all in it,
fetches one version of each, runs only the rules that are new to it, and appends. Findings are joined back to
all paths that ever held the blob. Column functions only: pieces between matches (`split`) and matches
(`regexp_extract_all`) give lengths, and running sums of the lengths give positions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasemill.llm.texts import BROADCAST_BYTES, cut, join_spread

# fixed values: the three base rules. `hex` and `access` name their least length in the pattern, which finds
# the same spans, because a match takes its whole run of characters; `assign` looks at its value afterwards,
# because a match that is too short still takes its characters away from later ones.
_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. `value`: the group that must have at least `least` characters (0: the whole match)."""

    kind: str
    pattern: str
    value: int = 0
    least: int = 1
    version: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}:{self.version}"


BASE = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("bearer", r"[Bb]earer\x20+([A-Za-z0-9._~+/-]{20,})"),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_password", r"://[A-Za-z0-9._-]{1,64}:[^\x00-\x20@/]{4,128}@"),
    Rule("prefixed_key", "(ghp|gho|ghs|ghu|glpat|xoxb|xoxp|sk_live|rk_live|npm)[_-][A-Za-z0-9_-]{20,}"),
)

SCANNED = "blob binary, rules array<string>"
SPAN = "blob binary, kind string, version int, start bigint, stop bigint"
MOST_RULES = 62  # bits of the mask of rules in one scan


@dataclass
class Ledger:
    """What was scanned (blob, names of rule versions) and what was found (blob, kind, version, start, stop).

    With a folder both are Parquet tables there, appended by every scan: findings first, so that a scan lost
    between the two is repeated; spans that repeat are one. Without a folder they last as long as the session.
    """

    spark: SparkSession
    folder: str | None = None
    _scanned: DataFrame | None = None
    _spans: DataFrame | None = None

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder.rstrip('/')}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def scanned(self) -> DataFrame:
        held = self._read("scanned", SCANNED) if self.folder else self._scanned
        return self.spark.createDataFrame([], SCANNED) if held is None else held

    def spans(self) -> DataFrame:
        held = self._read("spans", SPAN) if self.folder else self._spans
        return self.spark.createDataFrame([], SPAN) if held is None else held.distinct()

    def append(self, spans: DataFrame, scanned: DataFrame) -> None:
        if self.folder:
            spans.write.mode("append").parquet(f"{self.folder.rstrip('/')}/spans")
            scanned.write.mode("append").parquet(f"{self.folder.rstrip('/')}/scanned")
        else:
            self._spans = cut(spans) if self._spans is None else self._spans.unionByName(cut(spans))
            self._scanned = cut(scanned) if self._scanned is None else self._scanned.unionByName(cut(scanned))


def _content(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def address(versions: DataFrame) -> DataFrame:
    """path, version and blob of every row; a null text is an empty blob."""
    return versions.select("path", "version", F.unhex(F.sha2(_content(), 256)).alias("blob"))


def _lengths(rule: Rule) -> Column:
    """For every match: characters between it and the one before, its own, and whether its value is long enough."""
    text, pattern = F.col("text"), F.lit(rule.pattern)

    def sizes(pieces: Column) -> Column:
        return F.transform(pieces, lambda piece: F.length(piece).cast("bigint"))

    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else matches
    zipped = F.arrays_zip(
        sizes(F.split(text, rule.pattern, -1)).alias("gap"), sizes(matches).alias("size"), sizes(value).alias("value")
    )
    return F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), i.cast("int").alias("at"), z["gap"].alias("gap"),
            z["size"].alias("size"), (z["value"] >= rule.least).alias("holds"),
        ),
    )


def _bit(at: int) -> Column:
    return F.lit(1 << at).cast("bigint")


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Spans (blob, kind, version, start, stop) in rows of blob, text and `pending`, the mask of rules to run.

    Leftmost non-overlapping matches of each rule, in code points, the end exclusive. A rule that does not
    match costs one look at the text; a window orders the matches of one rule in one text.
    """
    kind = "array<struct<kind:string,version:int,at:int,gap:bigint,size:bigint,holds:boolean>>"
    per_rule = [
        F.when((F.col("pending").bitwiseAND(_bit(i)) != 0) & F.col("text").rlike(rule.pattern), _lengths(rule).cast(kind))
        for i, rule in enumerate(rules)
    ]
    looked = blobs.select("blob", F.explode(F.array_compact(F.array(*per_rule))).alias("m"))
    rows = looked.select("blob", F.inline("m")).filter("size IS NOT NULL")
    so_far = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far))
    return placed.filter("holds").select("blob", "kind", "version", (F.col("stop") - F.col("size")).alias("start"), "stop")


def _unseen(held: DataFrame, ledger: Ledger, rules: tuple[Rule, ...]) -> DataFrame:
    """Blobs that some rule version has not seen: one place of each, and the mask of these rules."""
    blobs = held.groupBy("blob").agg(F.min(F.struct("path", "version")).alias("at"))
    seen = sum((F.array_contains("rules", r.name).cast("bigint") * _bit(i) for i, r in enumerate(rules)), F.lit(0).cast("bigint"))
    known = ledger.scanned().groupBy("blob").agg(F.bit_or(seen).alias("seen"))
    every = F.lit((1 << len(rules)) - 1).cast("bigint")
    pending = every.bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
    return blobs.join(known, "blob", "left").withColumn("pending", pending).filter("pending != 0")


def _fetch(versions: DataFrame, unseen: DataFrame) -> DataFrame:
    """The texts of the chosen places. Their list is broadcast up to 32 MB; beyond that texts are shuffled once.

    A place with several texts gives all of them: spans depend on the text alone, so that none is wrong.
    """
    places = unseen.select(F.col("at.path").alias("_path"), F.col("at.version").alias("_version"), "pending")
    path = F.coalesce(F.octet_length(F.col("_path").cast("string")), F.lit(0))
    total = places.agg(F.sum(path + 64)).first()[0] or 0
    here = F.col("path").eqNullSafe(F.col("_path")) & F.col("version").eqNullSafe(F.col("_version"))
    texts = versions.select("path", "version", _content().alias("text"))
    found = texts.join(F.broadcast(places) if total <= BROADCAST_BYTES else places, here)
    return found.select(F.unhex(F.sha2("text", 256)).alias("blob"), "text", "pending")


def scan(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = BASE + MORE, addresses: DataFrame | None = None) -> DataFrame:
    """Bring the ledger up to date with all versions and rules; returns the addresses (path, version, blob).

    `versions`: path, version, text; other columns are ignored. Null paths and versions are values like others,
    rows may repeat, and a place may hold several texts. Each pair of blob and rule version is scanned once,
    however many paths hold the blob. An empty table scans nothing. A blob is one row: its text has to fit a
    task. `addresses` may be given if `address(versions)` was written before.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules a scan; scan again with the others")
    held = cut(address(versions)) if addresses is None else addresses
    unseen = cut(_unseen(held, ledger, rules))
    names = F.array(*[F.when(F.col("pending").bitwiseAND(_bit(i)) != 0, F.lit(r.name)) for i, r in enumerate(rules)])
    ledger.append(find_spans(_fetch(versions, unseen), rules), unseen.select("blob", F.array_compact(names).alias("rules")))
    return held


def span_list(spans: Column) -> Column:
    """kind:start:stop of an array as given by `findings`, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def findings(addresses: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """Every path and version with its spans under the given rules: path, version, blob and `spans`, an array of
    (start, place, kind, stop) sorted by start, then by the place of the kind in `rules`; empty if there are none."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    span = F.struct("start", F.array_position(kinds, F.col("kind")).cast("int").alias("place"), "kind", "stop")
    mine = ledger.spans().filter(F.concat_ws(":", "kind", F.col("version").cast("string")).isin([r.name for r in rules]))
    per_blob = mine.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,place:int,kind:string,stop:bigint>>")
    joined = join_spread(addresses, per_blob, "blob", "path", "left", row_bytes=F.size("spans") * 96 + 96)
    return joined.withColumn("spans", F.coalesce("spans", none))
