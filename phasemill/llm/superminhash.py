"""Near-duplicate documents by SuperMinHash (Ertl, 2017), banding, exact verification and union-find.

* Documents of equal shingle sets are one class, found by a 128-bit hash of the set, before anything is
  paired; classes of any size cost one row from there on.
* Signatures are banded; the members of a bucket are first compared with a hub, the member that shares most
  buckets, then with further hubs while that still joins components. So a group of n near copies costs
  about n comparisons. Members already in one component are never compared again.
* What hubs leave open is finished exactly, from each member's difference to its hub: two members can be
  linked only if both share a shingle that the hub lacks, or if a bound on sizes alone allows it. Members too
  far from their hub for this argument are compared pair by pair.
* Every link is confirmed on the full sets, rebuilt from the texts of the candidates only.
* Components are found by union-find in chunks of links; what chunks leave is contracted by the library's
  alternating star joins.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasemill.llm.texts import WordHashes, as_bytes, cut, lists, lower_words, mix, ngram_hashes, signed, unused, word_chunks
from phasemill.operators.components import star_roots
from phasemill.session import join_small

BAND_ROWS = 4
MISSED = 1e-5  # chance that a pair at the threshold shares no band
PROGRESS = 0.05  # links per open bucket member below which no further round of hubs is made
NEAR = 0.5  # similarity to the hub from which a member's difference to it is looked at
CHUNK_LINKS = 500_000  # links that one task joins by union-find
_LOW = np.uint64(0xFFFFFFFF)


def bands_for(threshold: float, rows: int = BAND_ROWS, missed: float = MISSED) -> int:
    return math.ceil(math.log(missed) / math.log1p(-(threshold**rows)))


def least_agreement(m: int, threshold: float, missed: float = MISSED) -> int:
    """Largest count of equal components that a pair at the threshold reaches with chance 1 - missed."""
    below = 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * threshold**k * (1 - threshold) ** (m - k)
        if below > missed:
            return k
    return m


def shingle_sets(words: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each document of a chunk: (values, starts).

    A document of fewer than n words, but not none, has its whole sequence as the one shingle.
    """
    count = np.diff(starts)
    grams = ngram_hashes(words, n)
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(words))
    inside = at + n <= starts[1:][doc] if len(words) else np.zeros(0, bool)
    doc_of, value = doc[inside], grams[at[inside]]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = []
        for d in short:
            own = words[starts[d] : starts[d + 1]]
            whole.append(ngram_hashes(own, len(own))[0] ^ np.uint64(len(own)))
        doc_of, value = np.concatenate([doc_of, short]), np.concatenate([value, np.array(whole, np.uint64)])
    order = np.lexsort((value, doc_of))
    doc_of, value = doc_of[order], value[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (doc_of[1:] != doc_of[:-1]) | (value[1:] != value[:-1])
    sizes = np.bincount(doc_of[fresh], minlength=len(count))
    return value[fresh], np.concatenate([[0], np.cumsum(sizes)])


def superminhash(value: np.ndarray, starts: np.ndarray, m: int) -> np.ndarray:
    """SuperMinHash signatures (documents x m, uint64) of sorted distinct elements.

    Step j gives every element the value j + r (r uniform in [0, 1), 32 bits) at the j-th place of the
    element's own random permutation, drawn one swap at a time. A document is finished after step j once
    all its components are below j + 1, so large documents end after one or two steps.
    """
    docs = len(starts) - 1
    h = np.full((docs, m), np.uint64(0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(docs), np.diff(starts))
    live, state = np.arange(len(value)), mix(value)
    perm = None
    for j in range(m):
        if len(live) == 0:
            break
        draw = mix(state + np.uint64(j))
        k = j + (((draw & _LOW) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
        if j == 0:
            place = k
        else:
            rows = np.arange(len(live))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(h, (doc[live], place), (np.uint64(j) << np.uint64(32)) | (draw >> np.uint64(32)))
        open_docs = (h >= (np.uint64(j + 1) << np.uint64(32))).any(axis=1)
        stay = open_docs[doc[live]]
        if j == 0:
            # permutations are kept only for elements of documents that need a second step
            perm = np.tile(np.arange(m, dtype=np.uint16), (int(stay.sum()), 1))
            perm[np.arange(len(perm)), place[stay]] = 0
        else:
            perm = perm[stay]
        live, state = live[stay], state[stay]
    return h


def _set_keys(value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums of mixed elements: equal for equal sets."""
    one, two = mix(value), mix(value ^ np.uint64(0x5851F42D4C957F2D))
    sums = []
    for x in (one, two):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
        sums.append(total[starts[1:]] - total[starts[:-1]])
    return sums[0], sums[1]


Split = Callable[[bytes | None], list[bytes]]


def sketches(docs: DataFrame, shingle: int, m: int, split: Split = lower_words) -> DataFrame:
    """(doc_id, text_key, n_shingles, k1, k2, bands, sig): bands are bucket hashes, sig the low 16 bits of the signature."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, words, starts in word_chunks(as_bytes(batch[1]), split):
                value, at = shingle_sets(hashes.of(words), starts, shingle)
                n = np.diff(at)
                h = superminhash(value, at, m)
                k1, k2 = _set_keys(value, at)
                bands = np.zeros((len(n), m // BAND_ROWS), np.uint64)
                for b in range(bands.shape[1]):
                    x = np.full(len(n), b, np.uint64)
                    for r in range(BAND_ROWS):
                        x = mix(x + h[:, b * BAND_ROWS + r])
                    bands[:, b] = x
                sig = h.astype(np.uint16).view(np.int16)
                rows = np.arange(len(n) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch[0].slice(first, len(n)), batch[2].slice(first, len(n)), pa.array(n), pa.array(signed(k1)), pa.array(signed(k2)),
                        lists(signed(bands).ravel(), rows * bands.shape[1], pa.int64()),
                        lists(sig.ravel(), rows * m, pa.int16()),
                    ],
                    ["doc_id", "text_key", "n_shingles", "k1", "k2", "bands", "sig"],
                )

    return docs.mapInArrow(
        sketch,
        "doc_id bigint, text_key bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>, sig array<smallint>",
   
    )


def full_sets(docs: DataFrame, shingle: int, split: Split = lower_words) -> DataFrame:
    """(doc_id, items): the distinct shingles of each text, as 64-bit hashes."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first, words, starts in word_chunks(as_bytes(batch[1]), split):
                value, at = shingle_sets(hashes.of(words), starts, shingle)
                yield pa.RecordBatch.from_arrays(
                    [batch[0].slice(first, len(starts) - 1), lists(signed(value), at, pa.int64())], ["doc_id", "items"]
                )

    return docs.mapInArrow(build, "doc_id bigint, items array<bigint>")


def _star_pairs(members: DataFrame, hubs: DataFrame) -> DataFrame:
    return (
        members.join(hubs, "bucket").filter("doc_id <> hub AND (hub_root IS NULL OR root <> hub_root)")
        .select(F.least("doc_id", "hub").alias("a"), F.greatest("doc_id", "hub").alias("b")).distinct()
    )


def _union(pdf: pd.DataFrame) -> pd.DataFrame:
    """Smallest connected node of every node of a chunk of links."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root.setdefault(top, top) != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = list(root)
    return pd.DataFrame({"node": nodes, "root": [find(x) for x in nodes]})


def link_roots(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that every node of the links (a, b) is connected to.

    Chunks are dealt by both ends, so that the links of one hub fill as many chunks as their number asks for.
    """
    links = cut(links)
    chunks = max(1, math.ceil(links.count() / CHUNK_LINKS))
    dealt = links.withColumn("chunk", F.pmod(F.xxhash64("a", "b"), F.lit(chunks)))
    local = cut(dealt.groupBy("chunk").applyInPandas(_union, "node bigint, root bigint"))
    if chunks == 1:
        return local
    return cut(star_roots(local.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), []))


def near_links(
    reps: DataFrame, texts: DataFrame, shingle: int, percent: int, m: int, split: Split = lower_words
) -> DataFrame:
    """Components (node, root) of the links `100 * |A n B| >= percent * |A u B|` between representatives.

    `reps` has one row per class (doc_id, n_shingles, bands, sig of m values), `texts` its texts (doc_id, text).
    """
    placed = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = cut(placed.join(shared, "bucket"))
    score = members.groupBy("doc_id").agg(F.sum("n").alias("score"))
    sigs = reps.select("doc_id", "n_shingles", "sig")
    agree = least_agreement(m, percent / 100)
    equal = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e))
    alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & (equal >= agree)

    def side(x: str) -> DataFrame:
        return sigs.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))

    def meet(pairs: DataFrame, likely: Column) -> DataFrame:
        """(a, b, na, nb, xa, xb, both): the full sets of the pairs whose sizes and signatures are `likely`."""
        few = cut(pairs.join(side("a"), "a").join(side("b"), "b").filter(likely).select("a", "b", "na", "nb"))
        wanted = few.select(F.col("a").alias("doc_id")).union(few.select("b")).distinct()
        # ids are measured first: while they are few they go to the texts, which then stay where they are
        mine = join_small(texts, wanted, "doc_id", "left_semi").select("doc_id", "text")
        sets = cut(full_sets(mine, shingle, split))
        out = few.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("xa")), "a")
        out = out.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("xb")), "b")
        return out.withColumn("both", F.size(F.array_intersect("xa", "xb")))

    def confirm(pairs: DataFrame) -> DataFrame:
        linked = F.col("both") * 100 >= (F.col("na") + F.col("nb") - F.col("both")) * percent
        return cut(meet(pairs, alike).filter(linked).select("a", "b"))

    best = F.max(F.struct("score", (-F.col("doc_id")).alias("minus")))
    first = cut(
        members.join(score, "doc_id").groupBy("bucket").agg(best.alias("h")).select("bucket", (-F.col("h.minus")).alias("hub"))
    )
    hubs = first.withColumn("hub_root", F.lit(None).cast("bigint"))
    open_members, links, turn = members.select("bucket", "doc_id", F.col("doc_id").alias("root")), None, 0
    while True:
        found = confirm(_star_pairs(open_members, hubs))
        links = found if links is None else links.unionByName(found)
        roots = link_roots(links)
        labelled = cut(
            open_members.select("bucket", "doc_id").join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
            .withColumn("root", F.coalesce("root", "doc_id"))
        )
        mixed = labelled.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi")
        open_members = cut(labelled.join(mixed.select("bucket"), "bucket", "left_semi"))
        n = open_members.count()
        if n == 0:
            return roots
        if found.count() < PROGRESS * n:
            break
        turn += 1
        pick = F.min(F.struct(F.xxhash64("doc_id", "bucket", F.lit(turn)).alias("o"), "doc_id", "root"))
        hubs = open_members.groupBy("bucket").agg(pick.alias("h")).select(
            "bucket", F.col("h.doc_id").alias("hub"), F.col("h.root").alias("hub_root")
        )
    more, rest = _open_links(open_members, first, meet, side, alike, equal >= least_agreement(m, NEAR), percent)
    return link_roots(links.unionByName(more).unionByName(confirm(rest)))


def _open_links(
    open_members: DataFrame, hubs: DataFrame, meet: Callable, side: Callable, alike: Column, within: Column, percent: int
) -> tuple[DataFrame, DataFrame]:
    """(links, pairs to confirm) between different components in open buckets; all links are among them.

    With A = hub - lack + extra, |A n B| = |hub| - |lack of A or B| + |extra of both|, so members within NEAR of
    their hub are compared exactly by their small differences to it. Only pairs are looked at that share an extra
    shingle, or whose sizes alone allow a link: |A n B| <= |hub| - the larger lack, which for a member that is not
    linked to the hub asks for a partner smaller than the hub. By the triangle inequality, every link of a
    member of similarity NEAR + (1 - threshold) or more to the hub has its other end within NEAR; such members
    are settled by this, the others are paired inside their bucket.
    """
    at_hub = open_members.join(hubs, "bucket")
    toward = at_hub.filter("doc_id <> hub").select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    either = F.col("na") + F.col("nb") - F.col("both")
    seen = cut(
        meet(toward, within).filter(F.col("both") >= either * NEAR).select(
            F.col("a").alias("doc_id"), F.col("b").alias("hub"), F.col("nb").alias("n_hub"),
            (F.col("nb") - F.col("both")).alias("lacks"), (F.col("na") - F.col("both")).alias("more"),
            F.array_except("xb", "xa").alias("lack"), F.array_except("xa", "xb").alias("extra"),
            (F.col("both") * 100 >= either * (100 * NEAR + 100 - percent)).alias("settled"),
            (F.col("both") * 100 >= either * percent).alias("linked"),
        )
    )
    group = cut(seen.join(open_members.select("doc_id", "root").distinct(), "doc_id"))
    t = percent
    sizes = "(2 * p.n_hub - p.lacks - q.lacks + p.more + q.more)"
    differ = "p.hub = q.hub AND p.root <> q.root AND (p.settled OR q.settled)"

    def reaches(shared: str) -> str:
        """The sizes allow a link if `shared` extra shingles are common."""
        return f"{100 + t} * (p.n_hub - greatest(p.lacks, q.lacks) + {shared}) >= {t} * {sizes}"

    scalars = group.drop("lack", "extra")
    items = group.drop("lack").withColumn("item", F.explode("extra")).drop("extra")
    common = items.alias("p").join(
        items.alias("q"),
        F.expr(f"{differ} AND p.item = q.item AND p.doc_id < q.doc_id AND {reaches('least(p.more, q.more)')}"),
    )
    short = scalars.filter("lacks > more")
    sized = scalars.filter("NOT linked").alias("p").join(
        short.alias("q"), F.expr(f"{differ} AND p.doc_id <> q.doc_id AND {reaches('0')}")
    )

    def ends(df: DataFrame, shared: Column) -> DataFrame:
        pair = [F.least("p.doc_id", "q.doc_id").alias("a"), F.greatest("p.doc_id", "q.doc_id").alias("b")]
        need = F.expr(f"ceil({t} * {sizes} / {100 + t}) - p.n_hub + p.lacks + q.lacks").alias("need")
        top = F.expr("least(p.lacks, q.lacks)").alias("most")
        return df.groupBy(F.col("p.hub").alias("hub"), *pair, need, top).agg(shared.alias("shared"))

    # |A n B| = |hub| - lacks - lacks + common lack + common extra, so `need` counts what must be common
    tallied = ends(common, F.count(F.lit(1))).unionByName(ends(sized, F.lit(0).cast("bigint")))
    tallied = tallied.groupBy("hub", "a", "b", "need", "most").agg(F.max("shared").alias("shared"))
    narrow = cut(tallied.filter("most + shared >= need"))
    lack = group.select("hub", "doc_id", "lack")
    exact = narrow.join(lack.withColumnsRenamed({"doc_id": "a", "lack": "la"}), ["hub", "a"]).join(
        lack.withColumnsRenamed({"doc_id": "b", "lack": "lb"}), ["hub", "b"]
    ).filter(F.size(F.array_intersect("la", "lb")) + F.col("shared") >= F.col("need"))
    loose = at_hub.filter("doc_id <> hub").join(group.filter("settled").select("hub", "doc_id"), ["hub", "doc_id"], "left_anti")
    loose = loose.select("bucket", "doc_id", "root")
    a = loose.select("bucket", F.col("doc_id").alias("a"), F.col("root").alias("ra")).join(side("a"), "a")
    b = loose.select(F.col("bucket").alias("bucket_b"), F.col("doc_id").alias("b"), F.col("root").alias("rb")).join(side("b"), "b")
    pairs = a.join(b, (F.col("bucket") == F.col("bucket_b")) & (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & alike)

    return exact.select("a", "b").distinct(), pairs.select("a", "b").distinct()


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text",
    split: Split = lower_words,
) -> DataFrame:
    """`docs` with `n_shingles`, `component_id` (smallest doc_id reachable over links) and `kept`.

    Two documents are linked if `100 * |A n B| >= percent * |A u B|` for their sets of distinct shingles
    of `shingle` words. Null, empty and wordless texts have no shingles and are linked with nothing. Rows
    that repeat a doc_id and text get the same result; texts that share a doc_id count as one document.
    Rows without doc_id are linked with nothing, have a null component and are kept. Result columns
    replace input columns of the same name.
    """
    m = bands_for(percent / 100) * BAND_ROWS
    source = docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key")
    )
    made = cut(sketches(source, shingle, m, split))
    whole = made.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut(whole.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    first = classes.select(F.col("rep").alias("doc_id"), "k1", "k2")
    reps = cut(
        whole.join(first, ["doc_id", "k1", "k2"], "left_semi").dropDuplicates(["doc_id", "k1", "k2"])
        .select("doc_id", "n_shingles", "bands", "sig")
    )
    roots = near_links(reps, source, shingle, percent, m, split)
    classes = classes.join(roots.select(F.col("node").alias("rep"), "root"), "rep", "left").select(
        "k1", "k2", F.coalesce("root", "rep").alias("root")
    )
    name = {c: unused(docs, f"_{c}") for c in ("id", "text_key", "n", "root")}
    placed = (
        made.select("doc_id", "text_key", "n_shingles", "k1", "k2").join(classes, ["k1", "k2"], "left")
        .groupBy(F.col("doc_id").alias(name["id"]), F.col("text_key").alias(name["text_key"]))
        .agg(F.min("n_shingles").alias(name["n"]), F.min("root").alias(name["root"]))
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_shingles", "component_id", "kept")]
    own, key = unused(docs, "_left_id"), unused(docs, "_left_key")
    left = docs.select(*kept, F.col(doc_id).cast("bigint").alias(own), F.xxhash64(text).alias(key))
    out = left.join(
        placed,
        left[own].eqNullSafe(placed[name["id"]]) & (left[key] == placed[name["text_key"]]), "left",
    )
    component = F.when(F.col(own).isNotNull(), F.coalesce(F.col(name["root"]), F.col(own)))
    return out.select(
        *[left[c] for c in kept], F.col(name["n"]).alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col(own) == component, F.lit(True)).alias("kept"),
    )
