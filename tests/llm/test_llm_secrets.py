"""Secret scans against regular expressions in Python, and the ledger from scan to scan."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from phasemill.llm import secrets

VERSIONS = "path bigint, version int, text string"
FORMS = {  # the rules as the contract writes them: pattern, group, least characters
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18),
    "hex": ("[0-9a-f]+", 0, 16),
}


def brute(text):
    found = []
    for place, (kind, (pattern, group, least)) in enumerate(FORMS.items()):
        found += [(m.start(), place, kind, m.end()) for m in re.finditer(pattern, text or "", re.ASCII) if len(m.group(group)) >= least]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def made():
    r = random.Random(11)
    bits = [
        "password", "PassWD", "secret", "token", "api_key", "APIKEY", "=", ":", " ", "'", '"', "abcdefghijkl", "abc", "AKIA", "AKIAABCDEFGH1234567", "AKIAAKIA1234", "0123456789abcdef",
        "deadbeef", "é", "🙂", "\n", "==", "token: token: abcdefghijklmn", "secret=secret=abcdefghijk", "Key",
    ]
    texts = ["".join(r.choice(bits) for _ in range(r.randrange(1, 30))) for _ in range(150)]
    return [*texts, None, "", "0123456789abcdef " * 3000, "token = '" + "x" * 50_000 + "'", texts[0], texts[0]]


@pytest.fixture(scope="module")
def versions(spark):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(made())], VERSIONS).repartition(3)
    return df.withColumn("blob", F.lit("mine")).withColumn("pending", F.lit("mine")).withColumn("_path", F.lit("mine"))


def listed(held, ledger, rules):
    return {(r.path, r.version): r.s for r in secrets.findings(held, ledger, rules).withColumn("s", secrets.span_list(F.col("spans"))).collect()}


@pytest.mark.parametrize("limit", [0, 32 << 20])
def test_base_spans_equal_python(spark, versions, monkeypatch, limit):
    from phasemill.llm import texts

    monkeypatch.setattr(secrets, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(texts, "BROADCAST_BYTES", limit)
    ledger = secrets.Ledger(spark)
    held = secrets.scan(versions, ledger, secrets.BASE)
    assert listed(held, ledger, secrets.BASE) == {(i, 1): brute(t) for i, t in enumerate(made())}


def test_base_spans_stay_when_rules_are_added(spark, versions):
    ledger = secrets.Ledger(spark)
    held = secrets.scan(versions, ledger)
    found = secrets.findings(held, ledger).withColumn("base", secrets.span_list(F.filter("spans", lambda s: s["place"] <= 3)))
    assert {r.path: r.base for r in found.collect()} == {i: brute(t) for i, t in enumerate(made())}


def test_only_unseen_pairs_are_scanned(spark, tmp_path):
    ledger = secrets.Ledger(spark, str(tmp_path))
    hexa = "f" * 20
    first = spark.createDataFrame([(1, 1, hexa), (2, 1, hexa), (3, 1, "plain"), (None, None, None)], VERSIONS)
    secrets.scan(first, ledger, secrets.BASE)
    assert ledger.scanned().count() == 3 and ledger.spans().count() == 1
    secrets.scan(first, ledger, secrets.BASE)
    assert ledger.scanned().count() == 3
    later = first.union(spark.createDataFrame([(1, 2, hexa + "!AKIA" + "A" * 20), (4, 1, hexa)], VERSIONS))
    newer = (*secrets.BASE[:2], secrets.Rule("hex", "[0-9a-f]{20,}", version=2))
    held = secrets.scan(later, ledger, newer)
    pairs = {(bytes(r.blob), rule) for r in ledger.scanned().collect() for rule in r.rules}
    assert len(pairs) == 3 * 3 + 3 + 3  # three old blobs with base rules and the new version; one new blob with three rules
    assert sum(len(r.rules) for r in ledger.scanned().collect()) == len(pairs)
    assert listed(held, ledger, newer) == {
        (1, 1): "hex:0:20", (2, 1): "hex:0:20", (3, 1): "", (None, None): "", (1, 2): "hex:0:20,access:21:45", (4, 1): "hex:0:20"
    }


def test_scan_reads_only_texts_of_unseen_blobs(spark, versions):
    ledger = secrets.Ledger(spark)
    held = secrets.scan(versions, ledger)
    blobs = len({hashlib.sha256((t or "").encode()).digest() for t in made()})
    assert held.count() == len(made()) and ledger.scanned().count() == blobs
    assert secrets._unseen(held, ledger, secrets.BASE + secrets.MORE).count() == 0


def test_empty_and_added_rules(spark):
    none = spark.createDataFrame([], VERSIONS)
    ledger = secrets.Ledger(spark)
    assert secrets.findings(secrets.scan(none, ledger), ledger).count() == 0
    text = "-----BEGIN RSA PRIVATE KEY----- Bearer abcdefghijklmnopqrstuvwx https://user:hunter22@host ghp_abcdefghijklmnopqrstuvwxyz"
    held = secrets.scan(spark.createDataFrame([(1, 1, text)], VERSIONS), ledger)
    kinds = [s.kind for s in secrets.findings(held, ledger).first().spans]
    assert kinds == ["private_key", "bearer", "url_password", "prefixed_key"]
