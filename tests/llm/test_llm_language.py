"""What the language model learns from: distinct texts, whatever their number of copies."""

import math
import random
from pathlib import Path

import pytest

from phasemill.llm import langid
from phasemill.llm.texts import table

SF = "/root/testdata/sf0.01"
LETTERS = {"aa": "abcdefg", "bb": "mnopqrst"}


def text(r, lang, words=30):
    return " ".join("".join(r.choice(LETTERS[lang]) for _ in range(r.randrange(2, 7))) for _ in range(words))


def test_a_language_of_copies_keeps_all_its_texts(spark):
    r = random.Random(1)
    few = [text(r, "aa") for _ in range(5)]
    rows = [(t, "aa") for t in few for _ in range(400)] + [("12 34", "aa")] * 50 + [(text(r, "bb"), "bb") for _ in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = langid.fit(df, sample_per_lang=10, centroids=5)
    assert {r["lang"]: r["count"] for r in model.centroids.groupBy("lang").count().collect()} == {"aa": 5, "bb": 5}
    got = langid.identify(df.filter("lang = 'aa'").distinct(), model).collect()
    assert {r.text for r in got if r.lang_pred == "aa" and r.score > 0.999 and not r.rejected} == set(few)


def foreign():
    r = random.Random(3)
    out = {
        "finnish": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja "
        "omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "polish": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i "
        "sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "turkish": "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve "
        "birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
        "russian": "Все люди рождаются свободными и равными в своем достоинстве и правах",
        "chinese": "人人生而自由，在尊严和权利上一律平等。",
    }
    for n in (5, 50):
        out[f"hex {n}"] = " ".join(f"{r.getrandbits(64):016x}" for _ in range(n))
        out[f"letters {n}"] = " ".join("".join(chr(97 + r.randrange(26)) for _ in range(r.randrange(2, 10))) for _ in range(3 * n))
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_foreign_and_junk_texts_are_rejected_and_own_held_out_texts_are_kept(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang").filter("lang IS NOT NULL")
    model = langid.fit(docs.filter("doc_id % 3 <> 1"))
    own = langid.identify(docs.filter("doc_id % 3 = 1 AND text RLIKE '\\\\p{L}'"), model).collect()
    assert len(own) > 200 and sum(r.rejected for r in own) <= 0.01 * len(own)
    df = spark.createDataFrame(list(foreign().items()), "name string, text string")
    assert [r.name for r in langid.identify(df, model).collect() if not r.rejected] == []


def test_any_number_of_languages_is_compared_block_by_block(spark):
    r = random.Random(5)
    names = [f"l{i:02}" for i in range(40)]
    alphabet = {n: r.sample("abcdefghijklmnopqrstuvwxyz", 5) for n in names}
    words = lambda n: " ".join("".join(r.choice(alphabet[n]) for _ in range(r.randrange(2, 7))) for _ in range(40))
    rows = [(words(n), n) for n in names for _ in range(6)]
    train = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    ask = spark.createDataFrame([(words(n), n) for n in names] + [(None, None), ("12", None)], "text string, lang string")
    one, many = (langid.fit(train, centroids=1, block_centroids=b) for b in (1000, 7))
    assert one.blocks == 1 and many.blocks == 6
    a, b = ({(x.text, x.lang): (x.lang_pred, round(x.score, 5), x.rejected) for x in langid.identify(ask, m).collect()} for m in (one, many))
    assert a == b and len(a) == 42 and a[(None, None)] == ("und", 0.0, True)
    assert sum(v[0] == k[1] for k, v in a.items()) >= 38


def test_nearest_centroid_equals_plain_scan(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(text(r, n), n) for n in LETTERS for _ in range(30)], "text string, lang string")
    model = langid.fit(df, sample_per_lang=20)
    centers = [(c.lang, c.center, c.reach) for c in model.centroids.collect()]
    for row in langid.identify(df, model).collect():
        tf = {}
        raw = (" " + row.text + " ").encode()
        counts = langid.ngram_counts(row.text.encode())
        assert counts.sum() == 2 * len(raw) - 3
        for k, n in enumerate(counts.tolist()):
            if n:
                tf[k] = (1 + math.log(n)) * float(model.idf[k])
        norm = math.sqrt(sum(v * v for v in tf.values()))
        cos = [(sum(v * c[k] for k, v in tf.items()) / norm, lang, reach) for lang, c, reach in centers]
        best = max(cos)
        assert row.score == pytest.approx(best[0], abs=1e-5) and row.lang_pred == best[1]
        assert row.rejected == (best[0] < langid.SLACK * best[2])
