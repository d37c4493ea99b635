"""The Kneser-Ney model against a plain one, and the classifier on held-out labels."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from groundloom.llm import quality


def plain_model(texts, order):
    """Probabilities of the interpolated modified Kneser-Ney model, by recursion over dictionaries."""
    counts = {order: Counter()}
    for t in texts:
        padded = quality.START * (order - 1) + t
        for i in range(len(t)):
            counts[order][padded[i : i + order]] += 1
    for n in range(order - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts = {}
    for n, table in counts.items():
        ones = Counter(table.values())
        y = ones[1] / (ones[1] + 2 * ones[2]) if ones[1] else 0
        exact = [k - (k + 1) * y * ones[k + 1] / ones[k] if ones[1] and ones[k] else 0 for k in (1, 2, 3)]
        discounts[n] = [min(d, k) if d > 0 else 0.5 for k, d in zip((1, 2, 3), exact, strict=True)]
    contexts = {n: defaultdict(list) for n in counts}
    for n, table in counts.items():
        for g, c in table.items():
            contexts[n][g[:-1]].append(c)

    def p(gram):
        n = len(gram)
        seen = contexts[n].get(gram[:-1])
        if not seen:
            return p(gram[1:])
        d, total = discounts[n], sum(seen)
        weight = sum(d[min(c, 3) - 1] for c in seen) / total
        c = counts[n][gram]
        own = (c - d[min(c, 3) - 1]) / total if c else 0.0
        return own + weight * (p(gram[1:]) if n > 1 else 1 / (len(seen) + 1))

    return p


def test_perplexity(spark, monkeypatch):
    rng = random.Random(8)
    trusted = ["".join(rng.choice(["ab", "a", "c", " é", "漢", "\n"]) for _ in range(rng.randrange(60))) for _ in range(40)]
    others = ["", "abab", "zzz", "ab\x01 é漢", "a" * 3000, *trusted[:3]]
    rows = [(k, "x", t, "clash") for k, t in enumerate(trusted)] + [(100 + k, "x", t, "clash") for k, t in enumerate(others)] + [(200, None, "ab", "c"), (201, "y", None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, ppl string").drop("ppl")
    sample = docs.where("doc_id < 100").select(F.col("lang").alias("_lang"), F.col("text").alias("_text"))
    counts = sample.mapInArrow(quality._counted, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))
    model = quality.train(quality.stored(counts, "grams"))
    p = plain_model(trusted, quality.ORDER)
    for entries in (quality.PASS_ENTRIES, 300):
        monkeypatch.setattr(quality, "PASS_ENTRIES", entries)
        got = {r.doc_id: r.ppl for r in quality.with_perplexity(docs, model).collect()}
        assert len(got) == len(rows)
        for k, lang, text, _ in rows:
            if lang != "x" or not text:
                assert got[k] is None
                continue
            padded = quality.START * (quality.ORDER - 1) + text
            want = math.exp(-sum(math.log(p(padded[i : i + quality.ORDER])) for i in range(len(text))) / len(text))
            assert abs(got[k] / want - 1) < 1e-4, text[:20]


def test_sums_to_one():
    texts = ["abcab", "bca", "aab"]
    p = plain_model(texts, 3)
    assert abs(sum(p("ab" + c) for c in "abc") + p("abz") - 1) < 1e-9


def test_held_out_labels(spark):
    """Documents whose labels the classifier hasn't seen: nearly all clean ones stay, most of the others go."""
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    seen = labels.where("doc_id % 2 = 0")
    docs = spark.read.parquet(f"{base}/documents.parquet")
    judged = quality.classify(docs, seen, carry=False).join(labels.where("doc_id % 2 = 1"), "doc_id")
    share = {(r.quality, r.toxic): r.share for r in judged.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("double")).alias("share")).collect()}
    assert share[1, 0] > 0.97 and share[0, 0] < 0.25


def test_odd_rows(spark):
    schema = "doc_id long, lang string, text string, ppl string, keep string"
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, None), (2, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "en", "some text", "c", "c"), (1, "en", "some text", "c", "c"), (2, "en", None, "c", "c"), (3, None, "text", "c", "c"), (None, "xx", "text", "c", "c"), (4, "en", "", "c", "c")]
    got = quality.classify(spark.createDataFrame(rows, schema), labels).collect()
    assert sorted((str(r.doc_id), r.keep) for r in got if not r.text) == [("2", False), ("4", False)]
    assert len(got) == 6 and all(r.keep for r in got if r.text and r.lang != "en")
    assert quality.classify(spark.createDataFrame([], schema), labels).count() == 0
    assert quality.classify(spark.createDataFrame(rows, schema), labels.limit(0), carry=False).count() == 6


@pytest.mark.parametrize("carry", [True, False])
def test_texts_without_characters_go(spark, carry):
    """Also where their language has no threshold, and whether the text is carried or not."""
    rows = [(1, "en", "some text"), (2, "en", None), (3, "en", ""), (4, None, ""), (5, "xx", None), (6, "xx", "text")]
    names = ["_score", "_chars", "_lang", "_text", "name", "rest", "some", "threshold"]
    schema = "doc_id long, lang string, text string, " + ", ".join(f"{c} string" for c in names)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.classify(spark.createDataFrame([(*r, *names) for r in rows], schema), labels, carry=carry)
    assert out.columns == ["doc_id", "lang", *(["text"] if carry else []), *names[:-1], "ppl", "threshold", "keep"]
    got = {r.doc_id: r for r in out.collect()}
    assert {k: r.keep for k, r in got.items()} == {1: True, 2: False, 3: False, 4: False, 5: False, 6: True}
    assert all(r[c] == c for r in got.values() for c in names[:-1])


def test_threshold_and_keep(spark):
    """Thresholds are the quantile of the held-out trusted documents of each language, and decide alone."""
    rng = random.Random(4)
    words = {"en": ["stone", "river", "light"], "de": ["Stein", "Fluss", "Licht"]}
    docs = [(k, lang, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(3, 30)))) for k in range(300) for lang in [rng.choice(["en", "de"])]]
    docs += [(1000 + k, "en", "".join(chr(rng.randrange(33, 126)) for _ in range(80))) for k in range(20)]
    labels = [(k, 1, 0) for k in range(200)] + [(k, 0, 0) for k in range(1000, 1005)] + [(k, 1, 1) for k in range(200, 220)]
    frame = spark.createDataFrame(docs, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in quality.classify(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), carry=False).collect()}
    held_out = {r.doc_id for r in frame.where(F.pmod(F.xxhash64("doc_id"), F.lit(quality.HELD_OUT)) == 0).collect() if r.doc_id < 200}
    for lang in words:
        ppl = sorted(got[k].ppl for k, l, _ in docs if l == lang and k in held_out)
        limit = ppl[math.ceil(quality.QUANTILE * len(ppl)) - 1] * quality.MARGIN
        for k, l, _ in docs:
            if l == lang:
                assert abs(got[k].threshold / limit - 1) < 1e-9 and got[k].keep == (got[k].ppl <= limit)
    assert not any(got[1000 + k].keep for k in range(20))
