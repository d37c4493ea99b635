"""Fingerprints against a plain computation of the same sketches."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from groundloom.llm import fingerprints as fp


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    grams = [words[i : i + 5] for i in range(len(words) - 4)] if len(words) >= 5 else [words] if words else []
    out = set()
    for gram in grams:
        h = 42
        for w in gram:
            h = xxhash.xxh64_intdigest(w.encode(), seed=h)
        out.add(h - (1 << 64) if h >> 63 else h)
    return out


def sketch(text):
    return sorted(shingles(text))[: fp.K]


def near(a, b):
    union = sorted(set(a) | set(b))[: fp.K]
    return 1.0 if not a and not b else len(set(union) & set(a) & set(b)) / len(union)


def printed(s):
    return "".join(f"{h & (2**64 - 1):016X}" for h in s)


def expected(data):
    order = sorted(data, key=lambda r: (r[1] is not None, r[1] or ""))
    order.sort(key=lambda r: -(1 << 63) if r[0] is None else r[0], reverse=True)
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        s, e, n = sketch(text), sketch(edited), sketch(after)
        yield key, len(text), hashlib.sha256(edited.encode()).hexdigest(), printed(s), printed(e), near(s, e), near(s, n)


@pytest.mark.parametrize("n", [1, 2, 60])
def test_fingerprints(spark, monkeypatch, n):
    monkeypatch.setattr(fp, "RANGE_DOCS", 5)
    rng = random.Random(n)
    pool = ["a", "B", "é", "漢", "The", "x y", "\n", "\t", " ", "  "]
    data = [(rng.randrange(-50, 50) * 2, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 3, 8, 400])))) for _ in range(n)]
    data = list(dict(data).items())
    data += [(None, "tail of all"), (101, None), (103, ""), (105, "one two three four"), (107, "w " * 50_000)] if n > 2 else []
    docs = spark.createDataFrame([(k, t, "clash", 1) for k, t in data], "doc_id long, text string, fingerprint string, n_chars int").repartition(7)
    got = [tuple(r)[:7] for r in fp.fingerprints(docs).collect()]
    assert sorted(got, key=str) == sorted(expected(data), key=str)


def test_empty(spark):
    assert fp.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 5 + [(1, None)], "doc_id long, text string")
    rows = fp.fingerprints(docs).collect()
    assert len(rows) == 6 and len({r.fingerprint for r in rows if r.n_chars}) == 1


def test_estimates_and_merging(spark):
    rng = random.Random(1)
    words = [str(rng.randrange(10**6)) for _ in range(6000)]
    a, b = words[:4000], words[2000:]
    parts = [("a", " ".join(a[:2000])), ("a", " ".join(a[1996:])), ("b", " ".join(b)), ("none", "")]
    sketched = fp.with_sketch(spark.createDataFrame(parts, "key string, text string"), "text", "s")
    merged = fp.merge_sketches(sketched, "key", "s")
    by = {r.key: r.s for r in merged.collect()}
    assert by["a"] == sketch(" ".join(a)) and by["b"] == sketch(" ".join(b)) and by["none"] == []
    both = merged.where("key = 'a'").select(F.col("s").alias("a")).crossJoin(merged.where("key = 'b'").select(F.col("s").alias("b")))
    r = both.select(fp.resemblance("a", "b").alias("r"), fp.containment("a", "b").alias("c"), fp.distinct_shingles("a").alias("n")).first()
    assert abs(r.r - 1 / 3) < 0.15 and abs(r.c - 0.5) < 0.2 and abs(r.n / 3996 - 1) < 0.35
