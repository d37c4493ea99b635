"""Archives with payloads that hold magic words and whole records, in splits far smaller than a record."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from groundloom.llm import warc
from groundloom.llm.common import shared_path

SCHEMA = "page_id long, url string, html string, body string, digest string, file string"


def nested(n):
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: {n}\r\n\r\n" + "x" * n + "\r\n\r\n"


def rows():
    rng = random.Random(5)
    texts = ["", None, "short", "é" * 499, "é" * 500, "é" * 500, "a" * 1000, "a" * 1000, "a" * 1000, "b" * 999, "b" * 999]
    texts += ["WARC/1.0\r\n" * 200, "x" + nested(10) + "WARC/1.0\r\n", nested(3000), nested(5) * 30, nested(2_000_000), "WARC/1.0\r\nContent-Length: 3\r\n\r\n"]
    texts += ["".join(rng.choice("ab\r\nWARC/1.0 é") for _ in range(rng.randrange(3000))) for _ in range(150)]
    out = [(n, f"http://x/{n}\r\nWARC-Type: y", t, "c", "c", "c") for n, t in enumerate(texts)]
    return [*out, (None, None, "z" * 2000, "c", "c", "c"), (None, None, "z" * 2000, "c", "c", "c"), (None, "u", "a" * 1000, "c", "c", "c"), (8, "u", "a" * 1000, "c", "c", "c"), *out[20:24]]


def expected(data):
    newest = {}
    for key, _, html, *_ in data:
        if key is not None and len((html or "").encode()) >= 1000:
            newest[html] = max(newest.get(html, -1), key)
    for key, _, html, *_ in data:
        payload = (html or "").encode()
        refers = newest.get(html) if len(payload) >= 1000 else None
        refers = None if refers == key else refers
        yield key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if refers is not None else "response", refers


@pytest.mark.parametrize("split", ["512b", "100k", "128m"])
def test_round_trip(spark, split):
    data = rows()
    path = shared_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(data, SCHEMA).repartition(3, "page_id"), path)
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split != "512b" else "20k")
    try:
        got = warc.read_warc(spark, path)

        def page(c):
            return F.regexp_extract(c, "(\\d+)>", 1).try_cast("long")

        got = [tuple(r) for r in got.select(page("record"), "payload_bytes", "digest", "kind", page("refers")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert sorted(got, key=str) == sorted(expected(data), key=str)


def test_empty(spark):
    path = shared_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], SCHEMA), path)
    assert warc.read_warc(spark, path).count() == 0


def test_chain_stops_at_damage(spark):
    rows = [("f", 0, 10), ("f", 10, 20), ("f", 15, 30), ("f", 20, 33), ("f", 30, 40), ("g", 5, 9), ("g", 0, 9)]
    got = warc.reachable(spark.createDataFrame(rows, "file string, place long, next long")).select("file", "place").collect()
    assert sorted(map(tuple, got)) == [("f", 0), ("f", 10), ("f", 20), ("g", 0)]
