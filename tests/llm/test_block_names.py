"""Exact duplicates by block naming against a plain grouping of normalised texts."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from groundloom.llm import block_names

SCHEMA = "doc_id long, text string, row long, name string, key string, kept boolean, group_size string"


def brute(rows):
    groups = {}
    for n, (key, text) in enumerate(rows):
        groups.setdefault((text or "").encode().lower(), []).append((key, n))
    out = []
    for text, members in groups.items():
        keys = [k for k, _ in members if k is not None]
        keep = max(keys) if keys else None
        out += [(k, keep, len(members), hashlib.sha256(text).hexdigest()) for k, _ in members]
    return out


def order(rows):
    return sorted(rows, key=str)


def texts(rng):
    base = ["", None, "a", "A", "É", "é", "x" * 16, "x" * 17, "X" * 16 + "y", "ab" * 500, "ab" * 500 + "c", "ß" * 33, "\x00", "\x00\x00", "İ", "K"]
    base += ["".join(rng.choice("abAB \n") for _ in range(rng.randrange(200))) for _ in range(40)]
    # Equal first, last or middle blocks in different texts; one block is the start of another.
    base += [("p" * 16) * k + tail for k in range(1, 9) for tail in ("", "q", "p" * 16 + "q")]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(1000 + k, rng.choice(base)) for k in range(150)] + [(2000 + k, "hot " * 40) for k in range(120)]
    rows += [(None, "lone key"), (None, "null keys"), (None, "Null Keys"), (5, "same key"), (5, "Same key"), (5, "a"), (7, "long " * 5000), (8, "LONG " * 5000), (9, "long " * 4999 + "lonG!")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [16, 4096])
def test_against_grouping(spark, monkeypatch, block):
    monkeypatch.setattr(block_names, "BLOCK", block)
    rows = texts(random.Random(block))
    df = spark.createDataFrame([(k, t, 1, "n", "k", True, "g") for k, t in rows], SCHEMA).repartition(5)
    out = block_names.exact_duplicates(df).collect()
    assert order((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == order(brute(rows))
    stay = [(r.text_sha256, r.doc_id, r.keep_id) for r in out if r.kept]
    assert len(stay) == len({s for s, *_ in stay}) == len({r.text_sha256 for r in out})
    assert all(key == keep for _, key, keep in stay)


def test_names_of_equal_hashes(spark):
    """Contents that share their hash keep names of their own, also where several tasks hold them."""
    rows = [(n, 0, 1, f"content {n % 7}".encode()) for n in range(300)]
    df = spark.createDataFrame(rows, "row long, pos long, blocks long, block binary").repartition(4)
    out = block_names.named(df, ["block"], digest=lambda *c: F.lit(3).cast("long")).collect()
    names = {}
    for r in out:
        names.setdefault(r.row % 7, set()).add(r.name)
    assert len(out) == 300 and all(len(x) == 1 for x in names.values()) and len(set.union(*names.values())) == 7


def test_empty(spark):
    out = block_names.exact_duplicates(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
