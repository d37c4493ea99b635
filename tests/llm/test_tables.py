"""Sharding, mixing, packing and token files against plain computations on awkward tables."""

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from groundloom.llm import mixing, packing, rans, sharding
from groundloom.llm.common import shared_path

SCHEMA = "doc_id long, text string, source string, shard string, target double"


def docs(spark, rows):
    return spark.createDataFrame([(k, t, s, "clash", 0.5) for k, t, s in rows], SCHEMA).repartition(3)


ROWS = [(None, "null key", "a"), (None, "null key", "a"), (1, None, "b"), (2, "", None), (3, "x " * 30_000, "b"), (4, "é漢 word", "c"), (4, "é漢 word", "c"), (4, "other", "c")]
ROWS += [(k, "word " * (k % 50), "abcdé"[k % 5] if k % 3 else "hot") for k in range(10, 400)]


def test_shards_fit(spark):
    rows = [*ROWS, *[(77, "copy " * 20, "hot")] * 300]
    table = docs(spark, rows).withColumn("size", F.octet_length("text"))
    out = sharding.assign_shards(table, "doc_id", "size", 2000).toPandas()
    assert len(out) == len(rows) and Counter(map(str, out.doc_id)) == Counter(str(float(k) if k is not None else float("nan")) for k, _, _ in rows)
    sums = out.assign(size=out["size"].fillna(0)).groupby("shard").agg(bytes=("size", "sum"), docs=("size", "size"), said=("shard_bytes", "first"), told=("shard_docs", "first"))
    assert (sums.bytes == sums.said).all() and (sums.docs == sums.told).all()
    assert ((sums.bytes <= 2000) | (sums.docs == 1)).all()
    assert (out.oversized == (out.shard_bytes > 2000)).all()
    names = sorted(set(out.shard))
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    parents = {n[:-1] for n in names}
    total = {p: out[out.shard.str.startswith(p)]["size"].fillna(0).sum() for p in parents}
    assert all(t > 2000 for t in total.values())


def targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return {s: share.get(s, 3 * sizes[s]) for s in order}
        capped |= over


@pytest.mark.parametrize("hot", [False, True])
def test_mixture(spark, hot):
    rows = ROWS + [(1000 + k, "w " * (k % 9), "tiny" if k < 5 else "hot") for k in range(600 if hot else 5)]
    table = docs(spark, rows).withColumn("size", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda x: x != "")))
    out = mixing.mix(table)
    got = out.toPandas()
    again = mixing.mix(table.repartition(5)).toPandas()
    assert len(got) == len(rows) and sorted(map(str, zip(got.doc_id, got.taken, strict=True))) == sorted(map(str, zip(again.doc_id, again.taken, strict=True)))
    sizes = Counter()
    for r in got.itertuples():
        sizes[r.source] += r.size
    want = targets(dict(sizes))
    for source, part in got.groupby(got.source.fillna("none")):
        source = None if source == "none" else source
        assert abs(part.target.iloc[0] - want[source]) < 1e-6 * max(1, want[source]) and part.source_size.iloc[0] == sizes[source]
        assert abs(part.taken.sum() - want[source]) <= part["size"].max()
    assert (got.taken == got.copies * got["size"]).all() and got.copies.between(0, 3).all() and got.taken.sum() <= got["size"].sum()
    assert mixing.repeat(out).count() == got.copies.sum()


def test_mixture_of_nothing(spark):
    assert mixing.mix(docs(spark, []).withColumn("size", F.lit(1))).count() == 0
    got = mixing.mix(docs(spark, [(1, "", "a"), (2, None, None)]).withColumn("size", F.lit(None).cast("int"))).toPandas()
    assert got.taken.tolist() == [0, 0] and got.target.tolist() == [0, 0]


def ids_of(name, rows):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [(k, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for k, t, _ in rows]


def test_packing(spark):
    got = packing.pack(docs(spark, ROWS), public_tokenizers.path("byte_bpe_50k.json"), length=64).collect()
    want = Counter()
    for k, ids in ids_of("byte_bpe_50k.json", ROWS):
        want[(k, len(ids), zlib.crc32(ids.tobytes()) if len(ids) < 2 else 0)] += 1
    ends = Counter((r.doc_id, r.doc_tokens, r.ids_crc32 if r.doc_tokens < 2 else 0) for r in got if r.start == 0)
    assert ends == want
    by = {(str(k), len(ids)): ids for k, ids in ids_of("byte_bpe_50k.json", ROWS)}
    fill = Counter()
    for r in got:
        ids = by[(str(r.doc_id), r.doc_tokens)][r.start : r.start + r.length]
        assert len(ids) == r.length and (zlib.crc32(ids.tobytes()) == r.ids_crc32 or r.doc_id in (None, 4))
        fill[r.sequence_id] += r.length
    assert all(fill[s] == 64 for s in range(max(fill))) and 0 < fill[max(fill)] <= 64
    places = sorted((r.sequence_id * 64 + r.offset, r.length) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(places, places[1:], strict=False)) and places[0][0] == 0


def test_token_file(spark, monkeypatch):
    monkeypatch.setattr(rans, "BLOCK_IDS", 500)
    path = shared_path(spark, "token-file")
    rows = [*ROWS, (5, "x y " * 170_000, "b"), (6, "after a long one", "b")]
    rans.write_ids(docs(spark, rows), path, public_tokenizers.path("word_bpe_49k.json"))
    got = rans.read_ids(spark, path).orderBy("start").collect()
    assert rans.read_ids(spark, path, with_ids=False).orderBy("start").collect() == [r[:4] for r in got]
    assert max(len(r.check_words) for r in spark.read.parquet(f"{path}/blocks").collect()) >= 2
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (k, ids) in zip(got, ids_of("word_bpe_49k.json", order), strict=True):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (k, at, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        at += len(ids)


def test_empty(spark):
    path = shared_path(spark, "token-file")
    rans.write_ids(docs(spark, []), path, public_tokenizers.path("word_bpe_49k.json"))
    assert rans.read_ids(spark, path).count() == 0
    assert packing.pack(docs(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert sharding.assign_shards(docs(spark, []).withColumn("size", F.lit(1)), "doc_id", "size", 9).count() == 0


def test_damaged_range(spark, monkeypatch):
    path, broken = shared_path(spark, "token-file"), shared_path(spark, "token-file")
    monkeypatch.setattr(rans, "BLOCK_IDS", 500)
    rans.write_ids(docs(spark, [(1, "x y " * 170_000, "a")]), path, public_tokenizers.path("word_bpe_49k.json"))
    spark.read.parquet(f"{path}/table").write.parquet(f"{broken}/table")
    blocks = spark.read.parquet(f"{path}/blocks")
    turned = F.transform("check_crc32", lambda c, i: F.when(i == 1, c.bitwiseXOR(1)).otherwise(c))
    blocks.withColumn("check_crc32", turned).write.parquet(f"{broken}/blocks")
    assert rans.read_ids(spark, path).count() == 1
    with pytest.raises(Exception, match="is damaged"):
        rans.read_ids(spark, broken).collect()


@given(st.binary(), st.binary())
def test_joined_checksums(first, second):
    assert rans.joined_crc32(zlib.crc32(first), zlib.crc32(second), len(second)) == zlib.crc32(first + second)


def test_coder():
    rng = np.random.default_rng(2)
    ids = np.minimum(rng.zipf(1.3, 300_000), 40_000).astype(np.uint16)
    symbols, counts = np.unique(ids, return_counts=True)
    coder = rans.Coder(symbols, rans.frequency_table(symbols, counts))
    share = counts / counts.sum()
    for n in (1, 2, 63, 64, 4097, len(ids)):
        block = coder.encode(ids[:n])
        assert (coder.decode(block) == ids[:n]).all()
        for check in range(1, len(block["check_words"]) + 1):
            assert (coder.decode(block, check) == ids[check * rans.CHECK_STEPS * block["lanes"] : n]).all()
    assert 8 * len(block["words"]) / len(ids) < -(share * np.log2(share)).sum() * 1.05
    block["words"] = bytes([block["words"][0] ^ 1]) + block["words"][1:]
    try:
        damaged = coder.decode(block)
    except ValueError:
        return
    assert zlib.crc32(damaged.astype("<u4").tobytes()) != block["crc32"]
