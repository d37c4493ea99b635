import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundloom.operators import lexical
from groundloom.operators import questions as N
from groundloom.operators import retrieval as R


def vectors(spark, n=400, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    base[n // 2 :] = base[0]  # half of all vectors are copies of one
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)]
    return base, spark.createDataFrame(rows, "chunk_id long, embedding array<double>").repartition(4)


def test_vector_topk_is_exact_in_blocks(spark):
    base, v = vectors(spark)
    q = v.filter("chunk_id < 12").select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("sub_id"), "embedding")
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    want = set()
    for i in range(12):
        scores = np.round(unit @ unit[i], 9)
        for rank, j in enumerate(np.lexsort((np.arange(len(base)), -scores))[:7], start=1):
            want.add((i, int(j), rank))
    small = {(r.query_id, r.chunk_id, r["rank"]) for r in R.vector_topk(q, v, k=7).collect()}
    large = {(r.query_id, r.chunk_id, r["rank"]) for r in R.vector_topk(q, v, k=7, block_queries=5, slot_vectors=90).collect()}
    assert small == want
    assert large == want


def corpus(spark):
    texts = ["the cat sat", "the dog sat sat", "a bird", "the the the cat dog", ""]
    return spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")


def queries(spark):
    return spark.createDataFrame([(1, 0, "cat cat sat"), (2, 0, "the bird"), (3, 0, "zebra")], "query_id long, sub_id int, q string")


def test_bm25_broadcast_and_shuffled_agree(spark):
    index = R.bm25_index(corpus(spark))
    one = {tuple(r) for r in R.bm25_topk(queries(spark), index).collect()}
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    two = {tuple(r) for r in R.bm25_topk(queries(spark), index).collect()}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert one == two and {r[0] for r in one} == {1, 2}


def plain_bm25(texts, asked, k, k1=1.5, b=0.75, epsilon=0.25):
    """Scores of a whole corpus by loops over dictionaries."""
    tokens = {c: re.findall("[a-z0-9_]+", t.lower()) for c, t in texts.items()}
    n, avgdl = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = Counter(t for ts in tokens.values() for t in set(ts))
    raw = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    out = set()
    for key, q in asked.items():
        scored = []
        for c, ts in tokens.items():
            tf, words = Counter(ts), re.findall("[a-z0-9_]+", q.lower())
            if any(w in tf for w in words):
                total = sum((raw[w] if raw[w] >= 0 else epsilon * mean) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(ts) / avgdl)) for w in words if w in tf)
                scored.append((-round(total, 9), c))
        out |= {(key, 0, c, rank) for rank, (_, c) in enumerate(sorted(scored)[:k], 1)}
    return out


def zipf(rng, n, width=400):
    words = [f"w{j}" for j in range(width)]
    weights = [1 / (j + 1) for j in range(width)]
    return {c: " ".join(rng.choices(words, weights, k=rng.randrange(0, 60))) for c in range(n)}


def ranks_of(spark, store, asked, k):
    q = spark.createDataFrame([(key, 0, text) for key, text in asked.items()], "query_id long, sub_id int, q string")
    return {(r.query_id, r.sub_id, r.chunk_id, r["rank"]) for r in R.bm25_topk(q, store.index(), k=k).collect()}


def test_bounds_change_no_rank(spark, tmp_path, monkeypatch):
    """Lists shorter than the corpus, with common and rare terms, ties, and terms in most chunks."""
    monkeypatch.setattr(lexical, "CELL", 16)
    rng = random.Random(5)
    texts = zipf(rng, 600) | {1000 + c: "same words here w0" for c in range(30)}
    asked = {k: " ".join(rng.choices([f"w{j}" for j in range(60)] + ["same", "here", "absent"], k=rng.randrange(1, 12))) for k in range(40)}
    store = R.LexicalStore(spark, str(tmp_path / "store")).add(spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3))
    for k in (1, 7, 50):
        assert ranks_of(spark, store, asked, k) == plain_bm25(texts, asked, k)


def test_negative_weights(spark, tmp_path):
    """In a corpus where most terms are in most chunks the floor of the weights is itself negative."""
    texts = {c: "a b c" + (" d" if c % 2 else "") + (" rare" if c == 3 else "") for c in range(12)}
    store = R.LexicalStore(spark, str(tmp_path / "store")).add(spark.createDataFrame(list(texts.items()), "chunk_id long, text string"))
    asked = {1: "a b", 2: "a d rare", 3: "c"}
    for k in (2, 20):
        assert ranks_of(spark, store, asked, k) == plain_bm25(texts, asked, k)


def test_changes_equal_a_rebuild(spark, tmp_path):
    """Segments, retired chunks and merges give the ranks of an index built from what is left."""
    rng = random.Random(6)
    texts, store = {}, R.LexicalStore(spark, str(tmp_path / "store"))
    asked = {k: " ".join(rng.choices([f"w{j}" for j in range(80)], k=6)) for k in range(12)}
    for step in range(7):
        changed = {step * 100 + c: " ".join(t.split()) for c, t in zipf(rng, 40).items()} | {c: "new " + texts[c] for c in rng.sample(sorted(texts), len(texts) // 9)}
        gone = set(rng.sample(sorted(texts), len(texts) // 11))
        texts = {c: t for c, t in (texts | changed).items() if c not in gone}
        new = spark.createDataFrame([(c, c, t) for c, t in changed.items() if c not in gone], "chunk_id long, doc_id long, text string")
        store.replace(new, spark.createDataFrame([(c,) for c in set(changed) | gone], "doc_id long"))
        if step in (3, 6):
            before = store.index()
            store.merge(fan=2)
            assert len(store.state()["segments"]) < 4
            assert before.terms.count() == store.index().terms.count()
        assert ranks_of(spark, store, asked, 9) == plain_bm25(texts, asked, 9)
    assert store.state()["n_docs"] == len(texts)


def test_no_exchange_carries_postings(spark, tmp_path):
    store = R.LexicalStore(spark, str(tmp_path / "store")).add(corpus(spark))
    asked = spark.createDataFrame([(1, 0, "cat")], "query_id long, sub_id int, q string")
    index = store.index()
    assert {r.bucket for r in index.terms.select("bucket").collect()} != {index.terms.where("term = 'cat'").first()["bucket"]}
    plan = R.bm25_topk(asked, index)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^]]*EqualTo\(bucket", plan)
    # Blocks move once, for the cell that is scored, and only those that met the asked terms before.
    moves = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "hashpartitioning(group" not in line]
    assert plan.count("Exchange hashpartitioning(group") and not any("term" in line and "docs" in line for line in moves)


def test_pad_zero_fills_lists(spark):
    ranks = R.bm25_topk(queries(spark), R.bm25_index(corpus(spark)), k=4)
    rows = R.pad_zero(ranks, queries(spark), corpus(spark), k=4).collect()
    lists = {q: [r.chunk_id for r in sorted(rows, key=lambda r: r["rank"]) if r.query_id == q] for q in (1, 2, 3)}
    assert all(len(set(v)) == 4 for v in lists.values()) and lists[3] == [0, 1, 2, 3]


def test_filter_keeps_ranks_and_empty_means_all(spark):
    ranks = spark.createDataFrame([(1, 0, "vec", 10, 1, 1), (1, 0, "vec", 11, 2, 2), (2, 0, "vec", 10, 1, 1)], "query_id long, sub_id int, source string, chunk_id long, rank int, doc_id long")
    allow = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in R.doc_filter(ranks, allow).collect()} == {(1, 11, 2), (2, 10, 1)}


def test_phrase_hits(spark):
    asks = spark.createDataFrame([(1, 0, "Reading the A+ book"), (2, 0, "videos, and more"), (3, 0, "")], "chat_id long, turn int, text string")
    phrases = spark.createDataFrame([("a",), ("re",), ("THE",), ("read",), ("and more",), ("zz",), ("",)], "phrase string")
    found = {tuple(r) for r in N.phrase_hits(asks, phrases).collect()}
    want = {(i, 0, p) for i, t in [(1, "reading the a+ book"), (2, "videos, and more"), (3, "")] for p in ["a", "re", "the", "read", "and more", "zz"] if p in t}
    assert found == want


def test_many_phrases_with_one_head(spark):
    words = [f"the{k}" for k in range(10_000)]
    asks = spark.createDataFrame([(1, 0, "the " + " ".join(words[:50])), (2, 0, "none"), (3, 0, None)], "chat_id long, turn int, text string")
    found = {tuple(r) for r in N.phrase_hits(asks, spark.createDataFrame([(w,) for w in words], "phrase string")).collect()}
    text = "the " + " ".join(words[:50])
    assert found == {(1, 0, w) for w in words if w in text}


def test_texts_stay_in_their_buckets(spark, tmp_path):
    """A selection above the broadcast threshold is shuffled to the texts, which have no exchange of their own."""
    chunks = corpus(spark).withColumn("breadcrumb", F.lit("b"))
    stored = R.store_chunks(chunks, str(tmp_path / "chunks"), buckets=4)
    again = R.open_chunks(spark, str(tmp_path / "chunks"), buckets=4)
    selected = spark.createDataFrame([(1, 3), (1, 0), (2, 3), (2, 77)], "query_id long, chunk_id long")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    for texts in (stored, again):
        joined = R.with_chunks(selected, texts)
        assert {(r.query_id, r.text) for r in joined.collect()} == {(1, "the the the cat dog"), (1, "the cat sat"), (2, "the the the cat dog")}
        plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
        assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)


def test_clusters_out_of_reach_are_skipped(spark, monkeypatch):
    """Tight groups of vectors: ranks equal those of the whole table, and most clusters are never met."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 16))
    base = np.concatenate([centres[i % 8] + 0.02 * rng.normal(size=(1, 16)) for i in range(1200)] + [np.zeros((2, 16))])
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(base)], "chunk_id long, embedding array<double>").repartition(4)
    q = v.filter("chunk_id % 50 = 0 OR chunk_id = 1200").select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("sub_id"), "embedding")
    met = []
    monkeypatch.setattr(R, "_meet_in_cells", lambda pairs, *rest, inner=R._meet_in_cells: (met.append(pairs.count()), inner(pairs, *rest))[1])
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in R.vector_topk(q, v, k=9, slot_vectors=60).collect()}
    norm = np.linalg.norm(base, axis=1, keepdims=True)
    unit = base / np.where(norm > 0, norm, 1)
    want = set()
    for i in [*range(0, 1200, 50), 1200]:
        scores = np.round(unit @ unit[i], 9)
        want |= {(i, int(j), rank) for rank, j in enumerate(np.lexsort((np.arange(len(base)), -scores))[:9], 1)}
    assert got == want
    # Of at least 20 groups of clusters each question meets that of its nearest one, and few others reach its floor.
    assert met[0] == 25 and met[1] < 25 * 20 / 4, met


def test_groups_of_clusters_are_bounded():
    """Neighbours fill groups up to the limit, larger clusters stand alone in slots; no cluster is lost."""
    rng = np.random.default_rng(8)
    pivots = R._unit(rng.normal(size=(40, 8)))
    sizes = rng.integers(0, 30, 40)
    sizes[[3, 17]] = 250
    group, slots = R._groups(sizes, pivots, 100)
    held = np.bincount(group, sizes, len(slots))
    assert all(-(-n // 100) <= s <= max(1, -(-n // 100)) for n, s in zip(held, slots))
    for large in (3, 17):
        assert slots[group[large]] == 3 and held[group[large]] - 250 <= 0
    assert sum(held) == sizes.sum() and len(slots) < 40


def test_phrase_shards_agree(spark, monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choice("abé ") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    texts = [(k, 0, "".join(rng.choice("abéÉ A") for _ in range(rng.randrange(120)))) for k in range(50)]
    asks = spark.createDataFrame(texts, "chat_id long, turn int, text string").repartition(3)
    phrases = spark.createDataFrame([(w,) for w in words], "phrase string")
    want = {(k, 0, w) for k, _, t in texts for w in words if w.lower() in t.lower()}
    for size in (1 << 21, 200):
        monkeypatch.setattr(N, "SHARD_CHARS", size)
        assert {tuple(r) for r in N.phrase_hits(asks, phrases).collect()} == want


def test_a_hundred_thousand_phrases_with_one_head(spark):
    words = [f"the {k:06}" for k in range(100_000)]
    text = " ".join(words[::2500])
    asks = spark.createDataFrame([(1, 0, text), (2, 0, "the")], "chat_id long, turn int, text string")
    found = N.phrase_hits(asks, spark.createDataFrame([(w,) for w in words], "phrase string"))
    assert {tuple(r) for r in found.collect()} == {(1, 0, w) for w in words[::2500]}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_search_writes_no_rows_by_cell(spark, tmp_path, monkeypatch):
    """What a search writes grows with the questions' terms, not with cells times questions or cells times terms."""
    monkeypatch.setattr(lexical, "CELL", 4)
    rng = random.Random(9)
    texts = {c: t + " w0 w1" for c, t in zipf(rng, 300).items()}
    asked = {k: " ".join(f"w{j}" for j in rng.sample(range(30), 6)) for k in range(20)}
    store = R.LexicalStore(spark, str(tmp_path / "store")).add(spark.createDataFrame(list(texts.items()), "chunk_id long, text string").repartition(3))
    written = []

    def counting(df, purpose, inner=lexical.materialize):
        out = inner(df, purpose)
        written.append(out.count())
        return out

    monkeypatch.setattr(lexical, "materialize", counting)
    assert ranks_of(spark, store, asked, 5) == plain_bm25(texts, asked, 5)
    assert 0 < sum(written) <= 20 * 6


@pytest.mark.parametrize("slab", [8, 64])
def test_slabs_and_groups_change_no_rank(spark, tmp_path, monkeypatch, slab):
    """Many slabs of few cells and many groups of few questions, after changes; a text is null."""
    monkeypatch.setattr(lexical, "CELL", 8)
    rng = random.Random(slab)
    texts = zipf(rng, 200, 60)
    asked = {k: " ".join(rng.choices([f"w{j}" for j in range(60)], k=rng.randrange(1, 9))) for k in range(25)}
    store = R.LexicalStore(spark, str(tmp_path / "store"))
    store.add(spark.createDataFrame([(c, c, t or None) for c, t in texts.items()], "chunk_id long, doc_id long, text string").repartition(3))
    gone, changed = set(range(0, 200, 7)), {c: "w1 w2 " + texts[c] for c in range(0, 200, 14)}
    store.replace(spark.createDataFrame([(c, c, t) for c, t in changed.items()], "chunk_id long, doc_id long, text string"), spark.createDataFrame([(c,) for c in gone], "doc_id long"))
    texts = {c: t for c, t in texts.items() if c not in gone} | changed
    monkeypatch.setattr(lexical, "SLAB", slab)
    monkeypatch.setattr(lexical, "QUESTIONS", 4)
    for k in (1, 6, 300):
        assert ranks_of(spark, store, asked, k) == plain_bm25(texts, asked, k)
