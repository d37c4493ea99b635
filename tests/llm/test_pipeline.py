"""The corpus pipeline against plain computations of each stage on what the stage before it kept."""

import random

import corpus_pipeline
from groundloom.llm.common import stored


def words(rng, n):
    return " ".join(rng.choice(["the", "of", "and", "ation", "ing", "erst"]) + rng.choice(["", "er", "on", "ly", "th"]) for _ in range(n)) + "."


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    clean = [(k, words(rng, rng.randrange(30, 300)), "en", f"src{k % 4}" if k % 3 else "hot") for k in range(240)]
    junk = [(1000 + k, " ".join(f"{w}###$$$" for w in words(rng, 50).split()).upper(), "en", "hot") for k in range(20)]
    near = [(2000 + k, clean[5][1], "en", "src1") for k in range(5)] + [(2100, clean[7][1] + " one more", "en", "src1")]
    odd = [(3000, None, "en", "hot"), (3001, "", None, None), (None, words(rng, 60), "en", None), (17, clean[17][1], "en", "hot")]
    rows = [(*r, 1) for r in clean + junk + near + odd]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k, *_ in clean[:200]] + [(1000 + k, 0, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "mixing sources", "packing"]

    kept = stored(corpus_pipeline.good_quality(spark, docs, str(tmp_path)), "t")
    assert kept.columns == docs.columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert not any(k in texts for k, *_ in junk) and 3000 not in texts and 3001 not in texts
    assert sum(k in texts for k, *_ in clean) >= 0.98 * len(clean)

    unique = stored(corpus_pipeline.one_of_each(spark, kept, str(tmp_path)), "t")
    left = [r.doc_id for r in unique.collect()]
    assert len(left) == len(set(left)) and set(left) == set(texts) - {2000, 2001, 2002, 2003, 2004, 2100}

    mixed = stored(corpus_pipeline.mixture(spark, unique, str(tmp_path)), "t")
    sizes = {r.doc_id: (r.source, len(r.text.split())) for r in unique.collect()}
    taken = {}
    for r in mixed.collect():
        taken.setdefault(r.source, []).append(sizes[r.doc_id][1])
    from test_tables import targets

    total = {}
    for source, n in sizes.values():
        total[source] = total.get(source, 0) + n
    for source, target in targets(total).items():
        assert abs(sum(taken.get(source, [])) - target) <= max(n for s, n in sizes.values() if s == source)

    pieces = corpus_pipeline.packed(spark, mixed, str(tmp_path)).collect()
    assert sum(r.start == 0 for r in pieces) == mixed.count()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in mixed.collect()}
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert whole.agg({"length": "sum"}).first()[0] == sum(r.length for r in pieces)


def test_clashing_columns_pass_through(spark, tmp_path):
    """Columns named like anything that a stage makes come out as they went in."""
    names = ["target", "source_size", "copies", "taken", "size", "row", "rest", "keep", "ppl", "threshold", "_score", "_chars", "_lang", "_row", "place", "component_id", "kept", "key"]
    rng = random.Random(2)
    rows = [(k, words(rng, 40), "en", "ab"[k % 2], 1, *(f"{c} {k}" for c in names)) for k in range(30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in names)
    docs = spark.createDataFrame(rows, schema).repartition(2)
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        left = out.collect()
        assert left and all(r[c] == f"{c} {r.doc_id}" for r in left for c in names)
    assert corpus_pipeline.packed(spark, docs, str(tmp_path)).agg({"doc_id": "max"}).first()[0] == 29


def test_near_pairs_from_80(spark, tmp_path):
    """Pairs with 80 to 84.99 % of their shingles in common leave one document, pairs just below 80 % both."""
    rows, gone = [], set()
    for k, (own, more) in enumerate([(400, 100), (400, 96), (400, 80), (400, 71), (80, 20), (1500, 370), (400, 101), (400, 110)]):
        base = [f"w{k}x{j}" for j in range(own + 4)]
        rows += [(10 * k, " ".join(base), "en", "s", 1), (10 * k + 1, " ".join(base + [f"v{k}x{j}" for j in range(more)]), "en", "s", 1)]
        gone |= {10 * k + 1} if 100 * own >= 80 * (own + more) else set()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    left = sorted(r.doc_id for r in corpus_pipeline.one_of_each(spark, docs, str(tmp_path)).collect())
    assert len(gone) == 6 and left == sorted({r[0] for r in rows} - gone)
