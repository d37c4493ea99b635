"""Near-duplicate documents against comparing all pairs."""

import math
import random
import re

from groundloom.llm import near_dedup
from groundloom.llm.components import components
from groundloom.llm.shingles import shingle_set, word_hashes

SCHEMA = "doc_id long, text string, n_shingles string, component_id string"


def shingles(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(data):
    """Components of keys, linked where any rows of two keys are."""
    sets = [(k, shingles(t)) for k, t in data]
    least = {k: k for k, _ in data if k is not None}

    def top(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    return [(k, len(s), None if k is None else top(k), k is None or top(k) == k) for k, s in sets]


def check(spark, data, parts=5):
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in data], SCHEMA).repartition(parts)
    got = [tuple(r) for r in near_dedup.near_documents(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(data), key=str)


def edited(rng, words, share):
    return [rng.choice("pqrstuvw") * rng.randrange(1, 9) if rng.random() < share else w for w in words]


def test_groups(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng = random.Random(2)
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d e", "A b\tc d  e", "é " * 9, "x" * 300_000, "y " * 60_000, "y " * 60_001]
    for size in (40, 120, 300):
        base = [f"{size}w{rng.randrange(10**6)}" for _ in range(size)]
        texts += [" ".join(base)] * 4 + [" ".join(edited(rng, base, share)) for share in (0.005, 0.01, 0.02, 0.03, 0.05, 0.2) for _ in range(12)]
        texts += [" ".join(base[k:] + [f"t{k}"]) for k in range(0, size // 2, 3)]
    passage = " ".join(f"p{k}" for k in range(60))
    texts += [passage + " " + " ".join(f"d{k}x{j}" for j in range(70)) for k in range(60)]
    data = list(enumerate(texts))
    rng.shuffle(data)
    data = [(k + 1000, t) for k, t in data] + [(None, texts[12]), (None, None), (1014, texts[14]), (1014, texts[14])]
    check(spark, data)


def test_coordinates_follow_the_similarity():
    """The probability of a miss at the limit itself stays below ``MISSED``, with as many coordinates as that allows."""
    for enough in (50, 80, 85, 95):
        share, least = enough / 100, near_dedup.matches(enough)
        fewer = [sum(math.comb(64, k) * share**k * (1 - share) ** (64 - k) for k in range(n)) for n in (least, least + 1)]
        assert fewer[0] <= near_dedup.MISSED < fewer[1]
    assert (near_dedup.matches(80), near_dedup.matches(85)) == (33, 38)


def test_one_key_of_two_texts(spark):
    words = [f"w{k}" for k in range(100)]
    other = [f"v{k}" for k in range(100)]
    check(spark, [(5, " ".join(words)), (9, " ".join(words)), (9, " ".join(other)), (12, " ".join(other)), (13, " ".join([*other, "z"])), (20, "alone")])


def test_empty(spark):
    assert near_dedup.near_documents(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hashes_of_long_texts(monkeypatch):
    """A text cut into steps has the hashes of one that isn't."""
    from groundloom.llm import shingles as module

    rng = random.Random(1)
    texts = ["".join(rng.choice("aB \té\n") for _ in range(n)).encode() for n in (0, 1, 50, 3000, 20_000)]
    whole = [w.tolist() for w in word_hashes(texts)]
    monkeypatch.setattr(module, "STEP_BYTES", 64)
    assert [w.tolist() for w in word_hashes(texts)] == whole
    assert len(shingle_set(word_hashes([b"a b c d e f"])[0])) == 2


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1100)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 4), (7, None)]
    least = {}

    def top(x):
        least.setdefault(x, x)
        while least[x] != x:
            x = least[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            least[y] = x
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert sorted(map(tuple, got)) == sorted((k, top(k)) for k in list(least))
