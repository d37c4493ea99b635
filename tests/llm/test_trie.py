"""The prefix trie against dictionaries of whole prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from groundloom.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, node string, shard string, conv string"


def shared(c):
    return zlib.crc32(str(c).encode()) % 6


def brute(rows):
    def digest(role, text):
        return hashlib.sha256(f"{len(role.encode())}:".encode() + (role + text).encode()).hexdigest()[:32]

    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(l)] for c, l in turns.items()}
    full = {c: (own.get(c - c % 100, [])[: shared(c)] + l[shared(c) :]) for c, l in own.items()}
    nodes = {}
    for c, l in full.items():
        for d in range(len(l) + 1):
            nodes.setdefault(tuple(l[:d]), []).append(c)
    kids = {p: [] for p in nodes}
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(full[c]) == len(p)))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def cases(rng):
    rows = []
    for c in [*range(60), *range(100, 140), 205, 233, 300, 999, 12345]:
        length = 0 if c == 100 else rng.randrange(1, 9)
        for turn in range(length):
            rows.append((c, turn, ["user", "assistant"][turn % 2], rng.choice(["hi", "Hi", "", "é漢", "more words"])))
    rows += [(2000 + c, turn, "user", "hot") for c in range(100, 190) for turn in range(4)]
    rows += [(400, turn, "user", "deep" if turn % 9 else "x") for turn in range(60)] + [(407, turn, "user", "deep" if turn % 9 else "x") for turn in range(58)]
    rows += [(500, None, "system", "first"), (500, 3, "a", "tie"), (500, 3, "a", "tie"), (500, 3, "b", "tie"), (500, None, None, None), (501, 1, None, "x"), (501, 2, "", None), (None, 1, "user", "nobody's")]
    rows += [(601, 0, "ab", "c"), (602, 0, "a", "bc"), (603, 0, "", "abc"), (604, 1, "user", "long " * 20000), (605, 1, "user", "long " * 20000)]
    rng.shuffle(rows)
    return rows


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "d", "n", "s", "c") for r in rows], SCHEMA).repartition(4)
    conv = F.col("conv")
    h = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(6))
    out = trie.prefix_trie(df, conv - conv % 100, h, 5, **sizes)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"least_rows": 4, "band": 4096, "queue": 2}, {"least_rows": 4, "band": 7, "queue": 2}, {"least_rows": 1 << 20, "band": 5}])
def test_against_dictionaries(spark, monkeypatch, sizes):
    monkeypatch.setattr(trie, "PIECE", 7)
    rows = cases(random.Random(3))
    assert run(spark, rows, **sizes) == brute(rows)


def test_conversation_over_many_tasks(spark):
    """One conversation holds nearly all turns, so several tasks hold parts of it."""
    rows = [(1100, t, "user", f"t{t % 13}") for t in range(900)] + [(1123, t, "user", f"t{t % 13}") for t in range(400)] + [(3, 0, "user", "a")]
    assert run(spark, rows, least_rows=50, band=128) == brute(rows)


def test_turnless_and_empty(spark):
    turnless = next(c for c in range(101, 200) if shared(c) > 1)
    assert run(spark, [(turnless, 0, "user", "gone")]) == brute([(turnless, 0, "user", "gone")])
    assert run(spark, []) == []
    assert run(spark, [(None, 0, "user", "x")]) == []


def test_queue():
    rng = random.Random(1)
    messages = [(rng.randrange(5), bytes([rng.randrange(4)]) * 16, 1, rng.randrange(9), n) for n in range(500)]
    queue = trie.SpillingQueue(7)
    for m in messages:
        queue.push(m)
    for level in range(5):
        for name in range(4):
            want = sorted(m[2:] for m in messages if m[:2] == (level, bytes([name]) * 16))
            assert sorted(queue.pop(level, bytes([name]) * 16)) == want
    assert not queue.heap and not queue.runs
