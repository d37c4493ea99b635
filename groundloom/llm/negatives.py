"""Hard negatives by exact integer scores: matrix products modulo small primes, put together by Chinese remaindering."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: Components that one float32 product sums up: with residues of at most 510 either way, sums stay below 2**24 and are exact.
DEPTH, LARGEST_PRIME = 64, 1021
#: Anchors per block, vectors per slot, and scores that a task holds at once.
BLOCK_ANCHORS, SLOT_VECTORS, CELLS = 1 << 12, 1 << 14, 1 << 21
_NONE = np.iinfo(np.int64).min


def primes(bound: int) -> list[int]:
    """Primes from ``LARGEST_PRIME`` down whose product exceeds the number of integers from ``-bound`` to ``bound``."""
    found, product = [], 1
    for p in range(LARGEST_PRIME, 2, -2):
        if all(p % d for d in range(3, math.isqrt(p) + 1, 2)):
            found.append(p)
            product *= p
            if product > 2 * bound + 1:
                return found
    raise ValueError("scores need more primes than there are")


def _centred(a: np.ndarray, p: int) -> np.ndarray:
    """Residues from ``-(p - 1) / 2`` to ``(p - 1) / 2``."""
    r = a % p
    return r - p * (r > p // 2)


def exact_scores(a: np.ndarray, b: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Inner products of the integer rows of ``a`` and ``b`` in int64, given that no product is as large as half the moduli's product.

    Each modulus has one product of residue matrices in float32, in steps of ``DEPTH`` components whose sums are exact. The scores'
    digits in the mixed radix of the moduli follow one by one (Garner), balanced around zero, so signs come out by themselves.
    """
    digits, total, radix = [], np.zeros((len(a), len(b)), np.int64), 1
    for n, p in enumerate(moduli):
        left, right = _centred(a, p).astype(np.float32), _centred(b, p).astype(np.float32)
        residue = np.zeros(total.shape, np.int32)
        for k in range(0, a.shape[1], DEPTH):
            residue = (residue + (left[:, k : k + DEPTH] @ right[:, k : k + DEPTH].T).astype(np.int32)) % p
        known, place = np.zeros(total.shape, np.int32), 1
        for digit, q in zip(digits, moduli[:n], strict=True):
            known = (known + digit * np.int32(place)) % p
            place = place * q % p
        digit = _centred((residue - known) % p * np.int32(pow(place, -1, p)), p).astype(np.int32)
        digits.append(digit)
        # The last places may exceed an int64 where the score doesn't; arithmetic modulo 2**64 is right all the same.
        total += digit * np.array(radix % (1 << 64), np.uint64).view(np.int64)
        radix *= p
    return total


def _best(scores: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray]]:
    """Per row the places of its ``k`` highest wanted scores, equal scores by place."""
    masked = np.where(wanted, scores, _NONE)
    limit = np.partition(masked, -k, axis=1)[:, -k] if masked.shape[1] > k else np.full(len(masked), _NONE)
    for row, least in enumerate(limit):
        own = np.flatnonzero(wanted[row] & (masked[row] >= least))
        yield row, own[np.lexsort((own, -masked[row, own]))[:k]]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in column]).reshape(len(column), -1)


def _sliced(anchors: pd.DataFrame, vectors: pd.DataFrame, moduli: list[int]):
    """Slices of the anchors with their exact scores against the slot's vectors, which are in order of their keys."""
    a, b = _matrix(anchors["ints"]), _matrix(vectors["ints"])
    step = max(1, CELLS // len(vectors))
    for at in range(0, len(anchors), step):
        yield anchors.iloc[at : at + step], exact_scores(a[at : at + step], b, moduli)


def _positives(moduli: list[int], k: int):
    def run(anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(vectors):
            vectors = vectors.sort_values("key", kind="stable")
            keys, labels = vectors["key"].to_numpy(), vectors["label"].to_numpy()
            for own, scores in _sliced(anchors, vectors, moduli):
                like = (labels == own["label"].to_numpy()[:, None]) & (keys != own["key"].to_numpy()[:, None])
                for row, at in _best(scores, like, k):
                    number = int(own["anchor"].iloc[row])
                    out += [(number, keys[i], int(scores[row, i])) for i in at]
        return pd.DataFrame(out, columns=["anchor", "positive_id", "positive_score"])

    return run


def _share(score: np.ndarray, hundredths: int, up: bool) -> np.ndarray:
    """``hundredths`` per cent of integers, rounded up or down, without leaving int64."""
    sign = -1 if up else 1
    score = sign * score
    return sign * (score // 100 * hundredths + score % 100 * hundredths // 100)


def _negatives(moduli: list[int], k: int, low: int, high: int):
    def run(anchors: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(anchors) and len(vectors):
            vectors = vectors.sort_values("key", kind="stable")
            keys, labels = vectors["key"].to_numpy(), vectors["label"].to_numpy()
            for own, scores in _sliced(anchors, vectors, moduli):
                other = labels != own["label"].to_numpy()[:, None]
                held = [np.asarray(x, np.int64) for x in own["positives"]]
                for place in range(max(map(len, held))):
                    rows = np.array([i for i, x in enumerate(held) if len(x) > place])
                    base = np.array([held[i][place] for i in rows])
                    least, most = _share(base, low, True)[:, None], _share(base, high, False)[:, None]
                    part = scores[rows]
                    for row, at in _best(part, other[rows] & (part >= least) & (part <= most), k):
                        number = int(own["anchor"].iloc[rows[row]])
                        out += [(number, place, keys[i], int(part[row, i])) for i in at]
        return pd.DataFrame(out, columns=["anchor", "place", "negative_id", "negative_score"])

    return run


def _met(anchors: DataFrame, vectors: DataFrame, blocks: int, slots: int, fn, schema: str) -> DataFrame:
    """Every block of anchors with every slot of vectors of the same length, each pair in a task of its own and of bounded size."""

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = anchors.withColumn("block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int")).withColumn("slot", numbers(slots))
    right = vectors.withColumn("block", numbers(blocks))
    cell = ["dim", "block", "slot"]
    return left.groupBy(cell).cogroup(right.groupBy(cell)).applyInPandas(fn, schema)


def hard_negatives(rows: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows for which ``anchor`` holds.

    A component ``x`` becomes the integer ``floor(scale * x)``; a score is the inner product of two such vectors, exact to the last
    digit: the primes' number follows from the largest component and the longest vector of the whole table. Positives are an anchor's
    ``positives`` highest other rows of its label, negatives of a positive the ``negatives`` highest rows of other labels whose score
    is from ``low`` to ``high`` hundredths of the positive's. Higher scores come first, equal ones by smaller key. Anchors are a
    stated query set: each block of them meets each slot of vectors, once for the positives and once, with these known, for the
    negatives; of either only the best few per anchor leave a task.

    Rows with a null key, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths don't
    meet; empty ones have score 0. An other row is one with another key; rows that repeat a key are candidates one by one, while
    anchors that agree in key, label and vector count once. Anchors without a positive and positives without a negative give no
    rows, and neither does an empty table. Scores that no int64 holds raise an error. Other columns are ignored.
    """
    vec = F.col(vector).cast("array<double>")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(F.col(key).alias("key"), F.col(label).alias("label"), vec.alias("vec"), F.coalesce(anchor, F.lit(False)).alias("asks")).where("key IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL").where(finite)
    widest, dim, count, asking = plain.agg(F.max(F.array_max(F.transform("vec", F.abs))), F.max(F.size("vec")), F.count("*"), F.count_if("asks")).first()
    largest = math.ceil((widest or 0) * scale) + 1
    bound = largest * largest * max(1, dim or 0)
    if bound >= 1 << 63:
        raise ValueError("scores of such large components don't fit into 64 bits")
    moduli = primes(bound)
    slots, blocks = max(1, math.ceil(count / SLOT_VECTORS)), max(1, math.ceil(asking / BLOCK_ANCHORS))
    kind = f"array<{'int' if largest < 1 << 31 else 'bigint'}>"
    ints = plain.select("key", "label", "asks", F.size("vec").alias("dim"), F.transform("vec", lambda x: F.floor(x * scale)).cast(kind).alias("ints"))
    whole = stored(ints.withColumn("slot", F.pmod(F.xxhash64("key", "ints"), F.lit(slots)).cast("int")), "integers")
    anchors = stored(whole.where("asks").select("key", "label", "dim", "ints").distinct().withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    vectors = whole.select("dim", "slot", "key", "label", "ints")
    key_kind = rows.schema[key].dataType.simpleString()

    best = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id")
    found = _met(anchors, vectors, blocks, slots, _positives(moduli, positives), f"anchor long, positive_id {key_kind}, positive_score long")
    first = stored(found.withColumn("place", F.row_number().over(best) - 1).where(F.col("place") < positives), "positives")
    # At most ``positives`` per anchor.
    held = first.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "positive_score"))), lambda x: x.positive_score).alias("positives"))
    asked = stored(anchors.join(held, "anchor"), "asked")

    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id")
    met = _met(asked, vectors, blocks, slots, _negatives(moduli, negatives, low, high), f"anchor long, place int, negative_id {key_kind}, negative_score long")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    named = first.join(anchors.select("anchor", F.col("key").alias("anchor_id")), "anchor")
    result = stored(ranked.join(named, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    discard(whole, anchors, first, asked)
    return result
