"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower

K = 128
SHINGLE_WORDS = 5
SPACE = " \t\n\u000b\f\r"
#: Ranges of keys that documents are dealt out by to find neighbours: one per so many documents, up to the limit.
RANGE_DOCS, MOST_RANGES = 2000, 4096


def with_sketch(rows: DataFrame, text: str, sketch: str, k: int = K) -> DataFrame:
    """Adds the sketch of ``text``: the ``k`` smallest distinct hashes of its five-word shingles, in order.

    Words are runs of anything but ASCII white space, A-Z in lower case; a text of fewer words is one shingle of all of them; a
    null or empty text has an empty sketch. A hash is the 64-bit XXH64 chained over the words.
    """
    trimmed = F.btrim(ascii_lower(F.coalesce(F.col(text), F.lit(""))), F.lit(SPACE))
    words = rows.withColumn("_words", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+")))
    at = F.sequence(F.lit(0), F.size("_words") - SHINGLE_WORDS)
    shingles = F.transform(at, lambda i: F.xxhash64(*(F.get("_words", i + n) for n in range(SHINGLE_WORDS))))
    hashes = F.when(F.size("_words") >= SHINGLE_WORDS, shingles).when(F.size("_words") > 0, F.array(F.xxhash64("_words"))).otherwise(F.array().cast("array<bigint>"))
    return words.withColumn(sketch, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).drop("_words")


def printed(sketch: str) -> Column:
    """A sketch as text, 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated share of common shingles among all shingles of two documents; 1 for two empty ones."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(sketch: str, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``, else from the place of the ``k``-th hash among all."""
    share = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; 1 where ``a`` has none."""
    r, na, nb = resemblance(a, b, k), distinct_shingles(a, k), distinct_shingles(b, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), r * (na + nb) / ((1 + r) * na)))


def merge_sketches(parts: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """``(key, sketch)``: the sketch of all parts of a key together, equal to that of their whole shingle set.

    Hashes are taken as rows and cut to ``k`` per key before and after the shuffle, so a key may have any number of parts.
    """
    hashes = parts.select(key, F.explode_outer(sketch).alias("_h")).distinct()
    first = hashes.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col("_h").asc_nulls_last()))).where(F.col("_n") <= k)
    return first.groupBy(key).agg(F.sort_array(F.collect_list("_h")).alias(sketch))


def with_next(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, text, sketch, next_text, next_sketch)``: every document with the next in descending order of keys, the first after the last.

    Null keys stand last, equal keys in order of their texts, null first. Documents are dealt out by ranges of keys, so texts
    travel once and no task holds the table; each range also gets the first row of the range that follows.
    """
    n = docs.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_DOCS))
    ends = docs.approxQuantile(key, [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)) if ranges > 1 else []
    place = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ends = sorted({int(x) for x in ends})
    at = F.size(F.filter(F.array(*map(F.lit, ends)), lambda end: end < place)) if ends else F.lit(0)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), place.alias("place"), at.alias("range"), F.lit(0).alias("guest"))
    tops = rows.groupBy("range").agg(F.max("place").alias("place")).orderBy("range").collect()
    hosts = [(tops[(i + 1) % len(tops)]["range"], top["range"], top["place"]) for i, top in enumerate(tops)]
    if not hosts:
        guests = rows
    else:
        wanted = docs.sparkSession.createDataFrame(hosts, "host int, range int, place long")
        heads = rows.join(F.broadcast(wanted), ["range", "place"]).groupBy("host").agg(F.min(F.struct(F.col("text").isNotNull().alias("full"), "text", "key", "place")).alias("head"))
        guests = heads.select("head.key", "head.text", "head.place", F.col("host").alias("range"), F.lit(1).alias("guest"))
    dealt = with_sketch(rows.unionByName(guests).repartition("range"), "text", "sketch")
    order = Window.partitionBy("range").orderBy("guest", F.col("place").desc(), F.col("key").isNull(), F.col("text").asc_nulls_first())
    led = dealt.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return led.where("guest = 0").select("key", "text", "sketch", "next_text", "next_sketch")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every document's text and of an edited text, and their likenesses.

    The edited text ends, for its last half of code points (rounded down), in as many first ones of the next document in
    descending order of keys. Null texts count as empty; rows that repeat a key are documents of their own; one row alone is its
    own next. Result: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shingles``.
    """
    rows = with_next(docs, key, text).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("n_chars", F.length("text").cast("long"))
    half = (F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    done = with_sketch(rows.withColumn("edited", edited), "edited", "edited_sketch")
    return done.select(
        F.col("key").alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed("sketch").alias("fingerprint"),
        printed("edited_sketch").alias("edited_fingerprint"),
        resemblance("sketch", "edited_sketch").alias("near_edited"),
        resemblance("sketch", "next_sketch").alias("near_next"),
        distinct_shingles("sketch").alias("shingles"),
    )
