"""Quality by perplexity: an interpolated modified Kneser-Ney model of characters, trained on trusted text per language."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructType

from .common import discard, stored

ORDER = 5
#: Entries of the model that one pass over the documents holds; a larger model is scored in more passes.
PASS_ENTRIES = 6_000_000
#: One in so many trusted documents, by a hash of its key, is held out of training and sets thresholds.
HELD_OUT = 5
#: A language's threshold: this quantile of the perplexities of its held-out trusted documents, times a margin.
QUANTILE, MARGIN = 0.95, 1.25
#: Characters that a task counts or scores at once.
STEP_CHARS = 1 << 21
START = "\x02"
_RNG = np.random.Generator(np.random.PCG64(11))
_PLACE = _RNG.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)


def _keys(codes: np.ndarray, order: int, last: np.ndarray, kind: int = 0) -> np.ndarray:
    """Hashes of the ``order`` characters that end at each place of ``last``; ``kind`` 1 for contexts."""
    total = np.full(len(last), int(_PLACE[10 + order]) * (2 * order + kind + 1) % (1 << 64), np.uint64)
    for k in range(order):
        total += codes[last - k] * _PLACE[k]
    return _spread(total)


#: The key of the probability of a character that was never seen.
_NO_GRAM = _spread(np.array([_PLACE[10]], np.uint64))


def _laid_out(texts: list[str]) -> tuple[str, np.ndarray]:
    """Texts one after the other, each after a run of start marks, and the number of the text that each character belongs to (-1: mark)."""
    mark = START * (ORDER - 1)
    sizes = np.array([len(t) for t in texts])
    owner = np.full(int(sizes.sum()) + len(texts) * len(mark), -1, np.int64)
    begin = np.cumsum(sizes + len(mark)) - sizes
    inside = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    owner[inside] = np.repeat(np.arange(len(texts)), sizes)
    return "".join(mark + t for t in texts), owner


def _steps(batch, lang: str = "_lang", text: str = "_text"):
    """Row numbers and texts of a batch by language, as many as make about ``STEP_CHARS`` characters; null texts are empty."""
    by: dict[str, list] = {}
    for row, (name, words) in enumerate(zip(batch.column(lang).to_pylist(), batch.column(text).to_pylist(), strict=True)):
        name = name or ""
        rows, texts, size = by.setdefault(name, [[], [], 0])
        rows.append(row)
        texts.append(words or "")
        by[name][2] = size + len(texts[-1]) + ORDER
        if by[name][2] >= STEP_CHARS:
            yield name, rows, texts
            del by[name]
    for name, (rows, texts, _) in by.items():
        yield name, rows, texts


def _counted(batches):
    for batch in batches:
        for lang, _, texts in _steps(batch):
            line, owner = _laid_out(texts)
            last = np.flatnonzero(owner >= 0)
            if not len(last):
                continue
            _, first, counts = np.unique(_keys(_codes(line), ORDER, last), return_index=True, return_counts=True)
            grams = [line[i - ORDER + 1 : i + 1] for i in last[first].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams)), pa.array(grams), pa.array(counts)], names=["lang", "gram", "c"])


def _discounts(grams: DataFrame) -> DataFrame:
    """``(lang, d1, d2, d3)``: the discounts of counts 1, 2, and 3 and more, from the numbers of n-grams counted 1 to 4 times."""
    ones = grams.groupBy("lang").agg(*(F.sum((F.col("c") == k).cast("long")).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)))
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))

    def one(k: int) -> Column:
        exact = k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}")
        return F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (exact > 0), F.least(exact, F.lit(float(k)))).otherwise(0.5).alias(f"d{k}")

    return ones.select("lang", *map(one, (1, 2, 3)))


def train(counts: DataFrame) -> DataFrame:
    """Model rows ``(lang, gram, kind, value)`` from ``(lang, gram, c)``, the counts of n-grams of ``ORDER`` characters.

    Kind 0: natural logarithm of the probability of a seen n-gram's last character given the others; kind 1: that of the weight
    by which the shorter context's probability counts after a context. The highest order has its counts, lower orders the numbers
    of distinct characters before them; all are discounted by the three modified Kneser-Ney discounts of their language and order
    and interpolated with the next lower order, the lowest with an equal share for each character seen and one unseen. Each order
    is a join of counts with the totals of their contexts and with the lower order's probabilities, all keyed by n-gram.
    """
    tables, scratch = {ORDER: counts}, []
    for n in range(ORDER - 1, 0, -1):
        tables[n] = stored(tables[n + 1].groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("c")), f"grams-{n}")
        scratch.append(tables[n])
    model = lower = None
    for n in range(1, ORDER + 1):
        grams = tables[n].withColumn("context", F.substring("gram", 1, n - 1))
        discounts = stored(_discounts(grams), "discounts")
        many = [F.sum((F.col("c") == k).cast("long") if k < 3 else (F.col("c") >= 3).cast("long")).alias(f"m{k}") for k in (1, 2, 3)]
        contexts = grams.groupBy("lang", "context").agg(F.sum("c").alias("total"), F.count("*").alias("kinds"), *many).join(discounts, "lang")
        contexts = stored(contexts.withColumn("weight", F.expr("(d1 * m1 + d2 * m2 + d3 * m3) / total")), f"contexts-{n}")
        known = grams.join(contexts, ["lang", "context"]).withColumn("own", F.expr("(c - CASE c WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END) / total"))
        if lower is None:
            p = known.select("lang", "gram", (F.col("own") + F.col("weight") / (F.col("kinds") + 1)).alias("p"))
            unseen = contexts.select("lang", F.lit("").alias("gram"), F.lit(0).alias("kind"), F.log(F.col("weight") / (F.col("kinds") + 1)).alias("value"))
            model = unseen
        else:
            under = lower.withColumnRenamed("gram", "suffix").withColumnRenamed("p", "lower")
            p = known.withColumn("suffix", F.expr("substring(gram, 2)")).join(under, ["lang", "suffix"]).select("lang", "gram", (F.col("own") + F.col("weight") * F.col("lower")).alias("p"))
            model = model.unionByName(contexts.select("lang", F.col("context").alias("gram"), F.lit(1).alias("kind"), F.log("weight").alias("value")))
        lower = stored(p, f"probabilities-{n}")
        scratch += [discounts, contexts, lower]
        model = model.unionByName(lower.select("lang", "gram", F.lit(0).alias("kind"), F.log("p").alias("value")))
    model = stored(model, "model")
    discard(*scratch)
    return model


class Table:
    """Values by 64-bit key, in open addressing over two arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.mask = keys, values, np.uint64(len(keys) - 1)

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        size = 1 << max(4, (2 * len(keys)).bit_length())
        table = cls(np.zeros(size, np.uint64), np.zeros(size, np.float32))
        at, todo = keys & table.mask, np.arange(len(keys))
        while len(todo):
            free = table.keys[at[todo]] == 0
            slots, first = np.unique(at[todo][free], return_index=True)
            placed = todo[free][first]
            table.keys[slots], table.values[slots] = keys[placed], values[placed]
            todo = todo[table.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + np.uint64(1)) & table.mask
        return table

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether the key is there."""
        at = keys & self.mask
        held = self.keys[at]
        values, found = self.values[at], held == keys
        todo = np.flatnonzero(~found & (held != 0))
        while len(todo):
            at[todo] = (at[todo] + np.uint64(1)) & self.mask
            held = self.keys[at[todo]]
            hit = held == keys[todo]
            values[todo[hit]] = self.values[at[todo[hit]]]
            found[todo[hit]] = True
            todo = todo[~hit & (held != 0)]
        return values, found


class Scorer:
    """Sums of log probabilities of texts of one language by one part of its model."""

    def __init__(self, table: Table, part: int, parts: int):
        self.table, self.part, self.parts = table, part, parts
        values, found = self.table.find(_NO_GRAM)
        self.unseen = float(values[0]) if found[0] else math.log(1e-6)

    def score(self, texts: list[str]) -> np.ndarray:
        line, owner = _laid_out(texts)
        codes, last = _codes(line), np.flatnonzero(owner >= 0)
        if self.parts > 1:
            last = last[_shard(codes[last - 2], codes[last - 1], self.parts) == self.part]
        total = np.zeros(len(last))
        todo = np.arange(len(last))
        for n in range(ORDER, 0, -1):
            values, found = self.table.find(_keys(codes, n, last[todo]))
            total[todo[found]] += values[found]
            todo = todo[~found]
            if n > 1 and len(todo):
                values, found = self.table.find(_keys(codes, n - 1, last[todo] - 1, 1))
                total[todo[found]] += values[found]
        total[todo] += self.unseen
        return np.bincount(owner[last], total, len(texts))


def _shard(before: np.ndarray, last: np.ndarray, parts: int) -> np.ndarray:
    return (_spread(before * _PLACE[0] + last * _PLACE[1]) % np.uint64(parts)).astype(np.int64)


def _keyed(parts: int):
    """Model rows as ``(lang, key, value, part)``. All that is looked up for a character depends on the two before it, so a row goes
    by those two; rows that have fewer (n-grams of up to two characters, contexts of one) are in every part (null)."""

    def run(batches):
        for batch in batches:
            grams, kinds = batch.column("gram").to_pylist(), np.array(batch.column("kind"))
            sizes = np.array([len(g) for g in grams], np.int64)
            keys, part, wide = np.full(len(grams), _NO_GRAM[0]), np.zeros(len(grams), np.int64), sizes >= 3 - kinds
            for n in range(1, ORDER + 1):
                for kind in (0, 1):
                    rows = np.flatnonzero((sizes == n) & (kinds == kind))
                    if len(rows):
                        codes = _codes("".join([grams[i] for i in rows.tolist()]))
                        last = np.arange(len(rows)) * n + n - 1
                        keys[rows] = _keys(codes, n, last, kind)
                        if n >= 3 - kind:
                            part[rows] = _shard(codes[last - 2 + kind], codes[last - 1 + kind], parts)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(keys.view(np.int64)), pa.array(np.array(batch.column("value")).astype(np.float32)), pa.array(part, mask=~wide)], names=["lang", "key", "value", "part"])

    return run


def _scored(sent, part: int, parts: int, lang: str, text: str):
    def run(batches):
        scorers = {name: Scorer(Table(*arrays), part, parts) for name, arrays in sent.value.items()}
        for batch in batches:
            chars, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for name, rows, texts in _steps(batch, lang, text):
                chars[rows] = [len(t) for t in texts]
                score[rows] = scorers[name].score(texts) if name in scorers else np.nan
            score += np.array(batch.column("_score")) if part else 0.0
            columns = [c for c in batch.schema.names if c not in ("_chars", "_score")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(chars), pa.array(score)], names=[*columns, "_chars", "_score"])

    return run


def with_perplexity(docs: DataFrame, model: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """All rows with ``ppl``: the perplexity per character of the whole text by its language's model; null for texts without
    characters and languages without a model. A null language is a language of its own.

    The model is cut into parts of about ``PASS_ENTRIES`` entries; each pass sends one part of all languages to the tasks, after its
    rows were counted, and adds up the characters that the part decides. Rows are written between passes.
    """
    spark = docs.sparkSession
    entries = model.count()
    parts = max(1, math.ceil(entries / PASS_ENTRIES))
    keyed = stored(model.mapInArrow(_keyed(parts), "lang string, key long, value float, part long"), "model-keys")
    kinds = StructType([*docs.schema.fields]).add("_chars", LongType()).add("_score", DoubleType())
    rows = docs
    for part in range(parts):
        own = keyed.where(F.col("part").isNull() | (F.col("part") == part))
        if parts > 1 and own.count() > 4 * PASS_ENTRIES:
            raise ValueError("n-grams of up to two characters alone outgrow a pass: PASS_ENTRIES is too small")
        held = own.select("lang", "key", "value").toArrow().combine_chunks()
        langs = held.column("lang").combine_chunks().dictionary_encode()
        codes = np.array(langs.indices)
        keys, values = np.array(held.column("key")).view(np.uint64), np.array(held.column("value"))
        tables = {name: Table.of(keys[codes == i], values[codes == i]) for i, name in enumerate(langs.dictionary.to_pylist())}
        sent = spark.sparkContext.broadcast({name: (t.keys, t.values) for name, t in tables.items()})
        rows = rows.mapInArrow(_scored(sent, part, parts, lang, text), kinds)
        if part < parts - 1:
            rows = stored(rows, "scored")
    discard(keyed)
    ppl = F.when((F.col("_chars") > 0) & ~F.isnan("_score"), F.exp(-F.col("_score") / F.col("_chars")))
    return rows.withColumn("ppl", ppl).drop("_chars", "_score")


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", lang: str = "lang", text: str = "text", carry: bool = True) -> DataFrame:
    """All rows with ``ppl``, ``threshold`` and ``keep`` (without ``text`` where ``carry`` is false).

    Trusted documents are those labelled of quality 1 and not toxic. One in ``HELD_OUT`` of them sets thresholds, as perplexities
    of text that a model has seen are too low to compare with; the model is trained on the whole text of all the others. Every
    document is scored by its language's model. A language's threshold is the ``QUANTILE`` quantile of the perplexities of its
    held-out documents times ``MARGIN``; documents above it are rejected, and so are documents without text. Where a language has
    no held-out document, there is no evidence against its documents and they are kept. Labels may be null or repeat; rows that
    repeat a key are judged one by one; an empty table gives no rows. Columns of the input named like a result column are replaced;
    any other name may occur.
    """
    names = [c for c in docs.columns if c not in ("ppl", "threshold", "keep") and (carry or c != text)]
    others = [c for c in names if c not in (key, lang, text)]
    own = [F.col(key).alias("key"), F.col(lang).alias("lang"), F.col(text).alias("text")]
    # Other columns travel in one of their own, so none of them clashes with those made here.
    rest = [F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest")] if others else []
    rows = docs.select(*own, (F.coalesce(F.octet_length(text), F.lit(0)) > 0).alias("some"), *rest)
    trusted = labels.where("quality = 1 AND coalesce(toxic, 0) = 0").select(F.col("doc_id").alias("key")).distinct()
    held_out = F.pmod(F.xxhash64("key"), F.lit(HELD_OUT)) == 0
    # Without the hint small label tables would be broadcast and larger ones sorted with the texts.
    sample = rows.join(trusted.where(~held_out).hint("shuffle_hash"), "key", "left_semi").select(F.coalesce("lang", F.lit("")).alias("_lang"), F.col("text").alias("_text"))
    counts = stored(sample.mapInArrow(_counted, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c")), f"grams-{ORDER}")
    model = train(counts)
    scored = with_perplexity(rows, model)
    scored = stored(scored if carry else scored.drop("text"), "scored")
    discard(counts, model)
    name = F.coalesce("lang", F.lit("")).alias("name")
    limits = scored.select("key", name, "ppl").join(trusted.where(held_out), "key", "left_semi").groupBy("name").agg((F.percentile_approx("ppl", QUANTILE, 10_000) * MARGIN).alias("threshold"))
    judged = scored.withColumn("name", name).join(stored(limits, "limits"), "name", "left")
    keep = F.col("some") & F.coalesce(F.col("ppl") <= F.col("threshold"), F.lit(True))
    place = {key: F.col("key"), lang: F.col("lang"), text: F.col("text")}
    return judged.select(*(place[c].alias(c) if c in place else F.col(f"rest.`{c}`").alias(c) for c in names), "ppl", "threshold", keep.alias("keep"))
