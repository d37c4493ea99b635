"""Text functions as Spark Columns.

Character classes are spelled out because the JVM's ``\\s`` and ``\\w`` are ASCII-only by default while
the semantics asked for are Unicode ones.
"""

from __future__ import annotations

import html
import sys
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace that does not end a line, then whitespace that does.
INLINE_SPACE = "".join(map(chr, [0x09, 0x1F, 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]))
LINE_ENDS = "".join(map(chr, [0x0A, 0x0D, 0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]))
ALL_SPACE = INLINE_SPACE + LINE_ENDS

HS = "[" + INLINE_SPACE + "]"
WS = "[" + ALL_SPACE + "]"
WORD = r"\p{L}\p{N}_"
LINE_BREAK = "\r\n|[" + LINE_ENDS + "]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once so that lambdas in ``body`` do not evaluate it per element."""
    return F.transform(F.array(value), body)[0]


def long_fold(items: Column, start: dict[str, Column], out: str, step, finish=lambda s: s.out, group: int = 256) -> Column:
    """``aggregate`` over an array for a state with the fields of ``start`` and a growing array ``out`` (of the given type).

    Appending copies the array, so a plain fold is quadratic in its length. This one folds groups of items into arrays of their own
    and appends those, which copies ``group`` items per item and one reference per group.
    """
    groups = F.transform(
        F.sequence(F.lit(0), F.ceil(F.size(items) / group).cast("int") - 1), lambda g: F.slice(items, g * group + 1, F.lit(group))
    )
    nothing = F.array().cast(out)

    def carried(s: Column) -> list[Column]:
        return [s[name].alias(name) for name in start]

    def whole(s: Column, part: Column) -> Column:
        folded = F.aggregate(part, F.struct(*carried(s), nothing.alias("out")), step)
        return let(folded, lambda r: F.struct(*carried(r), F.concat(s["out"], F.array(r["out"])).alias("out")))

    first = F.struct(*[value.alias(name) for name, value in start.items()], F.array().cast(f"array<{out}>").alias("out"))
    parts = F.when(F.size(items) > 0, groups).otherwise(F.slice(groups, 1, 0))
    return let(F.aggregate(parts, first, whole), lambda s: let(F.struct(*carried(s), F.flatten(s["out"]).alias("out")), finish))


def explode_once(df: DataFrame, array: Column, *names: str, keep: list[str] = ()) -> DataFrame:
    """Rows of a computed array: ``(name)`` or, with two names, ``(position, name)``.

    A plain explode of a computed column makes Spark infer a filter on the array, which repeats the whole
    computation below it. The outer form does not, and its rows for empty arrays are dropped afterwards.
    """
    rows = F.explode_outer(array).alias(*names) if len(names) == 1 else F.posexplode_outer(array).alias(*names)
    return df.select(*keep, rows).filter(F.col(names[-1]).isNotNull())


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(ALL_SPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(ALL_SPACE))


def unify_newlines(c: Column) -> Column:
    """Every Unicode line end becomes ``\\n``."""
    return F.regexp_replace(c, LINE_BREAK, "\n")


def line_terminated(c: Column) -> Column:
    """Unified newlines, each line (also the last) closed by ``\\n``; empty text stays empty."""
    return let(
        unify_newlines(c),
        lambda t: F.when((t == "") | t.endswith("\n"), t).otherwise(F.concat(t, F.lit("\n"))),
    )


def lines(c: Column) -> Column:
    """Array of lines without their ends; a trailing newline opens no extra line."""
    return let(
        unify_newlines(c),
        lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(
            F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1)
        ),
    )


def dehyphenate(c: Column) -> Column:
    """Join words that a line break split after a hyphen."""
    return F.regexp_replace(c, "([A-Za-z])-\\r?\\n([a-z])", "$1$2")


def snippet(c: Column, n: int, ellipsis: str = "") -> Column:
    """Trimmed text without carriage returns, cut to ``n`` characters."""
    return let(
        F.regexp_replace(strip(c), "\r", ""),
        lambda t: F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(ellipsis))).otherwise(t),
    )


def truncate(c: Column, n: int = 20) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def chat_title(c: Column) -> Column:
    return F.substring(c, 1, 40)


def iso_z(ts: Column) -> Column:
    """ISO-8601 with a trailing Z; microseconds only when they are not zero."""
    micros = F.date_format(ts, "SSSSSS")
    base = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(base, F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def lex_tokens(c: Column) -> Column:
    """Lexical tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def count_tokens(c: Column) -> Column:
    """Budget tokens: word runs, and every other visible character on its own."""
    return F.regexp_count(c, F.lit(f"[{WORD}]+|[^{WORD}{ALL_SPACE}]")).cast("bigint")


def words(c: Column) -> Column:
    return F.filter(F.split(c, WS + "+"), lambda w: w != "")


# --- Unicode normal forms -------------------------------------------------------------------------


@F.pandas_udf(T.StringType())
def _nfkc_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _fold_batch(s: pd.Series) -> pd.Series:
    def fold(t):
        return "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))

    return s.map(lambda t: None if t is None else fold(t))


@F.pandas_udf(T.StringType())
def _unescape_batch(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else html.unescape(t))


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Spark has no such function; ASCII rows never leave the JVM (the worker gets nulls)."""
    return F.coalesce(_nfkc_batch(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def _fold_tables() -> tuple[str, str, str, str]:
    """Derive (from, to, still-complex class, cheap superset of that class) for NFKD without combining marks.

    One-to-one results and deletions go to ``translate``; characters that unfold to several (ligatures,
    Hangul, ...) form a regex class, and only rows holding one of them need Python.
    """
    src, dst, drop, complex_cp = [], [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            drop.append(ch)
            continue
        flat = unicodedata.normalize("NFKD", ch)
        if flat == ch:
            continue
        flat = "".join(x for x in flat if not unicodedata.combining(x))
        if len(flat) == 1 and cp < 0x10000 and ord(flat) < 0x10000:
            src.append(ch)
            dst.append(flat)
        else:
            complex_cp.append(cp)
    ranges, start = [], None
    for i, cp in enumerate(complex_cp):
        if start is None:
            start = cp
        if i + 1 == len(complex_cp) or complex_cp[i + 1] != cp + 1:
            ranges.append(f"\\x{{{start:x}}}-\\x{{{cp:x}}}")
            start = None
    # Matching against hundreds of ranges is slow, so a short class decides first for most rows.
    near = "".join(f"\\x{{{cp:x}}}" for cp in complex_cp if cp < 0x250)
    return "".join(src) + "".join(drop), "".join(dst), "[" + "".join(ranges) + "]", f"[{near}\\x{{250}}-\\x{{10ffff}}]"


_FOLD_FROM, _FOLD_TO, _FOLD_COMPLEX, _FOLD_SUSPECT = _fold_tables()


def fold_accents(c: Column) -> Column:
    """NFKD with combining marks removed."""
    plain = F.translate(c, _FOLD_FROM, _FOLD_TO)
    suspects = F.regexp_replace(c, "[^" + _FOLD_SUSPECT[1:-1] + "]+", "")
    return F.coalesce(_fold_batch(F.when(suspects.rlike(_FOLD_COMPLEX), c)), plain)


def alias_normalize(c: Column) -> Column:
    """Lookup form of a name: lower case, no accents, punctuation to spaces, single spaces."""
    folded = fold_accents(F.lower(strip(F.coalesce(c, F.lit("")))))
    spaced = F.regexp_replace(folded, f"[^{WORD}{ALL_SPACE}-]", " ")
    return strip(F.regexp_replace(spaced, WS + "+", " "))


def html_unescape(c: Column) -> Column:
    """Decode HTML entities. Rows with only the common ones stay in the JVM."""
    # Entity and replacement; the ampersand is decoded last.
    common = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&")]
    decoded = c
    for entity, char in common:
        decoded = F.replace(decoded, F.lit(entity), F.lit(char))
    rare = F.regexp_replace(c, "&(?:lt|gt|quot|#39|apos|nbsp|amp);", "").rlike("&[#A-Za-z]")
    return F.coalesce(_unescape_batch(F.when(rare, c)), decoded)


# --- small list and label helpers -----------------------------------------------------------------


def oxford_join(items: Column) -> Column:
    """``a``, ``a or b``, ``a, b, or c``; empty items are dropped."""
    return let(
        F.filter(items, lambda s: s.isNotNull() & (s != "")),
        lambda a: F.when(F.size(a) == 0, F.lit(""))
        .when(F.size(a) == 1, F.try_element_at(a, F.lit(1)))
        .when(F.size(a) == 2, F.array_join(a, " or "))
        .otherwise(
            F.concat(
                F.array_join(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), ", "),
                F.lit(", or "),
                F.try_element_at(a, F.lit(-1)),
            )
        ),
    )


# Labels (and label beginnings) that carry no information.
GENERIC_ANSWERS = ["other", "none", "none of these", "n/a", "not applicable", "not sure"]


def is_generic_answer(label: Column) -> Column:
    generic = F.array(*[F.lit(g) for g in GENERIC_ANSWERS])
    return let(F.lower(strip(F.coalesce(label, F.lit("")))), lambda s: F.exists(generic, lambda g: s.startswith(g)))
