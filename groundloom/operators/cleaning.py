"""Document cleaning: repeated lines, soft wraps, user rules and the three modes."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dehyphenate, let, lines, nfkc, strip
from .blocks import line_runs, run_kind


@dataclass(frozen=True)
class CleaningRules:
    """Ordered user rules: drop lines matching a pattern, then replace patterns."""

    remove_lines_matching: list[str] = field(default_factory=list)
    replace: list[tuple[str, str]] = field(default_factory=list)


def drop_repeated_lines(text: Column, min_occ: int = 5, max_len: int = 80) -> Column:
    """Remove short lines that occur ``min_occ`` times or more within the document.

    After sorting, a line occurs that often exactly when it equals the line ``min_occ - 1`` places on,
    which keeps the whole step inside the row.
    """

    def without(original: Column, ls: Column) -> Column:
        def repeated(s: Column) -> Column:
            return F.array_distinct(F.filter(s, lambda k, i: F.get(s, i + (min_occ - 1)) == k))

        keys = F.filter(F.transform(ls, strip), lambda k: (k != "") & (F.length(k) <= max_len))
        return let(
            let(F.array_sort(keys), repeated),
            lambda drop: F.when(F.size(drop) == 0, original).otherwise(
                F.array_join(F.filter(ls, lambda ln: ~F.array_contains(drop, strip(ln))), "\n")
            ),
        )

    return let(text, lambda t: let(lines(t), lambda ls: without(t, ls)))


def merge_soft_wraps(text: Column) -> Column:
    """Join the lines of each paragraph by single spaces; all other lines pass through."""

    def join_run(run: Column) -> Column:
        body = F.substring(run, F.lit(1), F.length(run) - 1)
        kind = run_kind(run)
        merged = F.array_join(
            F.transform(F.split(body, "\n", -1), lambda ln, i: F.when(i == 0, ln).otherwise(strip(ln))), " "
        )
        return F.when(kind == "paragraph", merged).when(kind == "blank", F.lit("")).otherwise(body)

    return F.array_join(F.transform(line_runs(text), join_run), "\n")


def _jvm_pattern(pattern: str) -> str | None:
    """The pattern in the JVM's dialect; None where it is invalid in either."""
    try:
        re.compile(pattern)
        jvm = re.sub(r"\(\?P<([A-Za-z][A-Za-z0-9]*)>", r"(?<\1>", pattern)
        jvm = re.sub(r"\(\?P=([A-Za-z][A-Za-z0-9]*)\)", r"\\k<\1>", jvm)
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(jvm)
    except (re.error, Py4JJavaError):
        return None
    return jvm


def _jvm_replacement(pattern: str, replacement: str) -> str | None:
    """The replacement in the JVM's dialect: ``\\1`` and ``\\g<name>`` are groups, everything else stands for itself."""
    groups = re.compile(pattern)

    def part(m: re.Match) -> str:
        group = m["number"] or m["name"]
        if group is None:
            return "\\" + m[0]
        known = int(group) <= groups.groups if group.isdigit() else group in groups.groupindex
        if not known:
            raise LookupError(group)
        return f"${{{group}}}" if not group.isdigit() else f"${int(group)}"

    try:
        return re.sub(r"\\(?:(?P<number>[1-9])|g<(?P<name>\w+)>)|[$\\]", part, replacement)
    except LookupError:
        return None


def _lacks(pattern: str):
    return lambda line: ~line.rlike(pattern)


def apply_rules(text: Column, rules: CleaningRules) -> Column:
    """Apply user rules in order. Skipped are patterns that are invalid (in Python or in the JVM), empty ones to replace, and
    replacements that name a group which the pattern doesn't have."""
    for pattern in rules.remove_lines_matching:
        if (jvm := _jvm_pattern(pattern)) is not None:
            text = F.array_join(F.filter(lines(text), _lacks(jvm)), "\n")
    for pattern, replacement in rules.replace:
        jvm = _jvm_pattern(pattern) if pattern else None
        if jvm is not None and (into := _jvm_replacement(pattern, replacement)) is not None:
            text = F.regexp_replace(text, jvm, into)
    return text


def clean_text(text: Column, mode: str = "lossless", rules: CleaningRules = CleaningRules()) -> Column:
    """``lossless`` keeps the text, ``safe`` normalises it, ``aggressive`` also drops and rewraps lines."""
    if mode == "lossless":
        return text
    text = dehyphenate(nfkc(text))
    if mode == "aggressive":
        text = apply_rules(merge_soft_wraps(drop_repeated_lines(text)), rules)
    elif mode != "safe":
        raise ValueError(f"unknown cleaning mode: {mode}")
    return text


def clean(docs: DataFrame, mode: str = "lossless", rules: CleaningRules = CleaningRules()) -> DataFrame:
    return docs.withColumn("text", clean_text(F.col("text"), mode, rules))
