import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from groundloom.functions import modeljson as J
from groundloom.functions import text as X
from groundloom.operators import answering as A
from groundloom.operators import cleaning


def column(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


SAMPLES = ["Café", "ﬁle ½ ①", "한국어", "Ǆ ĳ", "plain", "áb", "…—€", "İstanbul", "x⃒y", ""]


def test_nfkc(spark):
    assert column(spark, SAMPLES, X.nfkc) == [unicodedata.normalize("NFKC", s) for s in SAMPLES]


def fold(s):
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def test_fold_accents(spark):
    assert column(spark, SAMPLES, X.fold_accents) == [fold(s) for s in SAMPLES]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"], exclude_characters="\x00")), min_size=20, max_size=60))
def test_fold_accents_on_any_text(spark, values):
    assert column(spark, values, X.fold_accents) == [fold(s) for s in values]


def test_lines_follow_all_line_ends(spark):
    got = column(spark, ["a\r\nb\rc d\x0ce", "a\n", "\n", "", "a\n\n"], X.lines)
    assert got == [list("abcde"), ["a"], [""], [], ["a", ""]]


def test_html_unescape(spark):
    values = ["a &amp;lt; b", "&eacute; &amp", "none", "&#39;&quot;"]
    assert column(spark, values, X.html_unescape) == ["a &lt; b", "é &", "none", "'\""]


def test_extract_json_object(spark):
    values = ['{"a": 1}', 'so {"a": {"b": 2}} ok', "{bad", None, "} {", '{"a": 1} {']
    assert column(spark, values, J.extract_json_object) == ['{"a": 1}', '{"a": {"b": 2}}', "{}", "{}", "{}", '{"a": 1}']


def test_oxford_join(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "", "b"],), (["a", "b", "c"],)], "a array<string>")
    assert [r[0] for r in df.select(X.oxford_join(F.col("a"))).collect()] == ["", "a", "a or b", "a, b, or c"]


def test_drop_repeated_lines(spark):
    five = "\n".join(["head", " x "] * 5)
    assert column(spark, [five, "x\n" * 4, "y" * 81 + "\n" + "z"], cleaning.drop_repeated_lines) == ["", "x\n" * 4, "y" * 81 + "\nz"]


def test_merge_soft_wraps(spark):
    text = "one \n  two\n\n```\na\nb\n```\n# h\n- i\nthree"
    assert column(spark, [text], cleaning.merge_soft_wraps) == ["one  two\n\n```\na\nb\n```\n# h\n- i\nthree"]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        cleaning.clean_text(F.lit("x"), "thorough")


def test_sufficiency(spark):
    replies = ['{"sufficiency": 1.4}', '{"sufficiency": "0.3"}', "{}", "no", '{"sufficiency": -1}']
    assert column(spark, replies, lambda c: F.round(A.sufficiency(c, F.lit(3)), 6)) == [1.0, 0.3, 0.5, 0.55, 0.0]


def test_compose_question_cuts_long_context(spark):
    got = column(spark, ["p" * 600, "", None], lambda c: A.compose_question(F.lit("q"), c, F.lit(True)))
    assert got[0].endswith("p" * 500 + "...") and got[1:] == ["q", "q"]
