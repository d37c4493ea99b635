"""Cleaning, normalisation and string functions; corpus profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import modeljson as J
from ..functions import text as X
from ..operators import cleaning, profile
from .fixtures import oracle, table, vault, view
from .registry import query

SP = "' ' || chr(9) || chr(10) || chr(13)"


@query("SELECT doc_id, concat(nfc_normalize(text), ' file 12 1/2 km') AS text FROM documents".replace("1/2", "1\u20442"))
def nfkc(spark, sf):
    """Compatibility characters are added to every document, since none has any."""
    mixed = F.concat("text", F.lit(" \ufb01le \u2460\u2461 \u00bd \u339e"))
    return table(spark, sf, "documents").select("doc_id", X.nfkc(mixed).alias("text"))


@query(oracle("v_text", "SELECT doc_id, regexp_replace(text, '([A-Za-z])-\\r?\\n([a-z])', '\\1\\2', 'g') AS text FROM v_text"))
def dehyphenate(spark, sf):
    return view(spark, sf, "v_text").select("doc_id", X.dehyphenate(F.col("text")).alias("text"))


def line_ctes(src: str, name: str) -> str:
    """CTE with one row per line of ``src``."""
    return f"""{name} AS (SELECT doc_id, pos, a[pos] AS ln FROM (SELECT doc_id, CASE WHEN text = '' THEN []::VARCHAR[] ELSE str_split(regexp_replace(text, '\\n$', ''), chr(10)) END AS a FROM {src}), unnest(range(1, len(a) + 1)) t(pos))"""


REPEATED = f"""{line_ctes('v_text', 'rl')},
bad AS (SELECT doc_id, trim(ln, {SP}) AS k FROM rl WHERE length(trim(ln, {SP})) BETWEEN 1 AND 80 GROUP BY ALL HAVING count(*) >= 5),
kept AS (SELECT doc_id, string_agg(ln, chr(10) ORDER BY pos) AS text FROM rl WHERE (doc_id, trim(ln, {SP})) NOT IN (SELECT doc_id, k FROM bad) GROUP BY doc_id),
dedup AS (SELECT v.doc_id, CASE WHEN EXISTS (SELECT 1 FROM bad b WHERE b.doc_id = v.doc_id) THEN coalesce(k.text, '') ELSE v.text END AS text FROM v_text v LEFT JOIN kept k ON k.doc_id = v.doc_id)"""


@query(oracle("v_text", "SELECT doc_id, text FROM dedup", REPEATED))
def drop_repeated_lines(spark, sf):
    return view(spark, sf, "v_text").select("doc_id", cleaning.drop_repeated_lines(F.col("text")).alias("text"))


_RULES = cleaning.CleaningRules(["^page \\d", "(broken"], [("", "x"), ("([Bb])atch (\\d+)", "\\1atch #\\2")])


@query(
    oracle(
        "v_text",
        "SELECT v.doc_id, regexp_replace(coalesce(k.text, ''), '([Bb])atch (\\d+)', '\\1atch #\\2', 'g') AS text FROM v_text v LEFT JOIN (SELECT doc_id, string_agg(ln, chr(10) ORDER BY pos) AS text FROM ul WHERE NOT regexp_matches(ln, '^page \\d') GROUP BY doc_id) k ON k.doc_id = v.doc_id",
        line_ctes("v_text", "ul"),
    )
)
def apply_rules(spark, sf):
    return view(spark, sf, "v_text").select("doc_id", cleaning.apply_rules(F.col("text"), _RULES).alias("text"))


_LETTERS = "[^\\p{L}\\p{N}_\\s-]"


def norm(e: str) -> str:
    """DuckDB form of the alias normalisation."""
    return f"trim(regexp_replace(regexp_replace(strip_accents(lower(trim(coalesce({e}, ''), {SP}))), '{_LETTERS}', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(oracle("v_ask", f"SELECT chat_id, turn, {norm('text')} AS norm FROM v_ask UNION ALL SELECT doc_id, -1, {norm('text')} FROM documents"))
def alias_normalize(spark, sf):
    asked = view(spark, sf, "v_ask").select("chat_id", "turn", X.alias_normalize(F.col("text")).alias("norm"))
    docs = table(spark, sf, "documents").select("doc_id", F.lit(-1).cast("bigint"), X.alias_normalize(F.col("text")))
    return asked.union(docs)


@query("SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS BIGINT) AS n_tokens, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS digest FROM documents")
def lex_tokens(spark, sf):
    toks = table(spark, sf, "documents").select("doc_id", X.lex_tokens(F.col("text")).alias("t"))
    return toks.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


def ntok(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS BIGINT)"


@query(f"SELECT doc_id, {ntok('text')} AS n_tokens FROM documents")
def count_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.count_tokens(F.col("text")).alias("n_tokens"))


@query(oracle("v_text", "SELECT doc_id, replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') || ' é€©' AS text FROM v_text"))
def html_unescape(spark, sf):
    """Every text ends in rarer entities, so both paths of the function are used."""
    text = F.concat("text", F.lit(" &eacute;&#8364;&copy;"))
    return view(spark, sf, "v_text").select("doc_id", X.html_unescape(text).alias("text"))


@query(f"SELECT doc_id, t400 AS rerank_snippet, CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || ' …' ELSE t END AS shown FROM (SELECT doc_id, t, substr(t, 1, 400) AS t400 FROM (SELECT doc_id, replace(trim(text, {SP}), chr(13), '') AS t FROM documents))")
def snippet(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.snippet(F.col("text"), 400).alias("rerank_snippet"), X.snippet(F.col("text"), 600, " …").alias("shown")
    )


_BLOB = "regexp_extract(trim(raw), '\\{.*\\}', 0, 's')"


@query(oracle("v_json", f"SELECT event_id, CASE WHEN {_BLOB} <> '' AND json_valid({_BLOB}) THEN {_BLOB} ELSE '{{}}' END AS json FROM v_json"))
def extract_json_object(spark, sf):
    return view(spark, sf, "v_json").select("event_id", J.extract_json_object(F.col("raw")).alias("json"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || 'Z' AS at FROM events")
def iso_z(spark, sf):
    return table(spark, sf, "events").select("event_id", X.iso_z(F.col("ts")).alias("at"))


@query("SELECT conv_id, turn, substr(text, 1, 40) AS title, CASE WHEN length(text) > 20 THEN substr(text, 1, 19) || '…' ELSE text END AS short FROM conversations")
def chat_title(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", X.chat_title(F.col("text")).alias("title"), X.truncate(F.col("text"), 20).alias("short")
    )


@query(
    oracle(
        "v_vault",
        "SELECT insight_id, CASE len(a) WHEN 0 THEN '' WHEN 1 THEN a[1] WHEN 2 THEN a[1] || ' or ' || a[2] ELSE array_to_string(a[1:len(a) - 1], ', ') || ', or ' || a[len(a)] END AS phrase FROM (SELECT insight_id, list(label ORDER BY answer_id)[1:any_value(pos) % 5] AS a FROM v_vault GROUP BY insight_id)",
    )
)
def oxford_join(spark, sf):
    """Lists of none to four labels."""
    labels = F.array_sort(F.collect_list(F.struct("answer_id", "label"))).label
    lists = vault(spark, sf).groupBy("insight_id", "pos").agg(labels.alias("a"))
    return lists.select("insight_id", X.oxford_join(F.slice("a", F.lit(1), (F.col("pos") % 5).cast("int"))).alias("phrase"))


@query(
    oracle(
        "v_vault",
        "SELECT insight_id, answer_id, lower(label) IN ('other', 'none', 'none of these', 'n/a', 'not applicable', 'not sure') OR regexp_matches(lower(label), '^(other|none|n/a|not applicable|not sure)') AS generic FROM v_vault",
    )
)
def is_generic_answer(spark, sf):
    return vault(spark, sf).select("insight_id", "answer_id", X.is_generic_answer(F.col("label")).alias("generic"))


# --- profiling ------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{a}'" for a in dict.fromkeys(profile.STOP_ACRONYMS))
_ACR = f"ac AS (SELECT doc_id, length(text) AS n, unnest(list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,6}}') AND x NOT IN ({_STOP}))) AS acronym FROM v_text)"


@query(oracle("v_text", "SELECT acronym, count(*) AS n FROM ac GROUP BY acronym ORDER BY n DESC, acronym LIMIT 50", _ACR))
def acronyms_global(spark, sf):
    return profile.acronyms_global(view(spark, sf, "v_text"))


@query(
    oracle(
        "v_text",
        "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, acronym) AS rank FROM (SELECT v_text.doc_id, length(text) AS chars_scanned, acronym, count(acronym) AS n FROM v_text LEFT JOIN ac ON ac.doc_id = v_text.doc_id GROUP BY ALL) QUALIFY rank <= 20",
        _ACR,
    )
)
def acronyms_per_doc(spark, sf):
    return profile.acronyms_per_doc(view(spark, sf, "v_text"))


_BATCH = "bm AS (SELECT doc_id, list_sort(list_distinct(list_transform(regexp_extract_all(text, '(?i)\\bbatch\\s*(\\d+)\\b', 1), lambda x: CAST(x AS BIGINT)))) AS b FROM v_text)"


@query(oracle("v_text", "SELECT doc_id, array_to_string(b, ',') AS found_batches FROM bm", _BATCH))
def batch_mentions(spark, sf):
    found = profile.batch_mentions(view(spark, sf, "v_text"))
    return found.select("doc_id", F.array_join(F.col("found_batches").cast("array<string>"), ",").alias("found_batches"))


@query(oracle("v_text", "SELECT min(x) AS min_batch, max(x) AS max_batch, '(?i)\\bBatch\\s*(\\d+)\\b' AS pattern FROM (SELECT unnest(b) AS x FROM bm)", _BATCH))
def batch_range(spark, sf):
    return profile.batch_range(view(spark, sf, "v_text"))
