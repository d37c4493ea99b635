"""Web pages to markdown text, as one chain of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_unescape

# Fixed rules, applied in order: pattern and replacement (RE2-compatible on purpose).
_DROP = [
    (r"(?is)<script\b[^>]*>.*?</script>", ""),
    (r"(?is)<style\b[^>]*>.*?</style>", ""),
    (r"(?s)<!--.*?-->", ""),
    (r"(?is)<nav\b[^>]*>.*?</nav>", ""),
    (r"(?is)<footer\b[^>]*>.*?</footer>", ""),
    (r"(?is)<head\b[^>]*>.*?</head>", ""),
]
_MARK = [(rf"(?i)<h{n}\b[^>]*>", "\n" + "#" * n + " ") for n in range(1, 7)] + [
    (r"(?i)</h[1-6]>", "\n"),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)<br\s*/?>", "\n"),
    (r"(?i)</?p\b[^>]*>", "\n"),
    (r"(?s)<[^>]*>", ""),
]
_TIDY = [(r"[ \t]*\n[ \t]*", "\n"), (r"\n\n\n+", "\n\n"), (r"\A\n+|\n+\z", "")]


def html_to_markdown(c: Column) -> Column:
    """Headings, list items and paragraphs of a page; scripts, styles, navigation and comments are dropped."""
    for pattern, replacement in _DROP + _MARK:
        c = F.regexp_replace(c, pattern, replacement)
    c = html_unescape(c)
    for pattern, replacement in _TIDY:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def pages_to_markdown(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", html_to_markdown(F.col("html")).alias("text"))
