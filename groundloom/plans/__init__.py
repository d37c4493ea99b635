"""Registered queries over the given tables, each with the DuckDB SQL that checks it."""

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = ("source_queries", "text_queries", "block_queries", "retrieval_queries", "answer_queries", "intake_queries", "insight_queries", "question_queries", "chat_queries", "stream_queries")


def load():
    """All registered queries and their check SQL."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return QUERIES, ORACLES
