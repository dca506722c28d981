"""Registered queries, composed of the operators."""

from . import answering, answers, graphs, parsing, retrieval, runs, streams, texts  # noqa: F401  they register their queries
