"""Registered queries and their SQL."""

from __future__ import annotations


def all_queries():
    """({name: query}, {name: SQL}) of every module of this package."""
    from . import allocation, builds, chatdata, commits, decisions, dedup, metrics, more, records, registry, rendering, reports, retrieval, streams, text  # noqa: F401

    return registry.QUERIES, registry.ORACLES
