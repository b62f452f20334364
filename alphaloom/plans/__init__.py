"""Registered queries over the tables, by topic."""

from __future__ import annotations

from .registry import QUERIES, Query


def registered() -> dict[str, Query]:
    """All queries, by name."""
    from . import adaptive, analysis, bitemporal, exposure, factor_run, factors, fundamental, modelling, monitoring, research, store, strategy, validation, versions, weighting  # noqa: F401

    return QUERIES
