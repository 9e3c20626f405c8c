"""Imports every query module so that all queries are registered."""

from __future__ import annotations

import importlib

from marquee.plans import registry

MODULES = ("catalog_queries", "ingest_queries", "recommend_queries", "feature_queries", "policy_queries", "stream_queries")


def load():
    for name in MODULES:
        importlib.import_module(f"marquee.plans.{name}")
    return registry.QUERIES
