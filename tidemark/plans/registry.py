"""All registered queries and their oracle texts."""

from __future__ import annotations

import importlib

AREAS = ["analytics", "search", "corpus", "language", "understanding", "safety", "web", "streams"]


def all_queries() -> dict:
    out: dict = {}
    for area in AREAS:
        out.update(importlib.import_module(f"tidemark.plans.{area}").QUERIES)
    return out


def all_oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for area in AREAS:
        try:
            module = importlib.import_module(f"tidemark.oracles.{area}")
        except ModuleNotFoundError:
            continue
        out.update(module.ORACLES)
    return out
