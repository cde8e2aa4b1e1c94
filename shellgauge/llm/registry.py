"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("quality", "warc", "toxicity", "kdshard", "neardup", "pii", "bpe", "decontaminate", "langid", "linkgraph", "seekzst", "manifest", "repair")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"{__package__}.{m}"), name)
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("SQL")
