"""Imports every plan module and exposes the registry."""

from __future__ import annotations

import importlib

from corpuslane.plans.registry import ENTRIES, runner

MODULES = ["retrieval", "screening", "conversations", "snapshots", "citations", "ownership", "rulebook", "evaluation", "streams", "requests"]

for _m in MODULES:
    importlib.import_module(f"corpuslane.plans.{_m}")


def queries():
    return {name: runner(e) for name, e in ENTRIES.items()}


def oracle_sql():
    return {name: e.sql for name, e in ENTRIES.items() if e.sql}
