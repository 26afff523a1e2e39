"""Collects the query catalogue from the plan modules."""

from __future__ import annotations

import importlib

MODULES = [
    "hourcast.plans.q_features",
    "hourcast.plans.q_metrics",
    "hourcast.plans.q_align",
    "hourcast.plans.q_quality",
    "hourcast.plans.q_sources",
    "hourcast.plans.q_store",
    "hourcast.plans.q_ml",
    "hourcast.plans.q_stream",
]


def _load():
    qs, sql = {}, {}
    for m in MODULES:
        try:
            mod = importlib.import_module(m)
        except ModuleNotFoundError as e:
            if e.name == m:
                continue
            raise
        for k, v in mod.QUERIES.items():
            if k in qs:
                raise ValueError(f"duplicate query {k}")
            qs[k] = v
        sql.update(mod.ORACLE)
    return qs, sql


def all_queries():
    return _load()[0]


def all_oracle():
    return _load()[1]
