"""All registered queries."""

from __future__ import annotations

from rankloom.plans.registry import ORACLES, QUERIES  # noqa: F401

import importlib

for _m in (
    "q_sources", "q_clean", "q_features", "q_regime", "q_normalize", "q_sequences", "q_graph", "q_evaluate",
    "q_portfolio", "q_performance", "q_ledger", "q_drift", "q_experiments", "q_streaming",
):
    try:
        importlib.import_module(f"rankloom.plans.{_m}")
    except ModuleNotFoundError as e:
        if e.name != f"rankloom.plans.{_m}":
            raise


def flagship(spark, sf_dir, top):
    from rankloom.plans.q_portfolio import flagship as f

    return f(spark, sf_dir, top)
