"""All queries of the order-book library by name."""

from __future__ import annotations

from tickloom.plans import book_plans, cost_plans, io_plans, model_plans, sim_plans, stream_plans, table_plans

FLAGSHIP = "feat_imbalance"
MODULES = (table_plans, io_plans, book_plans, cost_plans, sim_plans, model_plans, stream_plans)
QUERIES = {name: plan for m in MODULES for name, plan in m.catalog.queries.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.catalog.oracles.items()}
