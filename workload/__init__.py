"""The given tables seen as jobs, candidates, panels and logs, and one query per operator."""

import importlib

# Modules that register queries.
_MODULES = [
    "workload.retrieval",
    "workload.panels",
    "workload.reuse",
    "workload.analytics",
    "workload.ingest",
    "workload.streams",
]


def load():
    """(queries, oracle SQL) of all modules."""
    from workload import registry

    for module in _MODULES:
        importlib.import_module(module)
    return registry.QUERIES, registry.ORACLE
