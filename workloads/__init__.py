"""Queries over the supplied tables, each next to the SQL that checks it."""

from importlib import import_module

MODULES = (
    "sources", "cleaning", "audit", "metrics", "ranking", "retrieval", "statistics", "explanations", "documents", "training",
)


def load() -> None:
    for name in MODULES:
        import_module(f"workloads.{name}")
