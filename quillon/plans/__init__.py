"""Named queries over the driver's tables, with the SQL that states what each returns."""

from importlib import import_module

from .registry import ORACLE, QUERIES

MODULES = ("splits", "joins", "aggregates", "ordered", "selection", "vectors", "graphs", "evaluation", "scalars", "attribution", "storage", "concepts", "networks", "services")


def _load():
    for module in MODULES:
        import_module(f"{__name__}.{module}")


def queries():
    _load()
    return dict(QUERIES)


def oracle_sql():
    _load()
    return dict(ORACLE)
