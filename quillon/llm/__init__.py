"""Training-data operators (problems 1 to 8) and their queries.

Nothing outside this subpackage imports it.  ``queries()`` and ``oracle_sql()`` collect the ``QUERIES``
and ``ORACLE`` dictionaries of the modules named in ``MODULES``.
"""

from importlib import import_module

MODULES = (
    "neighbours",
    "quantiles",
    "topn",
    "clusters",
    "splits",
    "tokens",
    "leaks",
    "personal",
)


def _collect(name):
    found = {}
    for module in MODULES:
        found.update(getattr(import_module(f"{__name__}.{module}"), name, {}))
    return found


def queries():
    return _collect("QUERIES")


def oracle_sql():
    return _collect("ORACLE")
