"""Collects the named queries and the SQL that states what each returns."""

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def keep(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return keep
