"""Where query modules enter their queries."""

CATALOG: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function under its name, with its DuckDB form."""

    def enter(f):
        own = name or f.__name__
        CATALOG[own] = f
        if sql:
            ORACLES[own] = sql
        return f

    return enter
