"""Registry of the queries and their oracle SQL."""

NOW = "2024-02-01 00:00:00"   # the run's "now": a parameter, so runs are repeatable
BATCH = "b1"

QUERIES: dict = {}
ORACLES: dict = {}


def register(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco
