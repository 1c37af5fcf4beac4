"""How queries are registered beside the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrace.sources.fixtures import sql, table

Query = Callable[[SparkSession, str], DataFrame]


class Part:
    """Queries over named fixtures; each function takes the tables it names."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, tables: str, say: str | None = None):
        """say: the SQL over the fixtures, which it can name as tables."""
        names = tables.split()

        def register(f):
            self.queries[name] = lambda spark, sf_dir: f(*[table(spark, sf_dir, t) for t in names])
            if say is not None:
                self.oracles[name] = with_fixtures(names, say)
            return f

        return register


def with_fixtures(names: list[str], say: str) -> str:
    body = say.strip()
    ctes = ", ".join(f"{n} AS ({sql(n)})" for n in names)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {ctes} {body}"
