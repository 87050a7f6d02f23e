"""What is served: relations' rows as text cells."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..engine import consumers, presented, served
from ..lang.ast import Decl, Program
from ..sources.sinks import cell
from ..streaming.epoch import Maintained
from ..streaming.live import LiveQueries, Unpublished


class NotFound(KeyError):
    def __init__(self, said: str):
        super().__init__(said)
        self.said = said


class Service:
    """A maintained program and its live queries, for the HTTP server and the command line."""

    def __init__(self, base: Maintained, program: Program, publish: bool = True, roots: tuple[str, ...] = (), path: str | None = None):
        self.base, self.program, self.roots, self.path = base, program, roots, path
        self.live = LiveQueries(base, publish)

    def names(self) -> list[str]:
        return sorted(served(self.program))

    def listing(self) -> list[dict]:
        return [{"name": n, "count": self.base.relation(n).count(), "columns": self.columns(self.program.decls[n])} for n in self.names()]

    @staticmethod
    def columns(decl: Decl) -> list[dict]:
        return [{"name": n, "type": t} for n, t in decl.columns]

    def rows(self, name: str) -> list[list[str]]:
        """Rows as declared, in order and up to the limit; else ordered by their cells' text."""
        if name not in self.names():
            if name in self.program.decls:
                by = consumers(self.program, name)
                raise NotFound(f"{name} isn't served" + (f": {', '.join(by)} read it; declare it under .out to serve it" if by else ""))
            raise NotFound(f"there is no relation {name}")
        decl = self.program.decls[name]
        got = self.shown(presented(self.base.relation(name), decl))
        return got if decl.order_by else sorted(got)

    @staticmethod
    def shown(df: DataFrame) -> list[list[str]]:
        return [[cell(v) for v in row] for row in df.toLocalIterator()]

    def query_rows(self, query: str, name: str) -> list[list[str]]:
        """A live query's rows, by their text; its own order and limit don't count."""
        relations = self.query_relations(query)
        if name not in relations:
            raise NotFound(f"query {query} has no relation {name}")
        return sorted(self.shown(relations[name]))

    def query_relations(self, query: str) -> dict[str, DataFrame]:
        try:
            return self.live.relations(query)
        except KeyError:
            raise NotFound(f"there is no query {query}") from None


__all__ = ["NotFound", "Service", "Unpublished"]
