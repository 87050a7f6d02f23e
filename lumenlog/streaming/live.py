"""Queries added to and dropped from a running program, over its published relations."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame

from ..engine import Evaluator, named, served
from ..lang.ast import Program
from ..lang.loader import load_text
from ..plans.typing import Typed, check
from .epoch import Maintained


class Unpublished(RuntimeError):
    """The running program publishes nothing."""


class LiveQueries:
    """Programs by id. A query's results don't depend on when it was added: it reads the relations as they are and follows every epoch."""

    def __init__(self, base: Maintained, publish: bool = True):
        self.base, self.publish = base, publish
        self.queries: dict[str, tuple[str, Typed]] = {}
        self.results: dict[str, tuple[int, dict[str, DataFrame]]] = {}
        self.log: list[tuple[str, str]] = []
        self.lock = threading.RLock()

    def published(self) -> dict[str, tuple[str, ...]]:
        p = self.base.declared
        names = [*p.inputs, *served(p)] if self.publish else []
        return {n: p.decls[n].types for n in names}

    def add(self, name: str, text: str) -> Program:
        if not self.publish:
            raise Unpublished("the running program publishes no relations")
        with self.lock:
            if not name or name in self.queries:
                raise ValueError(f"the id {name!r} is {'taken' if name else 'empty'}")
            typed = check(load_text(text, name))
            have = self.published()
            for n, d in typed.program.inputs.items():
                if n not in have:
                    raise ValueError(f"{n} isn't published; there are {', '.join(sorted(have))}")
                if have[n] != d.types:
                    raise ValueError(f"{n} is published as ({', '.join(have[n])}), not ({', '.join(d.types)})")
            if not typed.program.derived:
                raise ValueError("a query derives at least one declared relation")
            Evaluator(self.base.spark, typed, self.base.evaluator.rounds)
            self.queries[name] = (text, typed)
            self.log.append(("add", name))
            return typed.program

    def drop(self, name: str) -> None:
        with self.lock:
            if name not in self.queries:
                raise KeyError(name)
            del self.queries[name]
            self.results.pop(name, None)
            self.log.append(("drop", name))

    def replace(self, name: str, text: str) -> Program:
        with self.lock:
            if name in self.queries:
                self.drop(name)
            return self.add(name, text)

    def relations(self, name: str) -> dict[str, DataFrame]:
        """The query's derived relations as of the base's last epoch."""
        with self.lock:
            _, typed = self.queries[name]
            if name not in self.results or self.results[name][0] != self.base.epoch:
                inputs = {n: self.base.relation(n) for n in typed.program.inputs}
                done = Evaluator(self.base.spark, typed, self.base.evaluator.rounds).run(inputs)
                self.results[name] = (self.base.epoch, {n: named(done[n], d) for n, d in typed.program.derived.items()})
            return self.results[name][1]
