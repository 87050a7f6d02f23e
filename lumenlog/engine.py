"""Programs over DataFrames: the batch evaluator and the engine's public face."""

from __future__ import annotations

import os
from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.expressions import SPARK_TYPES
from .lang.ast import Atom, Decl, Program, Rule
from .lang.diagnostics import Finding, ProgramError
from .lang.loader import load_file, load_text
from .operators import fixpoint
from .operators.aggregate import fold
from .operators.rule import Join, body, head, once, positional
from .plans.rewrite import rewrite
from .plans.strata import Stratum, stratify
from .plans.typing import ANY, Typed, check

DEFAULT_ROUNDS = 100_000


def conform(df: DataFrame, decl: Decl, as_set: bool = True) -> DataFrame:
    """A table as the relation that is declared: columns by name if all are there, else by place; whole types widened.

    Rows become a set, unless as_set is false. Times become epoch seconds, decimals floats, negative
    zeros zeros; values beyond 64 bits are clamped.
    """
    if len(df.columns) < len(decl.columns):
        raise ValueError(f"{decl.name} has {len(decl.columns)} columns, the table has {len(df.columns)}: {df.columns}")
    names = list(decl.names) if set(decl.names) <= set(df.columns) else df.columns[: len(decl.columns)]
    out = []
    for i, (name, kind) in enumerate(zip(names, decl.types, strict=True)):
        have, c = df.schema[name].dataType, df[name]
        if isinstance(have, T.DateType):
            c, have = F.unix_date(c).cast("bigint") * 86400, T.LongType()
        elif isinstance(have, (T.TimestampType, T.TimestampNTZType)):
            c, have = F.unix_timestamp(c), T.LongType()
        whole = isinstance(have, (T.IntegralType, T.BooleanType)) or isinstance(have, T.DecimalType) and have.scale == 0
        real = isinstance(have, (T.FractionalType, T.DecimalType))
        fits = {"number": whole, "float": real, "string": True}[kind]
        if not fits and not isinstance(have, T.NullType):
            raise ValueError(f"{decl.name}.{decl.names[i]} is a {kind}, the table has {have.simpleString()}")
        if kind == "number" and isinstance(have, T.DecimalType):
            c = F.greatest(F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)"))
        if kind == "string" and isinstance(have, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        c = c.cast(SPARK_TYPES[kind])
        out.append((c + F.lit(0.0) if kind == "float" else c).alias(f"c{i}"))
    return df.select(*out).distinct() if as_set else df.select(*out)


def named(df: DataFrame, decl: Decl) -> DataFrame:
    return df.toDF(*decl.names) if decl.columns else df


def presented(df: DataFrame, decl: Decl) -> DataFrame:
    """Ordered and limited as declared: nulls last either way, ties by all columns' text. Else by the cells' text."""
    df = named(df, decl)
    ties = [F.col(c).cast("string").asc_nulls_last() for c in df.columns]
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in decl.order_by]
    if not keys and decl.limit is None:
        return df
    df = df.orderBy(*keys, *ties)
    return df if decl.limit is None else df.limit(decl.limit)


class Evaluator:
    """Evaluates a checked program's strata over input frames."""

    def __init__(self, spark: SparkSession, typed: Typed, rounds: int = DEFAULT_ROUNDS, bag_arguments: bool = False, bags: Iterable[str] = ()):
        self.spark, self.rounds, self.bags = spark, rounds, frozenset(bags)
        program = rewrite(typed.program, bag_arguments)
        self.typed = check(program) if program is not typed.program else typed
        self.program, self.kinds = program, self.typed.kinds
        self.strata = stratify(program)
        self.held: list[DataFrame] = []
        self.repeating: dict[str, DataFrame] = {}  # inputs whose rows may repeat, for rules that make sets anyway
        self.readers: dict[str, int] = {}
        for r in program.rules:
            for a in r.atoms:
                self.readers[a.relation] = self.readers.get(a.relation, 0) + 1
        for name in self.bags:
            if name not in program.heads or name in program.inputs or name in self.readers or self.fold_of(name):
                raise ValueError(f"{name} can't be a bag: only what rules derive without a fold and no rule reads")

    # Frames of relations.

    def empty(self, name: str) -> DataFrame:
        kinds = [SPARK_TYPES.get(k, "string") for k in self.kinds[name]]
        return self.spark.createDataFrame([], ", ".join(f"c{i} {k}" for i, k in enumerate(kinds)) or "c0 string")

    def shaped(self, name: str, df: DataFrame) -> DataFrame:
        kinds = self.kinds[name]
        return df.select(*(F.col(c).cast(SPARK_TYPES[k]).alias(c) if k != ANY else F.col(c) for c, k in zip(df.columns, kinds, strict=True)))

    def fold_of(self, name: str) -> str | None:
        if (d := self.program.decls.get(name)) and d.merge:
            return d.merge
        return next((r.aggregate.op for r in self.program.rules if r.head == name and r.aggregate), None)

    def folded(self, name: str, df: DataFrame) -> DataFrame:
        op = self.fold_of(name)
        return fold(df, op, self.kinds[name][-1]) if op else df if name in self.bags else df.distinct()

    def is_bag(self, r: Rule) -> bool:
        return r.head in self.bags or self.fold_of(r.head) in ("sum", "count", "avg")

    def release(self) -> None:
        """Free the relations that run() holds because several rules read them."""
        while self.held:
            self.held.pop().unpersist()

    def rows(self, i: int, lookup, last: Join | None = None) -> DataFrame:
        """Rule i's head rows, not yet a set."""
        r, env = self.program.rules[i], self.typed.envs[i]
        return self.shaped(r.head, head(r, body(r, lookup, env, self.is_bag(r), r.head in self.bags, last), env))

    # Evaluation.

    def run(self, inputs: dict[str, DataFrame], wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """Frames, with places as columns, of all relations, or of those wanted and what they need."""
        done: dict[str, DataFrame] = {}
        self.release()
        self.repeating = {}
        for name, decl in self.program.inputs.items():
            if name in inputs:
                self.repeating[name] = conform(inputs[name], decl, as_set=False)
                done[name] = self.repeating[name].distinct()
            else:
                done[name] = self.empty(name)
        for name in {a.relation for r in self.program.rules for a in r.atoms} | set(self.program.decls):
            done.setdefault(name, self.empty(name))
        needed = self.needed(wanted)
        for s in self.strata:
            if needed is None or needed & set(s.heads):
                done |= self.recursive(s, done) if s.recursive else self.plain(s, done)
        return done

    def needed(self, wanted: Iterable[str] | None) -> set[str] | None:
        if wanted is None:
            return None
        out, todo = set(), list(wanted)
        while todo:
            name = todo.pop()
            if name not in out:
                out.add(name)
                todo += [a.relation for r in self.program.rules if r.head == name for a in r.atoms]
        return out

    def plain(self, s: Stratum, done: dict[str, DataFrame]) -> dict[str, DataFrame]:
        (name,) = s.heads
        # A set's rules may read inputs' rows repeated: columns are pruned and rows made different once, at the head. A bag's must.
        as_sets = name not in self.bags and self.fold_of(name) in ("sum", "count", "avg")
        given = self.program.decls.get(name) and self.program.decls[name].section == "in"
        made: list[DataFrame] = []

        def last(*sides) -> DataFrame | None:
            out = once(*sides)
            made.extend([out] if out is not None else [])
            return out

        # The one rule of a set needn't make a product's rows different where its sides' rows are.
        alone = len(s.rules) == 1 and not given and not self.fold_of(name) and name not in self.bags
        parts = [self.rows(i, lambda n, _: done[n] if as_sets else self.repeating.get(n, done[n]), last if alone else None) for i in s.rules]
        if given:
            parts.append(done[name])
        out = union(parts) if made else self.folded(name, union(parts))
        if self.readers.get(name, 0) > 1:
            self.held.append(out.persist())
        return {name: out}

    def recursive(self, s: Stratum, done: dict[str, DataFrame]) -> dict[str, DataFrame]:
        heads, rules = set(s.heads), {i: self.program.rules[i] for i in s.rules}
        inside = {i: [k for k, p in enumerate(r.body) if isinstance(p, Atom) and p.relation in heads] for i, r in rules.items()}
        given = {h: done[h] for h in heads if self.program.decls.get(h) and self.program.decls[h].section == "in"}
        held = {n: fixpoint.settled(done[n]) for n in {a.relation for r in rules.values() for a in r.atoms} - heads}
        folds = {h: self.fold_of(h) for h in heads}

        def seeds() -> dict[str, DataFrame]:
            out = {}
            for h in heads:
                parts = [self.rows(i, lambda n, _: held[n]) for i, r in rules.items() if r.head == h and not inside[i]]
                out[h] = union([*parts, *([given[h]] if h in given else [])]) if parts or h in given else self.empty(h)
            return out

        def step(total: dict[str, DataFrame], delta: dict[str, DataFrame]) -> dict[str, DataFrame]:
            out: dict[str, list[DataFrame]] = {}
            for i, r in rules.items():
                for at in inside[i]:
                    lookup = lambda n, k, at=at: delta[n] if k == at else total[n] if n in heads else held[n]
                    out.setdefault(r.head, []).append(self.rows(i, lookup))
            return {h: union(parts) for h, parts in out.items()}

        if not any(folds.values()):
            if len(heads) == 1 and not given and fixpoint.is_doubling(list(rules.values()), name := s.heads[0]):
                return {name: fixpoint.close_doubling(seeds()[name], self.rounds)}
            if len(heads) == 1 and (walk := fixpoint.walk_of(list(rules.values()), name := s.heads[0], lambda n: self.fold_of(n) is not None)):
                return {name: fixpoint.close_walk(seeds()[name], held[walk.edge], walk, self.rounds)}
            return fixpoint.close_sets(seeds(), step, self.rounds)
        if self.is_lattice(heads, rules, folds):
            return fixpoint.close_lattice(seeds(), step, self.folded, self.rounds)

        def evaluate(now: dict[str, DataFrame]) -> dict[str, DataFrame]:
            out: dict[str, list[DataFrame]] = {h: [given[h]] if h in given else [] for h in heads}
            for i, r in rules.items():
                out[r.head].append(self.rows(i, lambda n, _: now[n] if n in heads else held[n]))
            return {h: self.folded(h, union(parts)) for h, parts in out.items()}

        return fixpoint.close_rounds({h: self.empty(h) for h in heads}, evaluate, self.rounds)

    def is_lattice(self, heads: set[str], rules: dict[int, Rule], folds: dict[str, str | None]) -> bool:
        """Whether improving values can only improve what is derived from them: then old, worse rows may stay in derivations.

        Every head folds by the same operator. A folded column must be read as
        a variable that goes nowhere but into the head's folded column, through
        sums with what isn't folded, or by itself.
        """
        if len(set(folds.values())) != 1 or None in folds.values():
            return False
        from .lang.ast import Aggregate, Chain, Var, variables

        for r in rules.values():
            values = [a.args[-1] for a in r.atoms if a.relation in heads]
            if any(not isinstance(v, Var) for v in values):
                return False
            names = [v.name for v in values]
            if len(set(names)) < len(names):
                return False
            others = [*r.args[:-1], *(p for p in r.body if not (isinstance(p, Atom) and p.relation in heads))]
            others += [x for a in r.atoms if a.relation in heads for x in a.args[:-1]]
            if {v for o in others for v in variables(o)} & set(names):
                return False
            last = r.args[-1].arg if isinstance(r.args[-1], Aggregate) else r.args[-1]
            if isinstance(last, Chain) and not all(isinstance(t, Var) or not list(variables(t)) for t in (last.first, *(t for _, t in last.rest))):
                return False
            if isinstance(last, Chain) and any(op != "+" for op, t in last.rest) or not isinstance(last, (Chain, Var)) and set(variables(last)) & set(names):
                return False
        return True


def union(parts: list[DataFrame]) -> DataFrame:
    out = positional(parts[0])
    for p in parts[1:]:
        out = out.union(positional(p))
    return out


def served(program: Program) -> list[str]:
    """Derived relations that are declared and that no other relation's rule reads, and all of .out."""
    read = {a.relation for r in program.rules for a in r.atoms if a.relation != r.head}
    return [n for n, d in program.derived.items() if d.section == "out" or n not in read]


def consumers(program: Program, name: str) -> list[str]:
    return sorted({r.head for r in program.rules if r.head != name and any(a.relation == name for a in r.atoms)})


class Engine:
    """Sources, a program and its results.

    engine = Engine(spark); engine.load_text(program); engine.bind("edge", df);
    engine.evaluate()["path"] is a DataFrame.
    """

    def __init__(self, spark: SparkSession, rounds: int | None = None, bag_arguments: bool = False, bags: Iterable[str] = ()):
        """bags: derived relations that keep a row for each match, as SQL without DISTINCT does; evaluate() and query() only."""
        from .sources import registry

        self.spark, self.bag_arguments, self.bags = spark, bag_arguments, tuple(bags)
        self.rounds = rounds or int(os.environ.get("LUMENLOG_MAX_ROUNDS", DEFAULT_ROUNDS))
        self.providers = registry()
        self.program: Program | None = None
        self.typed: Typed | None = None
        self.evaluator: Evaluator | None = None
        self.tables: dict[str, DataFrame] = {}
        self.bindings: list[tuple[str, str | None, dict[str, str]]] = []

    def add_plugin(self, name: str, make) -> None:
        """Register a provider: make(config) gives a source."""
        self.providers[name] = make

    def add_source(self, provider: str, config: dict[str, str] | None = None, relation: str | None = None) -> None:
        """Bind a provider's outputs to relations of the same names, or its one output to relation. Wins over the program's own .source."""
        if provider not in self.providers:
            raise ValueError(f"no provider {provider!r}; there are {', '.join(sorted(self.providers))}")
        self.bindings.append((provider, relation, dict(config or {})))

    def bind(self, relation: str, df: DataFrame) -> None:
        self.tables[relation] = df

    def load_text(self, text: str, source: str = "") -> Engine:
        return self._loaded(load_text(text, source))

    def load_file(self, path: str) -> Engine:
        return self._loaded(load_file(path))

    def _loaded(self, program: Program) -> Engine:
        for name, span in program.requires:
            if name not in self.providers:
                raise ProgramError([Finding(f"{name} is required and isn't there", span, f"there are {', '.join(sorted(self.providers))}")], program.texts)
        for s in program.sources:
            if s.provider not in self.providers:
                raise ProgramError([Finding(f"no provider {s.provider!r}", s.span, f"there are {', '.join(sorted(self.providers))}")], program.texts)
        self.typed = check(program)
        Evaluator(self.spark, self.typed, self.rounds, self.bag_arguments, self.bags)
        self.program = program
        return self

    def sources(self) -> list[tuple[object, str | None]]:
        """The sources to read; an engine's binding replaces the program's of the same relation and provider."""
        own = {(p, r) for p, r, _ in self.bindings}
        both = [*self.bindings, *((s.provider, s.relation, s.config) for s in self.program.sources if (s.provider, s.relation) not in own)]
        return [(self.providers[p](c), r) for p, r, c in both]

    def inputs(self, facts: str | None = None, delimiter: str = ",") -> dict[str, DataFrame]:
        """Frames of the inputs: bound tables, then sources, then facts files."""
        from .sources.facts import read_facts

        out: dict[str, DataFrame] = {}
        read = {a.relation for r in self.program.rules for a in r.atoms} | set(served(self.program))
        for source, relation in self.sources():
            for name, df in source.batch(self.spark, self.program.inputs if relation is None else {relation: self.program.decls[relation]}).items():
                name = relation or name
                if name in self.program.inputs and name in read:
                    out[name] = out[name].union(conform(df, self.program.decls[name])) if name in out else conform(df, self.program.decls[name])
        out |= self.tables
        if facts is not None:
            for name, decl in self.program.inputs.items():
                if name not in out:
                    out[name] = read_facts(self.spark, decl, facts, delimiter)
        return out

    def evaluate(self, inputs: dict[str, DataFrame] | None = None, facts: str | None = None, delimiter: str = ",", wanted: Iterable[str] | None = None) -> dict[str, DataFrame]:
        """All declared relations' frames, under their columns' names."""
        self.release()
        self.evaluator = ev = Evaluator(self.spark, self.typed, self.rounds, self.bag_arguments, self.bags)
        done = ev.run((inputs or {}) | self.inputs(facts, delimiter) if inputs is None else inputs, wanted)
        return {n: named(done[n], d) for n, d in self.program.decls.items()}

    def release(self) -> None:
        """Free what the last evaluate() holds in memory for its frames; they are computed again where still used."""
        if self.evaluator is not None:
            self.evaluator.release()

    def query(self, relation: str, inputs: dict[str, DataFrame] | None = None) -> DataFrame:
        """One relation as it is served: ordered and limited as declared."""
        decl = self.program.decls[relation]
        return presented(self.evaluate(inputs, wanted=[relation])[relation], decl)


    # Maintained results.

    def run(self, listeners: Iterable = ()):
        """Start maintaining the program over its sources and bound tables; returns the maintained state. poll() takes in what changed.

        Listeners get (epoch, frames, relations that changed) after each epoch.
        """
        from .streaming.epoch import Maintained
        from .streaming.live import LiveQueries

        if self.bags:
            raise ValueError("a maintained program's relations are sets")
        self.maintained = Maintained(self.spark, self.typed, self.rounds, self.bag_arguments)
        self.maintained.listeners += listeners
        self.live_queries = LiveQueries(self.maintained)
        self._running = self.sources()
        self.maintained.advance({**self._changes(True), **self.tables})
        return self.maintained

    def poll(self) -> set[str]:
        """Look at the sources again and seal what changed as an epoch; the relations that changed."""
        changes = self._changes(False)
        return self.maintained.advance(changes) if changes else set()

    def state(self, relation: str) -> DataFrame:
        """A relation of the maintained program, as it is served."""
        return presented(self.maintained.relation(relation), self.program.decls[relation])

    def _changes(self, first: bool) -> dict[str, DataFrame]:
        found: dict[str, DataFrame] = {}
        read = {a.relation for r in self.program.rules for a in r.atoms} | set(served(self.program))
        wanted = {n: d for n, d in self.program.inputs.items() if n in read}
        for source, relation in self._running:
            if first or not source.static:
                for name, df in source.changes(self.spark, {relation: self.program.decls[relation]} if relation else wanted).items():
                    name = relation or name
                    if name in wanted and (first or not df.isEmpty()):
                        found[name] = found[name].unionByName(df) if name in found else df
        return found


def run_program(spark: SparkSession, text: str, inputs: dict[str, DataFrame], relation: str, **options) -> DataFrame:
    """The relation that a program derives from these inputs."""
    engine = Engine(spark, **options)
    engine.load_text(text)
    return engine.query(relation, inputs)


__all__ = ["Engine", "Evaluator", "conform", "consumers", "presented", "replace", "run_program", "served"]
