"""Recursive strata: semi-naive rounds for sets, improved keys for lattices, and plain rounds for the rest.

Each round's new rows are written with checkpoint() in the session's shared
folder, so lineage is cut and a lost executor costs no earlier rounds. What was
there before isn't written again each time: it is the union of the rounds, made
one table every few.
"""

from __future__ import annotations

import logging
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import value
from ..lang.ast import Atom, Chain, Const, Rule, Var

log = logging.getLogger("lumenlog")

#: Used only on a local master whose session names no checkpoint folder.
DEFAULT_CHECKPOINT_DIR = "/tmp/checkpoints/lumenlog"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; on a cluster the session must name it."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or DEFAULT_CHECKPOINT_DIR).rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """The frame, computed and written in the folder that driver and executors share."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


class Growing:
    """A relation that only grows: its rounds' written rows, read as their union and written as one every so many rounds."""

    def __init__(self, first: DataFrame, rounds: int = 8):
        self.parts, self.rounds = [first], rounds

    def frame(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.union(p)
        return out

    def add(self, delta: DataFrame) -> None:
        self.parts.append(delta)
        if len(self.parts) > self.rounds:
            whole = self.frame()
            self.parts = [settled(whole.coalesce(int(whole.sparkSession.conf.get("spark.sql.shuffle.partitions"))))]


def changed(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new that old lacks; null equals null."""
    other = old.toDF(*(f"old_{c}" for c in old.columns))  # names of its own, whatever frames the two share
    on = F.lit(True)
    for c, o in zip(new.columns, other.columns, strict=True):
        on = on & F.col(c).eqNullSafe(F.col(o))
    return new.join(other, on, "left_anti")


def is_doubling(rules: list[Rule], name: str) -> bool:
    """p(X, Y) :- e(X, Y). p(X, Z) :- p(X, Y), e(Y, Z). or its mirror: then p with p, joined, grows twice as far each round."""
    if len(rules) != 2 or any(len(r.args) != 2 or not all(isinstance(a, Var) for a in r.args) for r in rules):
        return False
    base, step = sorted(rules, key=lambda r: len(r.body))
    if len(base.body) != 1 or len(step.body) != 2 or not all(isinstance(p, Atom) and not p.negated and all(isinstance(a, Var) for a in p.args) and len(p.args) == 2 for p in (*base.body, *step.body)):
        return False
    e = base.body[0]
    if e.relation == name or e.args != base.args or len(set(e.args)) != 2:
        return False
    first, second = sorted(step.body, key=lambda p: p.args[0] != step.args[0])
    x, y, z = first.args[0], first.args[1], second.args[1]
    if len({x, y, z}) != 3 or second.args[0] != y or step.args != (x, z):
        return False
    return sorted([first.relation, second.relation]) == sorted([name, e.relation])


def close_doubling(base: DataFrame, bound: int) -> DataFrame:
    """The closure of a binary relation in a number of rounds that is the logarithm of the longest path."""
    held = Growing(settled(base.distinct()))
    total = delta = held.frame()
    for _ in range(bound):
        a, b = total.select("c0", F.col("c1").alias("m")), delta.select(F.col("c0").alias("n"), "c1")
        d, t = delta.select("c0", F.col("c1").alias("m")), total.select(F.col("c0").alias("n"), "c1")
        same = F.col("m").eqNullSafe(F.col("n"))
        made = a.join(b, same).select("c0", "c1").union(d.join(t, same).select("c0", "c1")).distinct()
        delta = settled(changed(made, total))
        if delta.isEmpty():
            return total
        held.add(delta)
        total = held.frame()
    log.error("stopped after %d rounds; further rows are dropped", bound)
    return total


@dataclass(frozen=True)
class Walk:
    """A step along a function: where the head has the edge's keys, which of those the edge replaces, and what is added to a counter."""

    edge: str
    keys: tuple[int, ...]
    moved: frozenset[int]
    counter: int | None = None
    step: int = 0


def walk_of(rules: list[Rule], name: str, is_function: Callable[[str], bool]) -> Walk | None:
    """p(K, Y, N + 1) :- p(K, X, N), next(K, X, Y), where next has one Y for each (K, X): then next with next, joined, goes twice as far each round."""
    steps = [r for r in rules if any(a.relation == name for a in r.atoms)]
    if len(steps) != 1 or len(steps[0].body) != 2:
        return None
    (r,) = steps
    if not all(isinstance(b, Atom) and not b.negated and all(isinstance(a, Var) for a in b.args) and len(set(b.args)) == len(b.args) for b in r.body):
        return None
    own, edge = sorted(r.body, key=lambda b: b.relation != name)
    if edge.relation == name or not is_function(edge.relation):
        return None
    *keys, target = edge.args
    if not keys or not set(keys) <= set(own.args) or target in own.args:
        return None
    moved, counter, step = set(), None, 0
    for i, (before, after) in enumerate(zip(own.args, r.args, strict=True)):
        match after:
            case Var() if after == before:
                pass
            case Var() if after == target and before in keys:
                moved.add(i)
            case Chain(first, ((("+" | "-") as op, Const(int() as k)),)) if first == before and before not in keys and counter is None and abs(k) < 2**40:
                counter, step = i, k if op == "+" else -k
            case _:
                return None
    return Walk(edge.relation, tuple(own.args.index(k) for k in keys), frozenset(moved), counter, step) if moved else None


def close_walk(seed: DataFrame, edge: DataFrame, walk: Walk, bound: int) -> DataFrame:
    """What a function leads to from the seed, in a number of rounds that is the logarithm of the longest way: it is joined with itself, and stays one."""
    width = len(walk.keys)
    to = [F.col(f"c{width}") if at in walk.moved else F.col(f"c{i}") for i, at in enumerate(walk.keys)]
    jump = edge.select(*(F.col(f"c{i}").alias(f"s{i}") for i in range(width)), *(c.alias(f"t{i}") for i, c in enumerate(to)))

    def onwards(df: DataFrame, at: list[str]) -> DataFrame:
        test = F.lit(True)
        for i, c in enumerate(at):
            test = test & F.col(c).eqNullSafe(F.col(f"s{i}"))
        return df.join(jump, test)

    held, far = Growing(settled(seed.distinct())), 1
    total = held.frame()
    while far <= bound:
        made = onwards(total, [f"c{at}" for at in walk.keys])
        out = [F.col(f"t{walk.keys.index(i)}") if i in walk.keys else F.col(c) for i, c in enumerate(total.columns)]
        if walk.counter is not None:
            out[walk.counter] = value(Chain(Var("n"), (("+", Const(far * walk.step)),)), {"n": (F.col(f"c{walk.counter}"), "number")})[0]
        delta = settled(changed(made.select(*(c.alias(n) for c, n in zip(out, total.columns, strict=True))).distinct(), total))
        if delta.isEmpty():
            return total
        held.add(delta)
        total = held.frame()
        first = jump.select(*(F.col(f"s{i}").alias(f"f{i}") for i in range(width)), *(F.col(f"t{i}").alias(f"m{i}") for i in range(width)))
        jump = settled(onwards(first, [f"m{i}" for i in range(width)]).select(*(F.col(f"f{i}").alias(f"s{i}") for i in range(width)), *(f"t{i}" for i in range(width))))
        far *= 2
    log.error("stopped after %d steps; further rows are dropped", far - 1)
    return total


def close_sets(seed: dict[str, DataFrame], step: Callable[[dict[str, DataFrame], dict[str, DataFrame]], dict[str, DataFrame]], bound: int) -> dict[str, DataFrame]:
    """Semi-naive: step(total, delta) gives each head's rows that need a row of delta."""
    held = {h: Growing(settled(df.distinct())) for h, df in seed.items()}
    total = {h: g.frame() for h, g in held.items()}
    delta = dict(total)
    for _ in range(bound):
        made = step(total, delta)
        delta = {h: settled(changed(df.distinct(), total[h])) for h, df in made.items()}
        grown = [h for h, df in delta.items() if not df.isEmpty()]
        if not grown:
            return total
        for h in grown:
            held[h].add(delta[h])
            total[h] = held[h].frame()
    log.error("stopped after %d rounds; further rows are dropped", bound)
    return total


def close_lattice(seed: dict[str, DataFrame], step, fold: Callable[[str, DataFrame], DataFrame], bound: int) -> dict[str, DataFrame]:
    """Like close_sets, for heads whose last column folds by min or max: delta has the keys that improved."""
    total = {h: settled(fold(h, df)) for h, df in seed.items()}
    delta = dict(total)
    for _ in range(bound):
        made = step(total, delta)
        new = {h: settled(fold(h, total[h].union(df))) for h, df in made.items()}
        delta = {h: settled(changed(new[h], total[h])) for h in new}
        total = {**total, **new}
        if all(df.isEmpty() for df in delta.values()):
            return total
    log.error("stopped after %d rounds; further improvements are dropped", bound)
    return total


def close_rounds(empty: dict[str, DataFrame], evaluate: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], bound: int) -> dict[str, DataFrame]:
    """From nothing, all heads at once from the round before, until a round changes none. Rows may go as well as come."""
    now = empty
    for _ in range(bound):
        new = {h: settled(df) for h, df in evaluate(now).items()}
        if all(changed(new[h], now[h]).isEmpty() and changed(now[h], new[h]).isEmpty() for h in new):
            return new
        now = new
    log.error("stopped after %d rounds; the result may not be final", bound)
    return now
