"""A rule's body as one DataFrame expression: scans, joins, filters, antijoins and the head's projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import condition, value
from ..lang.ast import Aggregate, Atom, Const, Rule, Var, variables

Lookup = Callable[[str, int], DataFrame]
#: A last join of a rule: both sides, the variables that they share, and the head's of the left and of the right.
Join = Callable[[DataFrame, DataFrame, list[str], list[str], list[str]], DataFrame | None]

#: Of a key with more rows than this a join makes several parts, up to so many of a side.
PART_ROWS, PARTS = 2048, 16


def positional(df: DataFrame) -> DataFrame:
    """Columns c0, c1, ...: rules address them by place."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def atom_frame(df: DataFrame, atom: Atom, used: set[str] | None, as_set: bool) -> DataFrame:
    """The atom's rows with a column for each variable; only those in used, if given.

    As a set, rows are made different again where a projection may have merged
    some. Without variables, one column tells that there are rows.
    """
    where: Column | None = None
    names: dict[str, str] = {}
    for i, arg in enumerate(atom.args):
        test = None
        if isinstance(arg, Const):
            test = F.col(f"c{i}") == F.lit(arg.value)
        elif isinstance(arg, Var):
            if arg.name in names:
                test = F.col(names[arg.name]).eqNullSafe(F.col(f"c{i}"))
            else:
                names[arg.name] = f"c{i}"
        if test is not None:
            where = test if where is None else where & test
    if where is not None:
        df = df.where(where)
    kept = [n for n in names if used is None or n in used]
    out = df.select(*(F.col(names[n]).alias(n) for n in kept)) if kept else df.select(F.lit(1).alias("\x00any"))
    return out.distinct() if as_set and len(kept) < len(atom.args) else out


def equal(left: DataFrame, right: DataFrame, on: Sequence[str]) -> Column:
    """Null matches null, as in joins of relations."""
    out = F.lit(True)
    for n in on:
        out = out & left[n].eqNullSafe(right[n])
    return out


def keyed(df: DataFrame, on: Sequence[str]) -> list[Column]:
    """Two columns for each of on that are never null, and equal where those are, nulls included."""
    nothing = {"bigint": 0, "double": 0.0, "string": ""}
    kinds = [(n, df.schema[n].dataType.simpleString()) for n in on]
    return [c for n, kind in kinds for c in (F.coalesce(F.col(n), F.lit(nothing[kind]).cast(kind)), F.col(n).isNull())]


def spread(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two frames, the left's columns first. What a frequent key makes is spread over a grid of the parts of either side's rows.

    A row is copied PARTS times at most, so what moves is in proportion to the
    sides, however large their product.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    width = 2 * len(on)
    names = lambda side: [*(f"\x00{side}{i}" for i in range(width)), f"\x00{side}a", f"\x00{side}b"]
    same = lambda one, two: reduce(and_, (F.col(x) == F.col(y) for x, y in zip(one, two, strict=True)))
    *keys, a, b = names("f")

    def counted(df: DataFrame, mine: str) -> DataFrame:
        n = df.select(*(c.alias(k) for k, c in zip(keys, keyed(df, on), strict=True))).groupBy(*keys).agg(F.count(F.lit(1)).alias("\x00n")).where(F.col("\x00n") > PART_ROWS)
        parts = F.least(F.ceil(F.col("\x00n") / PART_ROWS), F.lit(PARTS)).cast("int")
        return n.select(*keys, *((parts if c == mine else F.lit(1)).alias(c) for c in (a, b)))

    frequent = counted(left, a).union(counted(right, b)).groupBy(*keys).agg(F.max(a).alias(a), F.max(b).alias(b))

    def parted(df: DataFrame, side: str, mine: str, other: str) -> DataFrame:
        """The rows with their keys and their places in the grid: one of their own side's parts, all of the other's."""
        *own, _, _ = names(side)
        rows = df.select("*", *(c.alias(k) for k, c in zip(own, keyed(df, on), strict=True)))
        few = F.broadcast(frequent)  # one key for every PART_ROWS rows at most
        part = F.pmod(F.xxhash64(*df.columns), F.coalesce(F.col(mine), F.lit(1)).cast("bigint")).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other), F.lit(1)) - 1))
        rows = rows.join(few, same(own, keys), "left").select(*rows.columns, part.alias(mine.replace("f", side)), every.alias(other.replace("f", side)))
        return rows.repartition(tasks, *names(side))

    new = [c for c in right.columns if c not in on]
    return parted(left, "l", a, b).join(parted(right, "r", b, a).drop(*on), same(names("l"), names("r"))).select(*left.columns, *new)


def once(left: DataFrame, right: DataFrame, on: list[str], lefts: list[str], rights: list[str]) -> DataFrame | None:
    """The different rows of lefts and rights whose sides agree in on; None where a key has one row of rights, so that nothing multiplies.

    Where rights stand with one key only, no row can be made twice from sides of
    different rows: only the sides are made different, never their product.
    The few jobs that tell read the right side.
    """
    if any(df.schema[n].dataType.simpleString() not in ("bigint", "double", "string") for df in (left, right) for n in on):
        return None
    ends = lambda by, of: right.groupBy(*by).agg(F.min(F.struct(*of)).alias("\x00min"), F.max(F.struct(*of)).alias("\x00max"))
    several = ~F.col("\x00min").eqNullSafe(F.col("\x00max"))
    if ends(on, rights).where(several).isEmpty():
        return None
    left = left.select(*dict.fromkeys((*lefts, *on))).distinct()
    hidden, by = [n for n in on if n not in lefts], [*rights, *(n for n in on if n in lefts)]
    right = right.select(*on, *rights)
    if not hidden:
        return spread(left, right.distinct(), on).select(*lefts, *rights)
    groups = ends(by, hidden)
    single = groups.where(~several).select(*by, "\x00min.*")
    out = spread(left, single, on).select(*lefts, *rights)
    mixed = groups.where(several).select(*(F.col(n).alias(f"\x00m{n}") for n in by))
    if mixed.isEmpty():
        return out
    test = F.lit(True)
    for n in by:
        test = test & F.col(n).eqNullSafe(F.col(f"\x00m{n}"))
    return out.union(spread(left, right.join(mixed, test, "left_semi").distinct(), on).select(*lefts, *rights).distinct())


def join_order(atoms: Sequence[Atom]) -> list[int]:
    """The first atom, then always the next one that shares most variables with those before; products come last."""
    left, order = list(range(len(atoms))), []
    bound: set[str] = set()
    while left:
        best = max(left, key=lambda i: (len(bound & set(variables(atoms[i]))) if order else 0, -i))
        order.append(best)
        left.remove(best)
        bound |= set(variables(atoms[best]))
    return order


def body(rule: Rule, lookup: Lookup, kinds: dict[str, str], bag: bool, repeats: bool = False, last: Join | None = None) -> DataFrame:
    """The rows of variables that satisfy the body.

    Of a bag, a row for each match; of a set, atoms that bind nothing new or
    nothing needed only filter (left semi joins). Negated atoms make the rows
    different, unless they may repeat. The last atom is joined by last, if that is
    given, only the head's variables matter then, and it doesn't return None.
    """
    atoms, order = rule.positive, join_order(rule.positive)
    pending, negated = list(rule.comparisons), list(rule.negative)
    head = {v for a in rule.args for v in variables(a)}
    needed_by = lambda: head | {v for p in (*pending, *negated) for v in variables(p)}
    now: DataFrame | None = None
    bound: set[str] = set()

    def settle(df: DataFrame) -> DataFrame:
        columns = {v: (F.col(v), kinds.get(v, "string")) for v in bound}
        for c in [c for c in pending if set(variables(c)) <= bound]:
            df = df.where(condition(c, columns))
            pending.remove(c)
        later = {v for i in order[done + 1 :] for v in variables(atoms[i])}
        for n in [n for n in negated if set(variables(n)) <= bound]:
            other = atom_frame(lookup(n.relation, rule.body.index(n)), n, None, True)
            negated.remove(n)
            on = list(dict.fromkeys(variables(n)))
            df = df.join(other, equal(df, other, on) if on else F.lit(True), "left_anti")
            kept = [v for v in df.columns if v in needed_by() | later]
            df = df.select(*kept) if kept else df.select(F.lit(1).alias("\x00any"))
            df = df if repeats else df.distinct()
        return df

    for done, i in enumerate(order):
        atom = atoms[i]
        used = needed_by() | {v for j in order if j != i for v in variables(atoms[j])}
        frame = atom_frame(lookup(atom.relation, rule.body.index(atom)), atom, used, False)
        own = [c for c in frame.columns if c != "\x00any"]
        if now is None:
            now, bound = frame, set(own)
        else:
            on = [v for v in own if v in bound]
            new = [v for v in own if v not in bound]
            test = equal(now, frame, on)
            if not bag and not any(v in needed_by() | {v for j in order[done + 1 :] for v in variables(atoms[j])} for v in new):
                now = now.join(frame, test, "left_semi") if on else now.join(frame.limit(1), F.lit(True), "left_semi")
            elif on:
                told = None
                if last and done == len(order) - 1 and not negated and needed_by() == head and all(isinstance(a, (Var, Const)) for a in rule.args):
                    lefts, rights = [c for c in now.columns if c in head], [c for c in new if c in head]
                    told = last(now, frame, on, lefts, rights) if lefts and rights else None
                now = told if told is not None else now.join(frame, test, "inner").select(*(now[c] for c in now.columns if c != "\x00any"), *(frame[c] for c in new))
            else:
                now = now.crossJoin(frame.withColumnRenamed("\x00any", f"\x00any{done}"))
            bound |= set(new)
        now = settle(now)
        later = needed_by() | {v for j in order[done + 1 :] for v in variables(atoms[j])}
        kept = [c for c in now.columns if c in later]
        if kept and len(kept) < len(now.columns):
            now = now.select(*kept)
    return now


def head(rule: Rule, df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """The head's columns; of an aggregate its argument."""
    columns = {v: (F.col(v), kinds.get(v, "string")) for v in df.columns}
    args = [a.arg if isinstance(a, Aggregate) else a for a in rule.args]
    return df.select(*(value(a, columns)[0].alias(f"c{i}") for i, a in enumerate(args)))
