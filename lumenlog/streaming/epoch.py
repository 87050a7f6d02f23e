"""Incremental maintenance: after each sealed batch of changes, results equal a batch run over the surviving rows.

Input states and results are written every epoch (checkpoint in the shared
folder), so neither lineage nor history grows. A relation is computed again only
if something that it reads, at any distance, changed: a plain one for the groups
or rows that changed rows take part in, a recursive stratum of sets from its old
fixpoint, by deleting what rests on rows that went and deriving it anew where it
still follows. An epoch counts as sealed when all of it is done;
save() and restore() carry a sealed epoch over to another driver.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Evaluator, conform, named
from ..lang.ast import Atom
from ..operators import fixpoint
from ..operators.rule import positional
from ..plans.typing import Typed
from ..sources.base import DIFF
from .changes import COUNT, applied, difference, empty_state, present


class Maintained:
    """A program whose inputs change by counted rows."""

    def __init__(self, spark: SparkSession, typed: Typed, rounds: int, bag_arguments: bool = False):
        self.spark, self.evaluator = spark, Evaluator(spark, typed, rounds, bag_arguments)
        self.program = self.evaluator.program
        self.declared = typed.program
        self.state = {n: empty_state(self.evaluator.empty(n)) for n in self.program.inputs}
        self.frames: dict[str, DataFrame] = {}
        self.epoch = -1
        self.lock = threading.RLock()
        self.listeners: list[Callable[[int, dict[str, DataFrame], set[str]], None]] = []

    def counted(self, name: str, change: DataFrame) -> DataFrame:
        """A change frame as places and __diff; rows lacking __diff are insertions."""
        decl = self.program.inputs[name]
        diff = F.col(DIFF) if DIFF in change.columns else F.lit(1)
        # conform() makes a set of rows; the diff must not be lost to it, so it sums what is equal first.
        columns = [c for c in change.columns if c != DIFF]
        summed = change.groupBy(*columns).agg(F.sum(diff).cast("bigint").alias(DIFF))
        kept = conform(summed.select(*columns), decl)
        names = list(decl.names) if set(decl.names) <= set(columns) else columns[: len(decl.columns)]
        if [summed.schema[c].dataType.simpleString() for c in names] == [f.dataType.simpleString() for f in kept.schema]:
            return summed.select(*(F.col(c).alias(f"c{i}") for i, c in enumerate(names)), DIFF)
        parts = [conform(summed.where(F.col(DIFF) == k).select(*columns), decl).withColumn(DIFF, F.lit(k).cast("bigint")) for k in [r[0] for r in summed.select(DIFF).distinct().collect()]]
        out = parts[0] if parts else kept.limit(0).withColumn(DIFF, F.lit(0).cast("bigint"))
        for p in parts[1:]:
            out = out.union(p)
        return out

    def advance(self, changes: dict[str, DataFrame], epoch: int | None = None) -> set[str]:
        """Seal a batch. An epoch that was sealed already is skipped, so a replayed micro-batch does no harm. The relations that changed."""
        with self.lock:
            if epoch is not None and epoch <= self.epoch:
                return set()
            state, dirty = dict(self.state), {}
            for name, change in changes.items():
                if name not in state:
                    raise ValueError(f"{name} isn't an input")
                new = fixpoint.settled(applied(state[name], self.counted(name, change)))
                self.noted(name, present(new), present(state[name]), dirty)
                state[name] = new
            first = not self.frames
            names = {*self.program.decls, *(a.relation for r in self.program.rules for a in r.atoms)}
            old = {**{n: self.evaluator.empty(n) for n in names}, **self.frames}
            done = {**old, **{n: present(s) for n, s in state.items()}}
            for s in self.evaluator.strata:
                reads = {a.relation for i in s.rules for a in self.program.rules[i].atoms} - set(s.heads)
                if not first and not reads & set(dirty) and not set(s.heads) & set(dirty):
                    continue
                new = None
                if not first:
                    new = self.resumed(s, old, done, dirty, reads & set(dirty)) if s.recursive else self.adjusted(s, old, done, dirty)
                if new is None:
                    new = self.evaluator.recursive(s, done) if s.recursive else self.evaluator.plain(s, done)
                    new = {h: fixpoint.settled(df) for h, df in new.items()} if not s.recursive else new
                for h, df in new.items():
                    self.noted(h, df, old[h], dirty)
                done |= new
            # Only now: an epoch that fails leaves all as it was, and can be played again.
            self.epoch, self.state, self.frames = self.epoch + 1 if epoch is None else epoch, state, done
            self.evaluator.release()
            for tell in list(self.listeners):
                tell(self.epoch, done, set(dirty))
            return set(dirty)

    @staticmethod
    def noted(name: str, new: DataFrame, old: DataFrame, dirty: dict[str, DataFrame]) -> None:
        """Enter a relation that changed with its difference."""
        delta = fixpoint.settled(difference(new, old))
        if not delta.isEmpty():
            dirty[name] = delta

    def adjusted(self, s, old: dict[str, DataFrame], done: dict[str, DataFrame], dirty: dict[str, DataFrame]) -> dict[str, DataFrame] | None:
        """A plain relation computed again for the keys only that a changed row takes part in; the rest of it stays.

        Keys are a fold's group, or whole rows. They come from the rules with one
        atom's changed rows, and of the other relations what was or is there.
        None if a negated relation changed, or the fold has no group.
        """
        (name,) = s.heads
        rules = {i: self.program.rules[i] for i in s.rules}
        width = len(self.evaluator.kinds[name]) - (self.evaluator.fold_of(name) is not None)
        if not width or name in self.program.inputs or any(n.relation in dirty for r in rules.values() for n in r.negative):
            return None
        keys = [f"c{k}" for k in range(width)]
        either = {n: old[n].union(done[n]).distinct() if n in dirty else done[n] for n in {a.relation for r in rules.values() for a in r.atoms}}
        met = []
        for i, r in rules.items():
            for k, p in enumerate(r.body):
                if isinstance(p, Atom) and p.relation in dirty:
                    moved = dirty[p.relation].drop(DIFF)
                    met.append(self.evaluator.rows(i, lambda n, at, k=k, moved=moved: moved if at == k else either[n]).select(*keys))
        touched = fixpoint.settled(_union(met).distinct())
        mark = touched.toDF(*(f"k{k}" for k in range(width)))
        same = F.lit(True)
        for k in range(width):
            same = same & F.col(f"c{k}").eqNullSafe(F.col(f"k{k}"))
        again = [positional(self.evaluator.rows(i, lambda n, _: done[n])).join(mark, same, "left_semi") for i in rules]
        fresh = self.evaluator.folded(name, _union(again))
        return {name: fixpoint.settled(positional(old[name]).join(mark, same, "left_anti").union(positional(fresh)))}

    def resumed(self, s, old: dict[str, DataFrame], done: dict[str, DataFrame], dirty: dict[str, DataFrame], changed: set[str]) -> dict[str, DataFrame] | None:
        """A recursive stratum of sets, from its old fixpoint: what rests on rows that went is taken out, put back as far as it follows from the rest, and rows that came are followed up.

        None if a head folds or is an input, or a negated relation changed.
        """
        rules = {i: self.program.rules[i] for i in s.rules}
        heads = set(s.heads)
        if any(self.evaluator.fold_of(h) for h in heads) or any(h in self.program.inputs for h in heads):
            return None
        if any(n.relation in changed for r in rules.values() for n in r.negative):
            return None

        def through(moved: dict[str, DataFrame], at_heads: dict[str, DataFrame], others: dict[str, DataFrame]) -> dict[str, list[DataFrame]]:
            """Each head's rows that need one of the moved rows."""
            out: dict[str, list[DataFrame]] = {h: [] for h in heads}
            for i, r in rules.items():
                for k, p in enumerate(r.body):
                    if isinstance(p, Atom) and not p.negated and p.relation in moved:
                        out[r.head].append(self.evaluator.rows(i, lambda n, at, k=k: moved[n] if at == k else at_heads[n] if n in heads else others[n]))
            return out

        def fresh(made: dict[str, list[DataFrame]], known: dict[str, DataFrame]) -> dict[str, DataFrame]:
            new = {h: fixpoint.settled(fixpoint.changed(_union(parts).distinct(), known[h])) for h, parts in made.items() if parts}
            return {h: df for h, df in new.items() if not df.isEmpty()}

        before = {h: old[h] for h in heads}
        went = {n: dirty[n].where(F.col(DIFF) < 0).drop(DIFF) for n in changed}
        came = {n: dirty[n].where(F.col(DIFF) > 0).drop(DIFF) for n in changed}
        kept, seeds = before, {h: [] for h in heads}
        gone = {h: fixpoint.Growing(self.evaluator.empty(h)) for h in heads}
        wave = fresh(through({n: df for n, df in went.items() if not df.isEmpty()}, before, old), {h: g.frame() for h, g in gone.items()})
        while wave:
            for h, df in wave.items():
                gone[h].add(df)
            wave = fresh(through(wave, before, old), {h: g.frame() for h, g in gone.items()})
        out = {h: g.frame() for h, g in gone.items() if len(g.parts) > 1 or not g.frame().isEmpty()}
        if out:
            kept = {h: fixpoint.settled(fixpoint.changed(df, out[h])) if h in out else df for h, df in before.items()}
            for i, r in rules.items():
                if r.head in out:
                    mark = out[r.head].toDF(*(f"k{k}" for k in range(len(out[r.head].columns))))
                    same = F.lit(True)
                    for k in range(len(mark.columns)):
                        same = same & F.col(f"c{k}").eqNullSafe(F.col(f"k{k}"))
                    seeds[r.head].append(positional(self.evaluator.rows(i, lambda n, _: kept[n] if n in heads else done[n])).join(mark, same, "left_semi"))
        for h, parts in through(came, kept, done).items():
            seeds[h] += parts
        held = {h: fixpoint.Growing(df) for h, df in kept.items()}
        delta = fresh(seeds, kept)
        for _ in range(self.evaluator.rounds):
            if not delta:
                break
            for h, df in delta.items():
                held[h].add(df)
            total = {h: g.frame() for h, g in held.items()}
            delta = fresh(through(delta, total, done), total)
        return {h: fixpoint.settled(g.frame().coalesce(int(self.spark.conf.get("spark.sql.shuffle.partitions")))) for h, g in held.items()}

    def relation(self, name: str) -> DataFrame:
        with self.lock:
            if name not in self.frames:
                self.advance({})
            return named(self.frames[name], self.declared.decls[name])

    def save(self, folder: str) -> str:
        """Write the epoch's input states and results below a shared folder; its name. A marker file, written last, says that all is there."""
        with self.lock:
            at = f"{folder.rstrip('/')}/epoch-{self.epoch:012d}"
            for kind, frames in (("state", self.state), ("frame", self.frames)):
                for name, df in frames.items():
                    df.write.mode("overwrite").parquet(f"{at}/{kind}-{name}")
            rows = [(self.epoch, kind, name) for kind, frames in (("state", self.state), ("frame", self.frames)) for name in frames]
            self.spark.createDataFrame(rows, "epoch long, kind string, name string").coalesce(1).write.mode("overwrite").parquet(f"{at}/sealed")
            return at

    def restore(self, saved: str) -> Maintained:
        """Go on from what save() wrote: batches up to its epoch are skipped when they are played again."""
        rows = self.spark.read.parquet(f"{saved}/sealed").collect()  # a row for each relation
        names = {r["name"] for r in rows if r["kind"] == "state"}
        if names != set(self.program.inputs):
            raise ValueError(f"{saved} has the inputs {sorted(names)}, the program {sorted(self.program.inputs)}")
        with self.lock:
            read = {k: {r["name"]: self.spark.read.parquet(f"{saved}/{k}-{r['name']}") for r in rows if r["kind"] == k} for k in ("state", "frame")}
            self.state, self.frames, self.epoch = read["state"], read["frame"], rows[0]["epoch"]
        return self

    def stream(self, relation: str, frame: DataFrame, checkpoint: str, **trigger):
        """Feed a streaming frame of rows or changes, by foreachBatch; epochs are this stream's batches."""
        return frame.writeStream.foreachBatch(lambda df, batch: self.advance({relation: df})).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = positional(parts[0])
    for p in parts[1:]:
        out = out.union(positional(p))
    return out


__all__ = ["COUNT", "Maintained"]
