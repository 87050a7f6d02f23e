"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors get one more component, so that the nearest by distance have the
largest inner product. Centroids come from balanced k-means on a bounded
sample; a graph over them, searched breadth-limited in memory, finds a vector's
centroids. Every vector is indexed: in its nearest list and, near a boundary,
in others almost as near. Each list is cut into parts by centroids of its own,
so that parts stay small where the table outgrows the centroids that the driver
can hold. Parts are dealt in chunks of a bounded size, so a vector that a third
of all rows share makes many tasks, not one. A query looks into the lists within
a ratio of its nearest, and probes the nearest of their parts, all chunks of
each, exactly. Tables of any size take the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import need, scratch

CHUNK, QUERY_BLOCK = 1024, 1024
REPLICAS, BOUNDARY = 4, 1.12
#: A list's parts have centroids from about so many of its different vectors at most.
PART_SAMPLE = 4096


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1), 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """k-means whose clusters hold at most about twice the mean: larger ones are split, and the smallest go."""
    rng = np.random.default_rng(seed)
    lists = max(1, min(lists, len(x)))
    c = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = squares(x, c).argmin(1)
        size = np.bincount(near, minlength=len(c))
        c = np.stack([x[near == k].mean(0) if size[k] else c[k] for k in range(len(c))])
        for k in np.argsort(size)[::-1]:
            if size[k] <= 2 * len(x) / len(c):
                break
            least = int(size.argmin())
            members = x[near == k]
            if size[least] < size[k] / 4 and (members != members[0]).any():
                c[least] = members[rng.integers(len(members))]
                size[least] = size[k] = size[k] // 2
    return np.unique(c, axis=0)


class CentroidGraph:
    """A graph of each centroid's nearest, searched from one entry for many vectors at once."""

    def __init__(self, centroids: np.ndarray, degree: int = 16):
        self.c = centroids
        n = len(centroids)
        near = np.argsort(squares(centroids, centroids), axis=1, kind="stable")[:, 1 : degree + 1] if n > 1 else np.zeros((n, 0), np.int64)
        ring = np.stack([(np.arange(n) + 1) % n, (np.arange(n) - 1) % n], axis=1)  # keeps it connected
        far = np.random.default_rng(3).integers(0, n, (n, 4))
        self.near = np.concatenate([near, ring, far], axis=1)

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The up to width nearest centroids found for each row, nearest first, and their squared distances."""
        n, rows = len(self.c), len(x)
        width = min(width, n)
        seen = np.zeros((rows, n), dtype=bool)
        start = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))
        ids = np.broadcast_to(start, (rows, len(start))).copy()
        d = squares(x, self.c[start])
        seen[:, start] = True
        open_ = np.ones_like(ids, dtype=bool)
        each = np.arange(rows)
        while True:
            best = np.where(open_, d, np.inf).argmin(1)
            live = open_[each, best]
            if not live.any():
                break
            open_[each, best] = False
            step = self.near[ids[each, best]]
            new = ~seen[each[:, None], step] & live[:, None]
            seen[each[:, None], step] |= live[:, None]
            far = ((x[:, None, :] - self.c[step]) ** 2).sum(2)
            far[~new] = np.inf
            ids, d, open_ = np.concatenate([ids, step], 1), np.concatenate([d, far], 1), np.concatenate([open_, new], 1)
            keep = np.argsort(d, axis=1, kind="stable")[:, : max(width, len(start))]
            ids, d, open_ = np.take_along_axis(ids, keep, 1), np.take_along_axis(d, keep, 1), np.take_along_axis(open_, keep, 1)
            open_ &= np.isfinite(d)
        # One centroid can be in a step twice; the second is further on and equal.
        for j in range(1, ids.shape[1]):
            d[(ids[:, :j] == ids[:, j : j + 1]).any(1), j] = np.inf
        order = np.argsort(d, axis=1, kind="stable")[:, :width]
        return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v): rows with an id and a vector that isn't null or zero and has only finite components, of the commonest dimension; repeated rows once."""
    v = F.transform(vectors[vec_col], lambda x: x.cast("double"))
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (common["n"] if common else 0)).dropDuplicates()


def _parts(posted: DataFrame, asked: DataFrame, lifted, per_list: int, probes: int, least_rows: int) -> tuple[DataFrame, DataFrame]:
    """Postings and probes of the lists' parts: each list is cut into as many as give them per_list different vectors or more on average, one at least.

    A list's parts have centroids of their own, from a bounded sample of its
    vectors; they stay in a table, and meet its rows and the queries that look
    into it by the list. Of the parts of all its lists a query takes the
    nearest, so many, and more until they hold least_rows rows.
    """
    different = posted.select("list", F.xxhash64("v").alias("h")).distinct().groupBy("list").agg(F.count("*").alias("n"))
    some = posted.join(different, "list").where(F.pmod(F.xxhash64("v", F.lit(1)), F.col("n")) < PART_SAMPLE).select("list", "n", "v").dropDuplicates()

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(lifted(np.stack(rows["v"].to_numpy())), axis=0)
        c = balanced_centroids(x, min(int(rows["n"].iloc[0]) // per_list, len(x) // 8))
        return pd.DataFrame({"list": rows["list"].iloc[0], "part": np.arange(len(c)), "c": list(c)})

    parts = scratch(some.groupBy("list").applyInPandas(fit, "list long, part int, c array<double>"), "parts")
    chunks = posted.groupBy("list").agg(F.ceil(F.count("*") / (2 * CHUNK)).cast("int").alias("chunks"))

    def dealt(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"list": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "v": np.zeros(0, object)})
        if not len(rows) or not len(parts):
            return empty
        parts = parts.sort_values("part")
        near = squares(lifted(np.stack(rows["v"].to_numpy())), np.stack(parts["c"].to_numpy())).argmin(1)
        return pd.DataFrame({"list": rows["list"].to_numpy() << 20 | near, "vec_id": rows["vec_id"].to_numpy(), "v": rows["v"].to_numpy()})

    keys = ["list", "chunk"]
    left = posted.join(chunks, "list").select("list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), "vec_id", "v")
    right = parts.join(chunks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "part", "c")
    fine = scratch(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(dealt, "list long, vec_id long, v array<double>"), "postings")
    held = fine.groupBy(F.shiftright("list", 20).alias("list"), F.col("list").bitwiseAND((1 << 20) - 1).cast("int").alias("part")).agg(F.count("*").alias("rows"))
    parts = scratch(parts.join(held, ["list", "part"]), "parts")  # parts that hold nothing go
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))

    def choose(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(parts):
            return pd.DataFrame({"list": np.zeros(0, np.int64), "query_id": np.zeros(0, np.int64), "q": np.zeros(0, object), "d": np.zeros(0), "rows": np.zeros(0, np.int64)})
        parts = parts.sort_values("part")
        q = np.stack(rows["q"].to_numpy())
        d = squares(np.concatenate([q, np.zeros((len(q), 1))], 1), np.stack(parts["c"].to_numpy()))
        order = np.argsort(d, axis=1, kind="stable")
        size = parts["rows"].to_numpy()[order]
        r, j = np.nonzero((np.arange(len(parts)) < probes) | (np.cumsum(size, axis=1) - size < least_rows))
        at = order[r, j]
        return pd.DataFrame({"list": rows["list"].to_numpy()[r] << 20 | parts["part"].to_numpy()[at], "query_id": rows["query_id"].to_numpy()[r], "q": rows["q"].to_numpy()[r], "d": d[r, at], "rows": size[r, j]})

    keys = ["list", "block"]
    left = asked.join(blocks, "list").select("list", F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "q")
    right = parts.join(blocks, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "part", "c", "rows")
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(choose, "list long, query_id long, q array<double>, d double, rows long")
    best = Window.partitionBy("query_id", "q").orderBy("d", "list")
    met = F.sum("rows").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("rows")
    near = near.withColumn("r", F.row_number().over(best)).withColumn("met", met)
    return fine, scratch(near.where((F.col("r") <= probes) | (F.col("met") < least_rows)).select("list", "query_id", "q"), "probes")


def nearest(vectors: DataFrame, k: int = 20, query_every: int = 20, sample: int = 16384, per_list: int = 256, ratio: float = 1.35, least_lists: int = 12, most_lists: int = 48, most_parts: int = 128, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for rows whose id is divisible by query_every the k nearest others by inner product, in double precision.

    Vectors that are null, zero or not finite, and rows without an id, take no
    part, nor do vectors of another dimension than the commonest. Ties go to the
    smaller id. Rows that agree in id and vector count once; different vectors
    of one id are candidates each, with their best score, and as queries they
    share one answer. The index is fitted on at most sample vectors, those whose
    ids hash lowest; it holds every row, and is made and searched in one way at
    every size. No rows, no results; with k others or
    fewer, all are found. Other columns are not read.
    """
    need(vectors, id_col, vec_col)
    spark = vectors.sparkSession
    rows = scratch(usable(vectors, id_col, vec_col), "vectors")
    total, biggest = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = np.array([r[0] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()])

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(biggest - (x * x).sum(1), 0))[:, None]], axis=1)

    graph = CentroidGraph(balanced_centroids(np.unique(lifted(drawn), axis=0), max(1, min(total // per_list, sample // 8))))
    held = spark.sparkContext.broadcast(graph)  # at most sample / 8 centroids

    def assign(batches):
        g = held.value
        for batch in batches:
            x = lifted(np.stack(batch["v"].to_numpy()))
            for a in range(0, len(x), 2048):
                ids, d = g.search(x[a : a + 2048], 32)
                keep = (d[:, :REPLICAS] <= BOUNDARY**2 * d[:, :1] + 1e-12) & np.isfinite(d[:, :REPLICAS])
                r, j = np.nonzero(keep)
                yield pd.DataFrame({"list": ids[r, j], "vec_id": batch["vec_id"].to_numpy()[a + r], "v": batch["v"].to_numpy()[a + r]})

    posted = scratch(rows.mapInPandas(assign, "list long, vec_id long, v array<double>"), "postings")
    sizes = np.zeros(len(graph.c), dtype=np.int64)
    for r in posted.groupBy("list").count().collect():  # as many rows as lists
        sizes[r["list"]] = r["count"]
    plan = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        g, sizes = held.value, plan.value
        for batch in batches:
            x = np.stack(batch["v"].to_numpy())
            for a in range(0, len(x), 2048):
                part = x[a : a + 2048]
                ids, d = g.search(np.concatenate([part, np.zeros((len(part), 1))], 1), max(64, most_lists))
                # Distances beyond the least one possible, as the last component keeps all queries away.
                base = np.maximum(d - np.maximum(biggest + (part * part).sum(1) - 2 * np.sqrt(biggest * (part * part).sum(1)), 0)[:, None], 0)
                met = np.cumsum(np.where(np.isfinite(d), sizes[ids], 0), axis=1) - sizes[ids]
                place = np.arange(ids.shape[1])
                keep = np.isfinite(d) & ((place < least_lists) | (base <= ratio**2 * base[:, :1]) & (place < most_lists) | (met < REPLICAS * (k + 1)))
                r, j = np.nonzero(keep)
                yield pd.DataFrame({"list": ids[r, j], "query_id": batch["vec_id"].to_numpy()[a + r], "q": batch["v"].to_numpy()[a + r]})

    asked = scratch(rows.where(F.col("vec_id") % query_every == 0).mapInPandas(probe, "list long, query_id long, q array<double>"), "probes")
    posted, asked = _parts(posted, asked, lifted, per_list, most_parts, REPLICAS * (k + 1))
    held_by = posted.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / CHUNK)).cast("int").alias("chunks"))
    asked_by = asked.groupBy("list").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / QUERY_BLOCK)).cast("int").alias("blocks"))
    shape = scratch(held_by.join(asked_by, "list"), "lists")
    left = asked.join(shape, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), "blocks").cast("int").alias("block"), "query_id", "q")
    right = posted.join(shape, "list").select("list", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "v")

    def score(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        held = held.sort_values("vec_id")
        x = np.stack(held["v"].to_numpy())
        ids = held["vec_id"].to_numpy()
        _, first, same = np.unique(np.ascontiguousarray(x).view(f"V{x.shape[1] * 8}").ravel(), return_index=True, return_inverse=True)
        copies = np.argsort(same, kind="stable")
        ends = np.cumsum(np.bincount(same))
        q = np.stack(asked["q"].to_numpy())
        own = asked["query_id"].to_numpy()
        u = x[first]
        rough = q @ u.T
        # Every vector within rounding error of the (k + 1)-th best; one of them may be the query itself.
        most = min(len(u), k + 1)
        worst = -np.partition(-rough, most - 1, axis=1)[:, most - 1]
        slack = 8 * q.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(u, axis=1).max()
        out = [[], [], []]
        for i in range(len(q)):
            got: list[tuple[float, int]] = []
            near = np.flatnonzero(rough[i] >= worst[i] - slack[i])
            exact = (q[i] * u[near]).sum(1)
            for j in np.lexsort((ids[first[near]], -exact))[: k + 1]:  # by score and a vector's least id
                a = ends[near[j]]
                b = ends[near[j] - 1] if near[j] else 0
                got += [(-exact[j], int(n)) for n in ids[copies[b : min(a, b + k + 1)]] if n != own[i]]
            got.sort()
            for s, n in got[:k]:
                out[0].append(own[i])
                out[1].append(n)
                out[2].append(-s)
        return pd.DataFrame({"query_id": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})

    keys = ["list", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
