"""Exact BM25 top-k by block-max WAND over index segments.

A segment indexes some thousand documents: for each term its postings (from
which a reader makes each document's terms), and for each frequent term the
largest frequency and the shortest document in each block of documents. For a query each block is
bounded by what its rare terms' postings there and the frequent terms' maxima
can add up to; bands of blocks that can't reach the k-th best score so far are skipped,
and of the others only documents that reach it are scored exactly. Weights come
from the whole corpus, so segments' results merge exactly. An eighth of the
segments is searched first; its k-th best scores start the pruning of the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, need, scratch, text_or_empty
from .textbytes import LOWER, release, slices, span_hashes, text_bytes, words

K1, B = 1.2, 0.75
#: A segment has at most so many documents and, unless one has more, words; a block so many documents, a band so many blocks. Terms in a larger share of a segment's documents than one in RARE are frequent.
SEGMENT, WORDS, BLOCK, BAND, RARE = 4096, 2_000_000, 64, 8, 48
#: Frequent terms by which documents are put in order.
LEADING = 64
#: Queries are searched in blocks of at most so many, of at most so many terms unless one has more; in a segment, so many at a time, their rare terms so many.
QUERIES, QUERY_TERMS, BATCH, TURN = 8192, 2_000_000, 512, 32
#: No score is less, but for that of documents without any term.
LEAST = 1e-30
#: One segment in so many is searched first.
FIRST = 8
_FIELDS = {"docs": "<i8", "sizes": "<i4", "terms": "<u8", "starts": "<i8", "post_doc": "<u2", "post_tf": "<i4", "often": "<i4", "most_tf": "<i4", "least_size": "<i4"}


def term_lists(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's term hashes, in order, and the bounds of texts: words by ASCII white space, A-Z as a-z."""
    body, bounds = text_bytes(texts)
    body = LOWER[body]
    starts, ends, before = words(body, bounds)
    return span_hashes(body, starts, ends)[0], before


def build(docs: np.ndarray, term_of: np.ndarray, bounds: np.ndarray) -> dict[str, np.ndarray]:
    """A segment's arrays. Its documents are put in order of the frequent term that each has most, then of length, so that a block's documents are alike and its bounds tight."""
    sizes = np.diff(bounds)
    terms, local = np.unique(term_of, return_inverse=True)
    width = max(len(terms), 1)
    pair, tf = np.unique(np.repeat(np.arange(len(docs)), sizes) * width + local, return_counts=True)
    d, t = pair // width, pair % width
    held = np.bincount(t, minlength=width)
    top = np.full(width, -1)
    commonest = np.argsort(-held, kind="stable")[:LEADING]
    top[commonest] = np.arange(len(commonest))
    leads = np.zeros((len(docs), LEADING + 1), dtype=np.int64)
    some = top[t] >= 0
    leads[d[some], top[t[some]]] = tf[some]
    order = np.lexsort((docs, sizes, leads.argmax(axis=1)))
    place = np.empty(len(docs), dtype=np.int64)
    place[order] = np.arange(len(docs))
    docs, sizes, d = docs[order], sizes[order], place[d]
    by_doc = np.lexsort((t, d))
    d, t, tf = d[by_doc], t[by_doc], tf[by_doc]
    by_term = np.argsort(t, kind="stable")
    starts = np.searchsorted(t[by_term], np.arange(len(terms) + 1))
    often = np.flatnonzero(np.diff(starts) > max(BLOCK, len(docs) // RARE))
    blocks = -(-len(docs) // BLOCK)
    most, least = np.zeros((len(often), blocks), np.int32), np.full((len(often), blocks), 2**31 - 1, np.int32)
    size = starts[often + 1] - starts[often]
    at = by_term[_spans(starts[often], size)]
    cell = np.repeat(np.arange(len(often)), size) * blocks + d[at] // BLOCK  # never falls, as a term's postings are in order
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
    if len(first):
        most.ravel()[cell[first]] = np.maximum.reduceat(tf[at], first)
        least.ravel()[cell[first]] = np.minimum.reduceat(sizes[d[at]], first)
    return {"docs": docs, "sizes": sizes, "terms": terms, "starts": starts, "post_doc": d[by_term], "post_tf": tf[by_term], "often": often, "most_tf": most.ravel(), "least_size": least.ravel()}


@dataclass
class Block:
    """Queries: their ids, the bounds of their terms and, for each term, its place in the block's vocabulary and its weight."""

    ids: np.ndarray
    bounds: np.ndarray
    vocabulary: np.ndarray
    terms: np.ndarray
    weights: np.ndarray


def stored(values: np.ndarray, kind: str) -> bytes:
    """An array's bytes, compressed, behind their number."""
    raw = values.astype(kind).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def loaded(data: pa.Buffer | bytes) -> bytes:
    data = memoryview(data)
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class Segment:
    def __init__(self, row: dict[str, bytes]):
        for name, kind in _FIELDS.items():
            setattr(self, name, np.frombuffer(row[name], dtype=kind))
        self.blocks = -(-len(self.docs) // BLOCK)
        self.most_tf, self.least_size = self.most_tf.reshape(-1, self.blocks), self.least_size.reshape(-1, self.blocks)

    def locate(self, terms: np.ndarray) -> np.ndarray:
        """The places of terms, -1 for those that aren't here."""
        if not len(self.terms):
            return np.full(len(terms), -1)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def prepare(self, mean: float) -> None:
        """Saturated frequencies, which need the corpus' mean size; those of frequent terms as matrices too, one for each band, of the terms that it has."""
        norm = K1 * (1 - B + B * self.sizes / mean)
        self.norm = norm
        by_doc = np.argsort(self.post_doc, kind="stable")
        self.fwd_starts = np.concatenate([[0], np.cumsum(np.bincount(self.post_doc, minlength=len(self.docs)))])
        self.fwd_term = np.repeat(np.arange(len(self.terms), dtype=np.int32), np.diff(self.starts))[by_doc]
        self.fwd_tf = self.post_tf[by_doc]
        self.post_part = self.post_tf * (K1 + 1) / (self.post_tf + norm[self.post_doc])
        top = self.most_tf.astype(np.float64)
        self.block_part = np.where(top > 0, top * (K1 + 1) / (top + K1 * (1 - B + B * self.least_size / mean)), 0.0).astype(np.float32)
        self.row_of = np.full(len(self.terms), -1)
        self.row_of[self.often] = np.arange(len(self.often))
        size = self.starts[self.often + 1] - self.starts[self.often]
        at = _spans(self.starts[self.often], size)
        doc = self.post_doc[at].astype(np.int64)
        row, part = np.repeat(np.arange(len(self.often)), size), self.post_part[at]
        self.bands = []
        for d0 in range(0, self.blocks * BLOCK, BAND * BLOCK):
            some = np.flatnonzero((doc >= d0) & (doc < d0 + BAND * BLOCK))
            rows, place = np.unique(row[some], return_inverse=True)
            band = np.zeros((len(rows), min(BAND * BLOCK, self.blocks * BLOCK - d0)), dtype=np.float32)
            band[place, doc[some] - d0] = part[some]
            self.bands.append((rows, band))
        self.weight = np.zeros(len(self.terms))
        #: Sums of so many single-precision products are off by this share at most.
        self.slack = (len(self.often) + 16) * 2.0**-22

    def rare(self, query: np.ndarray, first: np.ndarray, size: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
        """What rare terms, with those spans of postings and in the order of their queries, add to each document, for n queries."""
        own = np.empty((n, self.blocks * BLOCK), dtype=np.float32)
        for q0 in range(0, n, TURN):
            here = min(TURN, n - q0)
            a, b = np.searchsorted(query, [q0, q0 + here])
            post = _spans(first[a:b], size[a:b])
            cell = np.repeat((query[a:b] - q0) * own.shape[1], size[a:b]) + self.post_doc[post]
            own[q0 : q0 + here] = np.bincount(cell, np.repeat(weights[a:b], size[a:b]) * self.post_part[post], minlength=own[q0 : q0 + here].size).reshape(here, -1)
        return own

    def exact(self, docs: np.ndarray) -> np.ndarray:
        """Scores of documents under the weights that are set, added up in the order of terms."""
        first, size = self.fwd_starts[docs], self.fwd_starts[docs + 1] - self.fwd_starts[docs]
        at = _spans(first, size)
        of = np.repeat(np.arange(len(docs)), size)
        tf = self.fwd_tf[at]
        return np.bincount(of, self.weight[self.fwd_term[at]] * (tf * (K1 + 1) / (tf + self.norm[docs][of])), minlength=len(docs))

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """One query's k best (score, document's place here), ties by id; documents without any of the terms are none."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.search_block(Block(np.zeros(1, np.int64), np.array([0, len(terms)]), terms, np.arange(len(terms)), weights), k, np.zeros(1), out)
        return [(float(x), int(n)) for _, places, scores in out for x, n in zip(scores, places, strict=True)]

    def search_block(self, asked: Block, k: int, least: np.ndarray, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Add to out (query's place, document's place, score) for each query's k best documents here, of those with a score of least or more, ties by id; raise least to the k-th best.

        Queries are taken some at a time. A band of blocks is looked at for
        those queries whose bound in one of them, of its frequent terms' maxima
        and its rare terms' own postings, reaches the k-th best score so far:
        for queries without one first their best band, then the others.
        """
        if not len(self.terms):
            return
        here = self.locate(asked.vocabulary)
        row = np.where(here >= 0, self.row_of[here], -1)
        first = self.starts[here]
        size = np.where((here >= 0) & (row < 0), self.starts[here + 1] - first, 0)
        for q0 in range(0, len(asked.ids), BATCH):
            q1 = min(q0 + BATCH, len(asked.ids))
            n = q1 - q0
            a, b = asked.bounds[q0], asked.bounds[q1]
            query, term, w = np.repeat(np.arange(n), np.diff(asked.bounds[q0 : q1 + 1])), asked.terms[a:b], asked.weights[a:b]
            often = np.flatnonzero(row[term] >= 0)
            rare = np.flatnonzero(size[term])
            if not len(often) and not len(rare):
                continue
            dense = np.zeros((len(self.often), n), dtype=np.float32)
            dense[row[term[often]], query[often]] = w[often]
            own = self.rare(query[rare], first[term[rare]], size[term[rare]], w[rare], n)
            up, down = 1 + 2 * self.slack, 1 - 2 * self.slack
            bound = (dense.T @ self.block_part + own.reshape(n, self.blocks, BLOCK).max(axis=2)).astype(np.float64) * up
            bound = np.maximum.reduceat(bound, np.arange(0, self.blocks, BAND), axis=1)
            floor = least[q0:q1].copy()
            best = np.zeros((n, k))
            foremost = np.where(floor > 0, -1, bound.argmax(axis=1))
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for turn in (True, False):
                for number, (rows, band) in enumerate(self.bands):
                    want = bound[:, number] >= np.maximum(floor, LEAST)
                    want &= (foremost == number) if turn else (foremost != number)
                    some = np.flatnonzero(want)
                    if not len(some):
                        continue
                    d0 = number * BAND * BLOCK
                    if 2 * len(some) > n:
                        about = (dense.take(rows, axis=0).T @ band)[some]
                    else:
                        about = dense[np.ix_(rows, some)].T @ band
                    about += own[some, d0 : d0 + band.shape[1]]
                    better = np.flatnonzero((about >= (np.maximum(floor[some], LEAST) / up).astype(np.float32)[:, None]).any(axis=1))
                    if not len(better):
                        continue
                    some, about = some[better], about[better].astype(np.float64)
                    both = np.concatenate([best[some], about], axis=1)
                    best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                    floor[some] = np.maximum(floor[some], best[some].min(axis=1) * down)
                    r, c = np.nonzero(about * up >= np.maximum(floor[some], LEAST)[:, None])
                    kept.append((some[r], d0 + c, about[r, c]))
            if not kept:
                continue
            q, doc, about = (np.concatenate(x) for x in zip(*kept, strict=True))
            good = (about * up >= floor[q]) & (doc < len(self.docs))
            order = np.argsort(q[good], kind="stable")
            q, doc = q[good][order], doc[good][order]
            cuts = np.searchsorted(q, np.arange(n + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                some = doc[cuts[i] : cuts[i + 1]]
                a, b = asked.bounds[q0 + i], asked.bounds[q0 + i + 1]
                mine = here[asked.terms[a:b]]
                there = mine >= 0
                mine = mine[there]
                self.weight[mine] = asked.weights[a:b][there]
                score = self.exact(some)
                self.weight[mine] = 0
                top = np.lexsort((self.docs[some], -score))[:k]
                top = top[(score[top] >= least[q0 + i]) & (score[top] > 0)]
                if len(top) == k:
                    least[q0 + i] = score[top[-1]]
                out.append((np.full(len(top), q0 + i), some[top], score[top]))


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Segments of at most SEGMENT documents, in compressed binary columns; every row with an id is in one."""
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text"))

    def run(batches):
        part, made_here = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        held: list[np.ndarray] = []

        def flush():
            nonlocal made_here
            made = build(np.array(ids, dtype=np.int64), np.concatenate(held), np.concatenate([[0], np.cumsum([len(t) for t in held])]))
            wave = zlib.crc32(f"{part} {made_here}".encode()) % FIRST
            made_here += 1
            ids.clear()
            held.clear()
            head = [pa.array([wave], type=pa.int32()), pa.array([len(made["docs"])]), pa.array([int(made["sizes"].sum())])]
            return pa.RecordBatch.from_arrays([*head, *(pa.array([stored(made[n], kind)], type=pa.binary()) for n, kind in _FIELDS.items())], ["wave", "n", "words", *_FIELDS])

        size = 0
        for batch in slices(batches, 1):
            terms, bounds = term_lists(batch.column(1))
            for i, a, b in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if ids and (len(ids) >= SEGMENT or size + b - a > WORDS):
                    yield flush()
                    size = 0
                ids.append(i)
                held.append(terms[a:b].copy())
                size += b - a
        if ids:
            yield flush()
        release()

    return rows.mapInArrow(run, "wave int, n long, words long, " + ", ".join(f"{n} binary" for n in _FIELDS))


def query_blocks(queries: DataFrame) -> Iterator[Block]:
    """Blocks of bounded size, without weights; one partition at a time comes to the driver."""

    def run(batches):
        for batch in slices(batches, 1):
            terms, bounds = term_lists(batch.column(1))
            lists = [np.unique(terms[a:b]).view(np.int64) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, type=pa.list_(pa.int64()))], ["id", "terms"])

    rows = scratch(queries.mapInArrow(run, "id long, terms array<long>").where(F.size("terms") > 0), "queries")

    def made(block: list[tuple[int, np.ndarray]]) -> Block:
        vocabulary, place = np.unique(np.concatenate([t for _, t in block]), return_inverse=True)
        return Block(np.array([i for i, _ in block]), np.concatenate([[0], np.cumsum([len(t) for _, t in block])]), vocabulary, place.astype(np.int32), np.zeros(0))

    block, size = [], 0
    for r in rows.toLocalIterator():
        terms = np.array(r["terms"], dtype=np.int64).view(np.uint64)
        if block and (len(block) >= QUERIES or size + len(terms) > QUERY_TERMS):
            yield made(block)
            block, size = [], 0
        block.append((r["id"], terms))
        size += len(terms)
    if block:
        yield made(block)
    drop(rows)


def alike(block: Block, weights: np.ndarray) -> Block:
    """The block under its vocabulary's weights, its queries in order of their commonest term, then of length, so that those taken together meet the same documents."""
    rank = np.empty(len(weights), dtype=np.int64)
    rank[np.argsort(weights, kind="stable")] = np.arange(len(weights))
    size = np.diff(block.bounds)
    order = np.lexsort((size, np.minimum.reduceat(rank[block.terms], block.bounds[:-1])))
    terms = block.terms[_spans(block.bounds[:-1][order], size[order])]
    return Block(block.ids[order], np.concatenate([[0], np.cumsum(size[order])]), block.vocabulary, terms, weights[terms])


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, rank, doc_id, score): for each query, the k documents with the largest BM25 score, exactly; ties to the smaller id.

    A query is its text's different words, and terms are compared by 64-bit
    hashes. Rows without an id, or without words, take no part; a repeated row
    stands for itself, as a document and as a query; a text of any length is
    taken whole. Fewer than k documents with a common word: all of them. Other
    columns are not read. Queries go to every segment in blocks of a bounded
    number of terms, each a pass over the index.
    """
    need(docs, id_col, text_col)
    need(queries, id_col, text_col)
    spark = docs.sparkSession
    segments = scratch(index(docs, id_col, text_col), "segments")
    total, length = segments.agg(F.sum("n"), F.sum("words")).first()
    mean = max((length or 0) / (total or 1), 1e-9)
    asked = queries.where(queries[id_col].isNotNull()).select(queries[id_col].cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "doc_id")
    found = spark.createDataFrame([], "query long, query_id long, doc_id long, score double")
    for number, block in enumerate(query_blocks(asked)):
        block = alike(block, _weights(segments, block.vocabulary, total))
        first = scratch(_hits(segments.where("wave = 0"), block, number, mean, k, np.zeros(len(block.ids))), "hits")
        least = np.zeros(len(block.ids))
        kth = first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") == k).select("query", "score").toArrow()  # a row for each query of the block
        least[kth.column("query").to_numpy() & 0xFFFFFFFF] = kth.column("score").to_numpy()
        found = found.union(first).union(scratch(_hits(segments.where("wave > 0"), block, number, mean, k, least), "hits"))
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    drop(segments)
    return ranked.select("query_id", "rank", "doc_id", "score")


def _weights(segments: DataFrame, vocabulary: np.ndarray, total: int) -> np.ndarray:
    """The inverse document frequencies of a block's terms, over all segments."""
    held = segments.sparkSession.sparkContext.broadcast(vocabulary)  # at most QUERY_TERMS, but for a longer query's own

    def count(batches):
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment.__new__(Segment)
                s.terms, s.starts = np.frombuffer(loaded(row["terms"]), "<u8"), np.frombuffer(loaded(row["starts"]), "<i8")
                at = s.locate(held.value)
                here = np.flatnonzero(at >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(s.starts[at[here] + 1] - s.starts[at[here]])], ["term", "df"])

    df = np.zeros(len(vocabulary))
    seen = segments.select("terms", "starts").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # rows: the block's terms
    df[seen.column("term").to_numpy()] = seen.column("df").to_numpy()
    held.destroy()
    return np.log(1 + (total - df + 0.5) / (df + 0.5))


def _hits(segments: DataFrame, block: Block, number: int, mean: float, k: int, least: np.ndarray) -> DataFrame:
    """(query, query_id, doc_id, score): what may be among the k best of the block's queries, given that they have as good as least already. query is the block's number and the query's place in it."""
    work = segments.sparkSession.sparkContext.broadcast((block, least))  # at most QUERY_TERMS, but for a longer query's own

    def run(batches):
        asked, floor = work.value[0], work.value[1].copy()
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for batch in batches:
            for r in range(batch.num_rows):
                s = Segment({n: loaded(batch.column(n)[r].as_buffer()) for n in _FIELDS})
                s.prepare(mean)
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                s.search_block(asked, k, floor, out)
                if out:
                    q, place, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    q, doc, score = (np.concatenate(x) for x in zip(held, (q, s.docs[place], score), strict=True))
                    order = np.lexsort((doc, -score, q))
                    rank = np.arange(len(q)) - np.searchsorted(q[order], q[order])
                    order = order[rank < k]
                    held = [q[order], doc[order], score[order]]
                    kth = rank[rank < k] == k - 1
                    floor[held[0][kth]] = np.maximum(floor[held[0][kth]], held[2][kth])
                del s
        q, doc, score = held
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q | number << 32), pa.array(asked.ids[q]), pa.array(doc), pa.array(score)], ["query", "query_id", "doc_id", "score"])
        release()

    return segments.select(*_FIELDS).mapInArrow(run, "query long, query_id long, doc_id long, score double")
