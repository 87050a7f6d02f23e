"""Exact Jaccard join of documents' shingle sets, by a grouped prefix join.

Shingles are ordered by how many documents have them, the rarest first, counted
exactly over the whole corpus. Two sets whose Jaccard similarity reaches the
threshold share a shingle in their prefixes, their first shingles in that order.
Equal sets are one set; sets with the same prefix and size make a group, which is
in the prefix join once. A shingle that one document alone has is in no list, so
most documents bring nothing to the join.

Groups that share a shingle are filtered as pairs, by their sizes and by what
can follow the shared places, then expanded to their members and verified. This
is done in two rounds. In the first each group meets one hub in each of its
lists, and the members of a group its first: families of near copies become
components in linear time. In the second all pairs of groups meet but those
whose members are all in one component already, where no link changes anything.

Counting goes over shuffles of compressed runs, not of rows: a task packs the
shingles of a slice of documents by ranges of their hashes, a range's task counts
them over all slices and answers with those that two documents have at least,
and a slice's task then orders its documents' shingles.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, need, scratch, split_by, text_or_empty
from .components import connected
from .textbytes import LOWER, mixed, packed, release, slices, span_hashes, text_bytes, unpacked, words

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: A slice has at most 2^SLICE_BITS documents and, unless one has more, SLICE_SHINGLES shingles.
SLICE_BITS, SLICE_SHINGLES = 12, 1_000_000
#: Bytes of text for each range of hashes, so that a range's shingles fit a task.
RANGE_BYTES = 8_000_000
#: Bits of the filter for each wanted document, and its size in bits at most (32 MB).
FILTER_SHARE, FILTER_BITS = 16, 28
_LAST = 2**63 - 1  # stands for a null id


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Each text's sorted different hashes of n-word shingles; a shorter text is one shingle, one without words none."""
    body, bounds = text_bytes(texts)
    body = LOWER[body]
    starts, ends, before = words(body, bounds)
    word = span_hashes(body, starts, ends)[0]
    h = word
    for k in range(1, n):
        h = mixed(h[: len(word) - k] * _A + word[k:]) if len(word) > k else h[:0]
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= n:
            s = np.sort(h[a : b - n + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        else:
            one = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                one = mixed(one * _A + w)
            out.append(one[: b > a])
    return out


def prefix_length(n, percent: int):
    return n - -(-percent * n // 100) + (n > 0)


_HEAD = np.dtype([("doc", "<i8"), ("size", "<i4"), ("one", "<i8"), ("two", "<i8")])
_RUNS = "range long, slice long, n int, head binary, run binary"


def _slice_runs(texts: DataFrame, n: int, bits: int) -> DataFrame:
    """Rows (range, slice, n, head, run): a run has the shingles of a slice in a range of hashes, each with its document's place; a slice's head, its documents, goes along with one."""
    token = 64 - min(52, bits + 32)

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        docs: list[int] = []
        sets: list[np.ndarray] = []

        def flush():
            nonlocal made
            name = part << 32 | made
            made += 1
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            h = np.concatenate(sets)
            head = np.zeros(len(docs), dtype=_HEAD)
            head["doc"], head["size"] = docs, sizes
            before = np.concatenate([[0], np.cumsum(sizes)])
            for field, salt in (("one", _A), ("two", _B)):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(h ^ salt), dtype=np.uint64)])
                head[field] = (total[before[1:]] - total[before[:-1]]).view(np.int64)
            h = np.sort((h >> np.uint64(token)) << np.uint64(SLICE_BITS) | np.repeat(np.arange(len(docs), dtype=np.uint64), sizes))
            ranges = (h >> np.uint64(64 - token + SLICE_BITS - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.concatenate([[True], ranges[1:] != ranges[:-1], [True]])) if len(h) else np.zeros(1, np.int64)
            rows = [(int(ranges[a]), name, int(b - a), None, packed(h[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            rows.append((name % (1 << bits), name, 0, head.tobytes(), None))
            docs.clear()
            sets.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["range", "slice", "n", "head", "run"])

        held = 0
        for batch in slices(batches, 1):
            for doc, s in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), n), strict=True):
                if docs and (held + len(s) > SLICE_SHINGLES or len(docs) >> SLICE_BITS):
                    yield flush()
                    held = 0
                docs.append(doc)
                sets.append(s)
                held += len(s)
        if docs:
            yield flush()
        release()

    return texts.mapInArrow(run, _RUNS)


def _counted(table: pa.Table) -> pa.Table:
    """Of the runs of one range: for each slice, those shingles that two documents have at least, and their counts."""
    names, sizes = table["slice"].to_pylist(), table["n"].to_pylist()
    some = [i for i, n in enumerate(sizes) if n]
    rows = [(names[i], 0, head, None, None) for i, head in enumerate(table["head"].to_pylist()) if head is not None]
    if some:
        runs = table["run"]
        every = np.concatenate([unpacked(runs[i].as_py(), sizes[i]) for i in some])
        token = every >> np.uint64(SLICE_BITS)
        order = np.argsort(token, kind="stable")
        fresh = np.flatnonzero(np.concatenate([[True], np.diff(token[order]) > 0]))
        counts = np.diff(np.append(fresh, len(order)))
        of = np.empty(len(every), dtype=np.uint32)
        of[order] = np.repeat(np.minimum(counts, 2**32 - 1), counts)
        a = 0
        for i in some:
            b = a + sizes[i]
            often = of[a:b] > 1
            if often.any():
                planes = np.ascontiguousarray(of[a:b][often].view(np.uint8).reshape(-1, 4).T)
                rows.append((names[i], int(often.sum()), None, packed(every[a:b][often]), pa.compress(planes.tobytes(), "zstd", asbytes=True)))
            a = b
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    return pa.table([pa.array(c, type=t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["slice", "n", "head", "run", "counts"])


def _ordered(percent: int):
    """Of a slice's head and answers, a row for each document: its set's fingerprint, and those shingles of its prefix that others have too, with the first's place."""

    def run(table: pa.Table) -> pa.Table:
        sizes = table["n"].to_pylist()
        head = np.frombuffer(next(h for h in table["head"].to_pylist() if h is not None), dtype=_HEAD)
        some = [i for i, n in enumerate(sizes) if n]
        every = np.concatenate([np.zeros(0, np.uint64), *(unpacked(table["run"][i].as_py(), sizes[i]) for i in some)])
        planes = [np.frombuffer(pa.decompress(table["counts"][i].as_py(), 4 * sizes[i], "zstd", asbytes=True), np.uint8).reshape(4, -1) for i in some]
        counts = np.concatenate([np.zeros(0, np.uint32), *(np.ascontiguousarray(p.T).view(np.uint32).ravel() for p in planes)])
        doc, token = (every & np.uint64((1 << SLICE_BITS) - 1)).astype(np.int64), every >> np.uint64(SLICE_BITS)
        shared = np.bincount(doc, minlength=len(head))
        alone = head["size"] - shared
        room = np.maximum(prefix_length(head["size"].astype(np.int64), percent) - alone, 0)
        order = np.lexsort((token, counts, doc))
        doc, token = doc[order], token[order]
        rank = np.arange(len(doc)) - (np.cumsum(shared) - shared)[doc]
        keep = rank < room[doc]
        doc, token = doc[keep], token[keep].view(np.int64)
        bounds = np.concatenate([[0], np.cumsum(np.minimum(room, shared))])
        prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(token.view(np.uint64) + _A), dtype=np.uint64)])
        own = np.where(alone > 0, head["one"].view(np.uint64), prefix[bounds[1:]] - prefix[bounds[:-1]])
        group = mixed(own + mixed(head["size"].astype(np.uint64) * np.uint64(2) + (alone > 0))).view(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(token))
        return pa.table([pa.array(head["doc"]), pa.array(head["size"]), pa.array(head["one"]), pa.array(head["two"]), pa.array(group), pa.array(alone.astype(np.int32)), lists], names=["doc", "size", "one", "two", "grp", "alone", "prefix"])

    return run


def prefixes(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(doc, size, one, two, grp, alone, prefix) for each row of (doc, text).

    one and two are a fingerprint of the set in 128 bits. alone: how many of its
    shingles nobody else has; they come first in the order, and prefix has what
    follows them within the prefix. Hashes are cut to some 40 bits or more here,
    and shingles whose hashes agree in those count as one: that makes some
    commoner than they are, and changes no result.
    """
    spark = texts.sparkSession
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / RANGE_BYTES))
    bits = min(24, max(1, math.ceil(math.log2(ranges))))
    answers = _slice_runs(texts, n, bits).groupBy("range").applyInArrow(_counted, "slice long, n int, head binary, run binary, counts binary")
    return answers.groupBy("slice").applyInArrow(_ordered(percent), "doc long, size int, one long, two long, grp long, alone int, prefix array<long>")


def _arrays(texts: DataFrame, n: int, wanted: DataFrame) -> DataFrame:
    """The whole shingle sets of wanted documents (rep); a filter passes these and few others.

    Rows that share an id each bring theirs: pairs are then compared for all.
    """
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(FILTER_SHARE * max(1, wanted.count())))))
    bit = F.pmod(F.xxhash64("rep"), F.lit(1 << bits))
    rows = wanted.select(bit.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), dtype=np.int64)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(table)  # at most 32 MB, by FILTER_BITS
    flagged = texts.withColumn("bit", F.pmod(F.xxhash64("doc"), F.lit(1 << bits)))

    def run(batches):
        table = held.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((table[bit >> 6] >> (bit & 63)) & 1 == 1))
            for part in slices([batch], 1):
                sets = shingle_sets(part.column(1), n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]), type=pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["rep", "shingles"])

    return flagged.select("doc", "text", "bit").mapInArrow(run, "rep long, shingles array<long>").join(wanted, "rep", "left_semi")


def _may_link(percent: int, na: str, i: str, nb: str, j: str):
    """Whether sets of these sizes can reach the threshold if the first shingle that they share is at i in one and at j in the other.

    What follows it in either is all that they can share.
    """
    fits = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    return fits & (F.least(F.col(na) - F.col(i), F.col(nb) - F.col(j)) * (100 + percent) >= percent * (F.col(na) + F.col(nb)))


def _linked(texts: DataFrame, n: int, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets' similarity reaches the threshold, counted exactly."""
    if pairs.isEmpty():
        return pairs
    arrays = scratch(_arrays(texts, n, pairs.select(F.col("a").alias("rep")).union(pairs.select("b")).distinct()), "arrays")
    one = arrays.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    two = arrays.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    both = pairs.join(one, "b").join(two, "a").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = []
            for i in range(batch.num_rows):
                x, y = left[i].values.to_numpy(), right[i].values.to_numpy()
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select([0, 1]).filter(pa.array(good, type=pa.bool_()))
        release()

    links = scratch(both.mapInArrow(run, "a long, b long").distinct(), "links")
    drop(arrays)
    return links


def components(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """Every row's (doc_id, n_shingles, component_id): the smallest doc_id that links reach, its own included.

    A-Z count as a-z; words are parted by ASCII white space. Two documents link
    when 100 * common shingles >= percent * shingles of either. Null or empty
    text has no shingles and links with nothing; texts of any length are taken
    whole. Rows with one doc_id are one document, whose links are those of all
    its rows; null ids are one document, whose component is null if it holds no
    other. Other columns are not read. No rows give no rows.
    """
    need(docs, "doc_id", "text")
    texts = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(_LAST)).alias("doc"), text_or_empty().alias("text"))
    found = scratch(prefixes(texts, n, percent), "prefixes")
    key = ["size", "one", "two"]
    sets = scratch(found.where("size > 0").groupBy(*key).agg(F.min("doc").alias("rep"), F.first("grp").alias("grp"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix")), "sets")
    groups = sets.groupBy("grp").agg(F.min("rep").alias("rep"), F.first("size").alias("size"), F.first("alone").alias("alone"), F.first("prefix").alias("prefix"), F.count("*").alias("n"))
    tokens = groups.select("grp", "rep", "size", "n", "alone", F.posexplode("prefix").alias("k", "token")).withColumn("pos", F.col("alone") + F.col("k"))
    shared = tokens.groupBy("token").agg(F.sum("n").alias("members"), F.min(F.struct("rep", "size", "pos")).alias("hub")).where("members > 1").drop("members")
    lists = scratch(tokens.join(shared, "token").select("token", "pos", "grp", "rep", "size", F.col("hub.rep").alias("hub"), F.col("hub.size").alias("nh"), F.col("hub.pos").alias("ph")), "lists")
    members = scratch(lists.select("grp", F.col("rep").alias("first")).distinct().join(sets.select("grp", "rep"), "grp").select("grp", "first", "rep"), "members")
    stars = lists.where(F.col("rep") != F.col("hub")).where(_may_link(percent, "size", "pos", "nh", "ph")).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    inner = members.where("first <> rep").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    near = scratch(stars.union(inner), "pairs")
    links = _linked(texts, n, near, percent)
    first = connected(links)
    placed = scratch(members.join(first, members["rep"] == first["node"], "left").select("grp", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    rest = _open_pairs(lists, placed, percent)
    more = _linked(texts, n, rest, percent)
    added = scratch(more.union(_same_document(found, sets)), "added")
    label = first if added.isEmpty() else connected(links.union(added))
    own = found.join(sets.select(*key, "rep"), key, "left").select("doc", "size", F.coalesce("rep", "doc").alias("rep"))
    out = scratch(own.join(label, own["rep"] == label["node"], "left").select("doc", "size", F.coalesce("component", "rep").alias("c")), "labelled")
    drop(found, sets, lists, members, near, links, first, placed, rest, more, added, label)
    null = lambda c: F.when(F.col(c) != _LAST, F.col(c))
    return out.select(null("doc").cast(docs.schema["doc_id"].dataType).alias("doc_id"), F.col("size").cast("long").alias("n_shingles"), null("c").alias("component_id"))


def _open_pairs(lists: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components, from the pairs of groups that may link.

    In each list, of the component that has most of its groups none is compared
    with another of its own; a group whose members are in several components is
    compared with all, and within itself.
    """
    state = scratch(placed.groupBy("grp").agg(F.min("c").alias("c"), (F.min("c") != F.max("c")).alias("several")), "states")
    rows = scratch(lists.select("token", "pos", "grp", "size").join(state, "grp"), "rows")
    by = rows.groupBy("token", "c").agg(F.count("*").alias("k"), F.max("several").alias("s"))
    most = by.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("most"), F.count("*").alias("parts"), F.max("s").alias("s")).where("parts > 1 or s")
    open_rows = scratch(rows.join(most.select("token", "most"), "token"), "open")
    x = open_rows.where("c <> most or several").select("token", F.col("pos").alias("i"), F.col("grp").alias("x"), F.col("size").alias("nx"), F.col("c").alias("cx"), F.col("several").alias("vx"))
    y = open_rows.select("token", F.col("pos").alias("j"), F.col("grp").alias("y"), F.col("size").alias("ny"), F.col("c").alias("cy"), F.col("several").alias("vy"), "most")
    seen = F.expr("cy = most and not vy")  # this y is no x, so the pair comes once
    differ = (F.col("x") != F.col("y")) & (F.col("vx") | F.col("vy") | (F.col("cx") != F.col("cy"))) & (seen | (F.col("x") < F.col("y")))
    met = x.join(y, "token").where(differ & _may_link(percent, "nx", "i", "ny", "j")).select(F.least("x", "y").alias("g"), F.greatest("x", "y").alias("h"))
    met = scratch(met.union(state.where("several").select(F.col("grp").alias("g"), F.col("grp").alias("h"))).distinct(), "met")
    one = placed.select(F.col("grp").alias("g"), F.col("rep").alias("a"), F.col("c").alias("ca"))
    two = placed.select(F.col("grp").alias("h"), F.col("rep").alias("b"), F.col("c").alias("cb"))
    pairs = scratch(met.join(one, "g").join(two, "h").where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "expanded")
    drop(state, rows, open_rows, met)
    return pairs


def _same_document(found: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between the sets of rows that share an id, from the second set on to the first."""
    rows = found.where("size > 0").select("doc", "size", "one", "two").distinct()
    twice = rows.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(twice, "doc", "left_semi").join(sets.select("size", "one", "two", "rep"), ["size", "one", "two"]).select(F.col("doc").alias("a"), F.col("rep").alias("b"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs whose doc_id is their component's smallest; rows without an id stay, as do repeated rows of a kept id. Edge cases as in components; no rows give no rows."""
    gone = scratch(components(docs, n, percent).where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    some, others = split_by(docs, docs["doc_id"], gone)
    return others.union(some.join(gone, some["doc_id"] == gone["gone"], "left_anti"))
