"""Ranked lexical search: every item of a query set against all documents, by bucket scoring over windows of doc_ids.

The query set goes to the documents: its terms are looked up in every text, and an index of those postings alone is written,
a row for each document. The index is dealt out by ranges of doc_id. A task takes WINDOW documents at a time, turns their
postings by term, and for each item adds the scores of its terms into one array of that window (128 KB, which stays in a core's
cache), marks the slots in a bitset, and moves the best of the marked slots into the item's heap. So no document is sorted, no
pair of item and document leaves a task but a heap's, and a task's memory is one window, its queries and their heaps.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _power_tables, mix, small_batches, stored

#: Terms are runs of digits, letters and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
#: Documents of a window.
WINDOW = 1 << 14
#: Terms of all items of one pass over the documents; larger query sets take several.
BLOCK_TERMS = 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_IN = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _IN[_low:_high] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SLICE = 1 << 21


def _utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a batch of texts and the rows' offsets in them; null is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8) if n and texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw, offsets


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a batch at rows' ends into pieces of about _SLICE bytes, and a longer row at a byte that is in no term."""
    at, stop = int(offsets[0]), int(offsets[-1])
    while at < stop:
        end = min(at + _SLICE, stop)
        if end < stop:
            row_end = int(offsets[np.searchsorted(offsets, end, "right") - 1])
            if row_end > at:
                end = row_end
            else:
                row_end, step = int(offsets[np.searchsorted(offsets, at, "right")]), end
                while step < row_end and _IN[raw[step]]:
                    step += 1
                end = step
        yield at, end
        at = end


def _terms(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a batch: its lower-cased bytes, and the begin, end and hash of its terms."""
    for at, end in _pieces(raw, offsets):
        data = raw[at:end]
        inside = _IN[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = offsets[(offsets > at) & (offsets < end)] - at
        first[cut] = inside[cut]
        last[cut - 1] = inside[cut - 1]
        begin, stop = np.flatnonzero(first), np.flatnonzero(last) + 1
        data = _FOLD[data]
        power, inverse = _power_tables(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
        yield data, begin, stop, mix((total[stop] - total[begin]) * inverse[begin]), np.searchsorted(offsets, begin + at, "right") - 1


class _Query:
    """The terms of a block of items as arrays: sorted hashes, their bytes, and each item's term numbers."""

    @staticmethod
    def arrays(items: list[list[str]]) -> dict[str, np.ndarray]:
        words = sorted({t for terms in items for t in terms})
        coded = [w.encode() for w in words]
        lengths = np.array([len(c) for c in coded], np.int64)
        raw, offsets = np.frombuffer(b"".join(coded), np.uint8), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        found = [h for _, _, _, h, _ in _terms(raw, offsets)]
        h = np.concatenate(found) if found else np.zeros(0, np.uint64)
        number = {w: i for i, w in enumerate(words)}
        order = np.argsort(h, kind="stable")
        return {
            "hash": h[order], "number": order.astype(np.int32), "raw": raw, "offsets": offsets,
            "terms": np.array([number[t] for terms in items for t in terms], np.int32), "ends": np.cumsum([0] + [len(t) for t in items]).astype(np.int64)}


def _same_bytes(data: np.ndarray, begin: np.ndarray, stop: np.ndarray, q: dict[str, np.ndarray], term: np.ndarray) -> np.ndarray:
    """Whether each word is its term byte for byte."""
    length = stop - begin
    ok = length == q["offsets"][term + 1] - q["offsets"][term]
    b, t, n = begin[ok], term[ok], length[ok]
    if len(b):
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(int(n.sum()))
        equal = data[at + np.repeat(b - start, n)] == q["raw"][at + np.repeat(q["offsets"][t] - start, n)]
        ok[np.flatnonzero(ok)] = np.logical_and.reduceat(equal, start)
    return ok


_INDEX = "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"


def _postings(documents: DataFrame, shared) -> DataFrame:
    """A row for each document: its number of terms, and which of the query's terms it has how often. Other terms leave no trace."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for b in batches:
            raw, offsets = _utf8(b.column(1))
            counts = np.zeros(b.num_rows, np.int64)
            rows, terms = [], []
            for data, begin, stop, h, row in _terms(raw, offsets):
                counts += np.bincount(row, minlength=b.num_rows)
                if not len(q["hash"]):
                    continue
                place = np.minimum(np.searchsorted(q["hash"], h), len(q["hash"]) - 1)
                hit = np.flatnonzero(q["hash"][place] == h)
                term = q["number"][place[hit]]
                same = _same_bytes(data, begin[hit], stop[hit], q, term)
                rows.append(row[hit][same])
                terms.append(term[same])
            width = len(q["hash"]) + 1
            key, tf = np.unique(np.concatenate(rows) * width + np.concatenate(terms), return_counts=True) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            ends = np.searchsorted(key, np.arange(b.num_rows + 1) * width).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts), pa.ListArray.from_arrays(pa.array(ends), pa.array((key % width).astype(np.int32))), pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))],
                ["doc_id", "n", "terms", "tfs"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _INDEX)


class _Scorer:
    """Scores windows of documents for all items of a block and keeps each item's best; documents come in ascending order."""

    def __init__(self, q: dict[str, np.ndarray], weight: np.ndarray, total: int, length: int, top: int):
        self.q, self.weight, self.total, self.length, self.top = q, weight, total, length, top
        self.heaps: list[list[tuple[int, int, int | None]]] = [[] for _ in range(len(q["ends"]) - 1)]
        self.sums, self.bits = np.zeros(WINDOW, np.int64), np.zeros(WINDOW // 64, np.uint64)
        self.seen = 0

    def window(self, ids: list[int | None], n: np.ndarray, ends: np.ndarray, terms: np.ndarray, tf: np.ndarray) -> None:
        slot = np.repeat(np.arange(len(n)), np.diff(ends))
        m = 10 + (90 * n * self.total) // self.length
        gain = self.weight[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[slot]))
        by_term = np.argsort(terms, kind="stable")
        slot, gain = slot[by_term], gain[by_term]
        bounds = np.searchsorted(terms[by_term], np.arange(len(self.weight) + 1))
        bit, word = np.uint64(1) << (slot & 63).astype(np.uint64), slot >> 6
        sums, bits = self.sums, self.bits
        for item, heap in enumerate(self.heaps):
            own = self.q["terms"][self.q["ends"][item] : self.q["ends"][item + 1]]
            start, size = bounds[own], bounds[own + 1] - bounds[own]
            at = np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)
            if not len(at):
                continue
            np.add.at(sums, slot[at], gain[at])
            np.bitwise_or.at(bits, word[at], bit[at])
            marked = np.flatnonzero(bits)
            hit = np.flatnonzero(np.unpackbits(bits[marked].view(np.uint8), bitorder="little"))
            hit = marked[hit >> 6] * 64 + (hit & 63)
            score = sums[hit]
            sums[hit] = 0
            bits[marked] = 0
            better = score > (heap[0][0] if len(heap) == self.top else 0)
            hit, score = hit[better], score[better]
            for k in np.lexsort((hit, -score))[: self.top]:
                entry = (int(score[k]), -(self.seen + int(hit[k])), ids[hit[k]])
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                elif entry[:2] > heap[0][:2]:
                    heapq.heapreplace(heap, entry)
        self.seen += len(n)


def _scored(index: DataFrame, shared, weight: np.ndarray, total: int, length: int, top: int) -> DataFrame:
    """(item, doc_id, score): the best of each task for each item, item by its number in the block."""
    weights = index.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value, weights.value, total, length, top)

        def score(t: pa.Table) -> None:
            t = t.combine_chunks()
            lists = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (t.column(2), t.column(3))]
            ends = np.concatenate([[0], np.cumsum(lists[0].value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
            scorer.window(t.column(0).to_pylist(), t.column(1).to_numpy(), ends, lists[0].flatten().to_numpy(), lists[1].flatten().to_numpy())

        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            while b.num_rows:
                part = b.slice(0, WINDOW - rows)
                b = b.slice(part.num_rows)
                held.append(part)
                rows += part.num_rows
                if rows == WINDOW:
                    score(pa.Table.from_batches(held))
                    held, rows = [], 0
        if rows:
            score(pa.Table.from_batches(held))
        found = [(i, d, s) for i, heap in enumerate(scorer.heaps) for s, _, d in heap]
        for at in range(0, len(found), 10_000):
            item, doc, value = zip(*found[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(value, pa.int64())], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id bigint, score bigint")


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The top documents of each item: item_id, rank, doc_id, score, from documents (doc_id, text) and items (item_id, text).

    Scores are whole numbers as BM25 makes them: a term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's length
    enters as m = 10 + 90 n N div L, and a term adds weight * (10^9 tf div (1000 tf + 8 m)). They fit 64 bits while n N is below
    10^17. Equal scores are ranked by ascending doc_id, null last. Whole texts of any length are read, null has no terms; rows
    that repeat a doc_id or a text are documents each. Items that share an item_id, null too, are one with the terms of all;
    items without terms, and those that no document matches, have no rows; so do empty tables. Other columns are ignored.
    """
    spark = documents.sparkSession
    small_batches(spark)
    terms = F.regexp_extract_all(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    wanted = stored(items.select("item_id", F.explode(terms).alias("term")).distinct(), "query-terms")
    blocks = -(-wanted.count() // BLOCK_TERMS) or 1
    found = None
    for block in range(blocks):
        # a block's terms, about BLOCK_TERMS, are all that reaches the driver
        own = wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
        rows = own.orderBy("item_id").collect()
        if not rows:
            continue
        query = _Query.arrays([r.terms for r in rows])
        shared = spark.sparkContext.broadcast(query)
        index = stored(_postings(documents, shared), "postings")
        size = index.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        if not size.total:
            continue
        holding = np.zeros(len(query["hash"]), np.int64)
        counted = index.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).toPandas()
        holding[counted["term"]] = counted["df"]
        weight = np.floor(1000 * np.log((2 * size.total + 2) / (2 * holding + 1))).astype(np.int64)
        # rows that share a doc_id, or have none, are spread by their length
        in_order = index.where(F.size("terms") > 0).repartitionByRange(F.col("doc_id").asc_nulls_last(), F.xxhash64("n", "terms")).sortWithinPartitions(F.col("doc_id").asc_nulls_last())
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = _scored(in_order, shared, weight, size.total, size.length, top).join(F.broadcast(ids), "item").drop("item")
        found = best if found is None else found.unionByName(best)
    if found is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id bigint, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
