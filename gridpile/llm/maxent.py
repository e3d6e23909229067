"""A hashed maximum-entropy language model: softmax over word classes on n-gram and skip features, then the word in its class.

log P(token) = log P(class | history) + log P(word | class, history). The first factor is a softmax over CLASSES weights summed
from hashed features of the three tokens before. The second is, in the classes of the TOP commonest words, a softmax over the
class's words on the word itself and the class of the token before; in the others, whose words are rare, the word's share of
its class. Words that training has not seen have a part of those classes, which is spread over the number of such words as
estimated from words seen once and twice, so an unseen word has a probability as a known one has. All factors sum to one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored, text_or_empty, word_hashes

CLASSES = 32
#: The commonest words, for which classes are learned one by one; those with a class of their own; word clusters; the rest are classes of word endings.
TOP, SINGLES, CLUSTERS = 8192, 10, 10
#: Words whose counts every task has; the counts of all other words are joined.
HEAD = 65_536
ANCHORS = 24
_WORD_CELLS = 8192
_PAIR = CLASSES + 1
#: Features: bias, word before, word before that (skip), classes of both, classes of the first and third before (skip).
_BASES = np.cumsum([0, 1, _WORD_CELLS, _WORD_CELLS, _PAIR * _PAIR, _PAIR * _PAIR])
CELLS = int(_BASES[-1])
#: Below them in the table of weights: of each top word after each class, _PAIR x TOP numbers in rows of CLASSES.
ROWS = CELLS + _PAIR * TOP // CLASSES
BLOCK = 256
#: Tasks' updates are summed by a tree: FAN rows to a group, LEVELS levels.
FAN, LEVELS = 64, 3
BATCH = 16_384
RATE = 0.15
ROUNDS = 2
_END = np.uint64(0xE17D_0000_0000_0000)
_BEGIN = np.uint64(0xBE61_0000_0000_0000)
_SLICE_ROWS = 512


def held_out():
    """Documents whose crc32(doc_id as text) mod 7 is 2 are not learned from (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word ids of all rows, each row closed by one end token, and the rows' offsets."""
    h, offsets = word_hashes(texts, lower=True, suffixes=True)
    n = len(offsets) - 1
    out = np.full(len(h) + n, _END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(offsets))] = h
    return out, offsets + np.arange(n + 1)


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches of some 1 MB of text, or one row, with their tokens."""
    for b in batches:
        at = 0
        while at < b.num_rows:
            size = np.cumsum([x or 0 for x in pa.compute.binary_length(b.column(column).slice(at, _SLICE_ROWS)).to_pylist()])
            part = b.slice(at, max(1, int(np.searchsorted(size, 1 << 20))))
            at += part.num_rows
            yield part, *tokens(part.column(column))


@dataclass
class Vocabulary:
    """Bounded tables: the top and head words with counts, and the classes. ids are sorted."""

    n: int
    v: int
    top: np.ndarray
    top_class: np.ndarray
    cell_class: np.ndarray
    head: np.ndarray
    head_count: np.ndarray
    head_log: np.ndarray  # log10 P(word | class) of head words
    known_log: np.ndarray  # by ending: what log10(count) of another known word needs to become log10 P(word | class)
    unknown_log: np.ndarray  # by ending: log10 P(one unseen word | class)
    unseen: np.ndarray  # by class: how many words of it training is taken not to have seen
    top_log: np.ndarray  # log P(word | class) of top words, in the order of top
    class_share: np.ndarray

    def classes(self, ids: np.ndarray) -> np.ndarray:
        return _lookup(ids, self.top, self.top_class, self.cell_class[(ids & np.uint64(0xFF)).astype(np.int64)])

    def places(self, ids: np.ndarray) -> np.ndarray:
        """Where ids are among the top words, -1 for others."""
        return _lookup(ids, self.top, np.arange(len(self.top)), np.full(len(ids), -1))

    def word_logs(self, w: np.ndarray) -> np.ndarray:
        """(class before, top word): log P(word | its class, class before), from the weights."""
        z = w[CELLS:].reshape(_PAIR, TOP)[:, : len(self.top)].astype(np.float64) + self.top_log
        order = np.argsort(self.top_class, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(self.top_class[order]) > 0])) if len(order) else np.zeros(0, np.int64)
        if len(order):
            total = np.add.reduceat(np.exp(z[:, order]), first, axis=1)
            z[:, order] -= np.repeat(np.log(total), np.diff(np.append(first, len(order))), axis=1)
        return z


def _lookup(ids: np.ndarray, keys: np.ndarray, values: np.ndarray, otherwise: np.ndarray) -> np.ndarray:
    if not len(keys):
        return otherwise
    at = np.searchsorted(keys, ids)
    at[at == len(keys)] = 0
    return np.where(keys[at] == ids, values[at], otherwise)


def count_words(docs: DataFrame) -> DataFrame:
    """(id, c) of all tokens of the training documents, counted in the tasks before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(c.astype(np.int64))], ["id", "c"])

        for _, ids, _ in _slices(batches, 0):
            held.append(ids)
            size += len(ids)
            if size > 4_000_000:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return docs.where(~F.col("held_out")).select("text").mapInArrow(run, "id bigint, c bigint").groupBy("id").agg(F.sum("c").alias("c"))


def _cluster(profiles: np.ndarray, weights: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """k-means on a bounded table; returns each row's cluster."""
    if len(profiles) <= k:
        return np.arange(len(profiles))
    rng = np.random.default_rng(seed)
    centres = profiles[[int(np.argmax(weights))]]
    for _ in range(k - 1):
        d = np.min(((profiles[:, None] - centres[None]) ** 2).sum(2), 1) * weights
        centres = np.concatenate([centres, profiles[[int(rng.choice(len(d), p=d / d.sum())) if d.sum() > 0 else 0]]])
    label = np.zeros(len(profiles), np.int64)
    for _ in range(15):
        label = ((profiles[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        for j in range(k):
            own = label == j
            if own.any():
                centres[j] = np.average(profiles[own], axis=0, weights=weights[own] + 1e-9)
    return label


def build_vocabulary(docs: DataFrame, counts: DataFrame) -> Vocabulary:
    """Counts words and learns classes from what common word (anchor) stands before the words of each kind."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    # bounded by HEAD rows
    head = counts.orderBy(F.desc("c"), "id").limit(HEAD).toPandas()
    ids, c = head["id"].to_numpy(np.int64).view(np.uint64), head["c"].to_numpy(np.int64)
    ranked = ids[ids != _END]
    anchors = np.sort(ranked[:ANCHORS])
    top = np.sort(np.append(ranked[: TOP - 1], _END))
    items = len(top) + 256

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(items * (ANCHORS + 1), np.int64)
        for _, t, offsets in _slices(batches, 0):
            item = _lookup(t, top, np.arange(len(top)), len(top) + (t & np.uint64(0xFF)).astype(np.int64))
            anchor = _lookup(t, anchors, np.arange(len(anchors)), np.full(len(t), -1))
            place = np.arange(len(t))
            last = np.maximum.accumulate(np.where(anchor >= 0, place, -1))
            before = np.concatenate([[-1], last[:-1]])
            start = np.repeat(offsets[:-1], np.diff(offsets))
            seen += np.bincount(item * (ANCHORS + 1) + np.where(before >= start, anchor[before], ANCHORS), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["at", "c"])

    # at most (TOP + 256) * (ANCHORS + 1) rows
    found = docs.where(~F.col("held_out")).select("text").mapInArrow(profile, "at bigint, c bigint").groupBy("at").agg(F.sum("c").alias("c")).toPandas()
    table = np.zeros(items * (ANCHORS + 1))
    table[found["at"].to_numpy(np.int64)] = found["c"].to_numpy(np.float64)
    table = table.reshape(items, -1)
    weight = table.sum(1)
    shape = np.sqrt((table + 0.05) / (table + 0.05).sum(1, keepdims=True))
    singles = np.append(_END, ranked[: SINGLES - 1])
    top_class = np.full(len(top), -1)
    top_class[np.searchsorted(top, singles)] = np.arange(len(singles))
    rest = np.flatnonzero(top_class < 0)
    if len(rest):
        top_class[rest] = SINGLES + _cluster(shape[rest], weight[rest], CLUSTERS)
    cell_class = SINGLES + CLUSTERS + _cluster(shape[len(top) :], weight[len(top) :] + 1e-3, CLASSES - SINGLES - CLUSTERS)
    # words outside the top, by ending: tokens, and words seen once
    cell = F.col("id").bitwiseAND(255)
    by_cell = counts.groupBy(cell.alias("cell")).agg(F.sum("c").alias("n"), F.sum((F.col("c") == 1).cast("bigint")).alias("once"), F.sum((F.col("c") == 2).cast("bigint")).alias("twice")).toPandas()
    tokens_of, once_of, twice_of = np.zeros((3, 256))
    for of, name in ((tokens_of, "n"), (once_of, "once"), (twice_of, "twice")):
        of[by_cell["cell"].to_numpy(int)] = by_cell[name].to_numpy(float)
    order = np.argsort(ids)
    ids, c = ids[order], c[order]
    in_top = np.isin(ids, top)
    np.subtract.at(tokens_of, (ids[in_top] & np.uint64(0xFF)).astype(int), c[in_top])
    seen_once, seen_twice = float(once_of.sum()), float(twice_of.sum())
    np.subtract.at(once_of, (ids[in_top] & np.uint64(0xFF)).astype(int), (c[in_top] == 1).astype(float))
    n_class, once_class = np.bincount(cell_class, tokens_of, CLASSES), np.bincount(cell_class, once_of, CLASSES)
    unknown = (once_class + 0.5) / (n_class + 2.0)
    # as many words are unseen as once ** 2 / (2 * twice), and at least as many as were seen: the classes have them by words seen once
    unseen = max(seen_once**2 / (2 * max(seen_twice, 1.0)), float(total.v), 1.0)
    rare_class = np.bincount(cell_class, minlength=CLASSES) > 0
    unseen_class = np.maximum(unseen * np.where(rare_class, once_class + 0.5, 0.0) / np.where(rare_class, once_class + 0.5, 0.0).sum(), 1.0)
    top_count = _lookup(top, ids, c, np.zeros(len(top), np.int64))
    n_top = np.bincount(top_class, top_count, CLASSES)
    known_log = np.log10((1 - unknown) / np.maximum(n_class, 1.0))[cell_class]
    head_class = _lookup(ids, top, top_class, np.full(len(ids), -1))
    own = (ids & np.uint64(0xFF)).astype(int)
    head_log = np.where(head_class >= 0, np.log10(np.maximum(c, 1) / np.maximum(n_top[head_class], 1.0)), np.log10(np.maximum(c, 1)) + known_log[own])
    share = np.maximum(n_class + n_top, 0.0) + 0.5
    top_log = np.log(np.maximum(top_count, 1) / np.maximum(n_top[top_class], 1.0))
    return Vocabulary(int(total.n), int(total.v), top, top_class, cell_class, ids, c, head_log, known_log, np.log10(unknown / unseen_class)[cell_class], unseen_class, top_log, share / share.sum())


def features(t: np.ndarray, offsets: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The five feature cells of every token, (tokens, 5); tokens before a row's start are one begin token."""
    n = len(t)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    place = np.arange(n)
    out = np.zeros((n, 5), np.int32)
    word = (mix(np.append(t, _BEGIN)) >> np.uint64(51)).astype(np.int32)  # 13 bits
    kinds = np.append(cls, CLASSES).astype(np.int32)
    before = []
    for d in (1, 2, 3):
        at = place - d
        before.append(np.where(at >= start, at, n))
    out[:, 1] = _BASES[1] + word[before[0]]
    out[:, 2] = _BASES[2] + word[before[1]]
    out[:, 3] = _BASES[3] + kinds[before[0]] * _PAIR + kinds[before[1]]
    out[:, 4] = _BASES[4] + kinds[before[0]] * _PAIR + kinds[before[2]]
    return out


def class_before(offsets: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """The class of the token before each token, CLASSES at a row's start."""
    out = np.concatenate([[CLASSES], cls[:-1]]) if len(cls) else cls
    out[offsets[:-1]] = CLASSES
    return out


def logits(w: np.ndarray, f: np.ndarray) -> np.ndarray:
    z = w[f[:, 1]]
    for k in (2, 3, 4):
        z += w[f[:, k]]
    z += w[0]
    z -= z.max(1, keepdims=True)
    return z


def learn(w: np.ndarray, state: np.ndarray, seen: np.ndarray, f: np.ndarray, cls: np.ndarray) -> None:
    """One gradient step for a batch, by the sums of each cell's rows; each weight has a rate of its own that falls with what it has moved."""
    g = np.exp(logits(w, f))
    g /= -g.sum(1, keepdims=True)
    g[np.arange(len(g)), cls] += 1
    for k in range(5):
        if k:
            order = np.argsort(f[:, k], kind="stable")
            cells = f[order, k]
            first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
            total = np.add.reduceat(g[order], first, axis=0)
            cells, counts = cells[first], np.diff(np.append(first, len(order)))
        else:
            cells, total, counts = np.zeros(1, np.int64), g.sum(0, keepdims=True), np.array([len(g)])
        moved = state[cells] + total * total
        state[cells] = moved
        w[cells] += RATE * total / np.sqrt(moved + 1e-6)
        seen[cells] += counts


def learn_words(w: np.ndarray, state: np.ndarray, seen: np.ndarray, v: Vocabulary, before: np.ndarray, place: np.ndarray) -> None:
    """One gradient step for the top words in a batch: what was seen after each class less what the softmax of the word's class expects."""
    n = len(v.top)
    top = place >= 0
    counts = np.bincount(before[top] * n + place[top], minlength=_PAIR * n).reshape(_PAIR, n).astype(np.float64)
    of_class = np.bincount(before[top] * CLASSES + v.top_class[place[top]], minlength=_PAIR * CLASSES).reshape(_PAIR, CLASSES)
    g = np.zeros((_PAIR, TOP), np.float32)
    g[:, :n] = counts - of_class[:, v.top_class] * np.exp(v.word_logs(w))
    g = g.reshape(-1, CLASSES)
    moved = state[CELLS:] + g * g
    state[CELLS:] = moved
    w[CELLS:] += RATE * g / np.sqrt(moved + 1e-6)
    seen[CELLS:] += np.repeat(np.bincount(before, minlength=_PAIR), TOP // CLASSES)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> np.ndarray:
    """Weights after one pass over the training documents, in rounds over disjoint parts of them.

    In a round each task makes gradient updates over its rows, starting from the round's weights, and gives for each cell its
    update and the tokens behind it. Blocks of cells are summed by token counts in a tree of LEVELS levels whose groups have at
    most FAN rows, however many tasks there are; one row of each block for every FAN ** LEVELS tasks is left. The model,
    ROWS x CLASSES numbers whatever the corpus, goes through the driver to the next round's tasks.
    """
    spark = docs.sparkSession
    w = np.zeros((ROWS, CLASSES), np.float32)
    w[0] = np.log(vocabulary.class_share)
    shared = spark.sparkContext.broadcast(asdict(vocabulary))  # plain arrays: workers need not have this package
    schema = "block int, salt int, seen binary, moved binary"
    for turn in range(rounds):
        start = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            v, w = Vocabulary(**shared.value), start.value.copy()
            state, seen = np.full(w.shape, 1.0, np.float32), np.zeros(ROWS, np.float64)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for _, t, offsets in _slices(batches, 0):
                cls = v.classes(t)
                f = features(t, offsets, cls)
                for at in range(0, len(t), BATCH):
                    learn(w, state, seen, f[at : at + BATCH], cls[at : at + BATCH])
                held.append((class_before(offsets, cls), v.places(t)))
                if sum(len(h[0]) for h in held) >= 8 * BATCH:
                    learn_words(w, state, seen, v, *(np.concatenate(x) for x in zip(*held, strict=True)))
                    held = []
            if held:
                learn_words(w, state, seen, v, *(np.concatenate(x) for x in zip(*held, strict=True)))
            if seen.any():
                delta = (w - start.value).astype(np.float64) * seen[:, None]
                salt = TaskContext.get().partitionId() // FAN
                for b in range(0, ROWS, BLOCK):
                    if seen[b : b + BLOCK].any():
                        yield pa.RecordBatch.from_arrays([pa.array([b // BLOCK], pa.int32()), pa.array([salt], pa.int32()), pa.array([seen[b : b + BLOCK].tobytes()]), pa.array([delta[b : b + BLOCK].astype(np.float32).tobytes()])], ["block", "salt", "seen", "moved"])

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            seen = np.sum([np.frombuffer(x) for x in pdf["seen"]], axis=0)
            moved = np.sum([np.frombuffer(x, np.float32) for x in pdf["moved"]], axis=0, dtype=np.float64)
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "salt": [pdf["salt"].iloc[0] // FAN], "seen": [seen.tobytes()], "moved": [moved.astype(np.float32).tobytes()]})

        part = docs.where(~F.col("held_out") & (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(rounds)) == turn)).select("text")
        sums = part.mapInArrow(run, schema)
        for _ in range(LEVELS):
            sums = sums.groupBy("block", "salt").applyInPandas(add, schema)
        tokens_seen, moved = np.zeros(ROWS), np.zeros((ROWS, CLASSES))
        for r in sums.collect():
            at = slice(r.block * BLOCK, min((r.block + 1) * BLOCK, ROWS))
            tokens_seen[at] += np.frombuffer(r.seen)
            moved[at] += np.frombuffer(r.moved, np.float32).reshape(-1, CLASSES)
        w = w + (moved / np.maximum(tokens_seen, 1.0)[:, None]).astype(np.float32)
        start.unpersist()
    return w


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    Documents are scored where they lie; words outside the HEAD commonest travel as (row, id) to the table of all counts, as
    their number grows with the corpus. Null texts are empty: one end token. Repeated rows count as often as they occur and
    each have their row. Without training documents all words are unknown. Other columns are ignored.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty("text").alias("text")).withColumn("held_out", held_out())
    counts = stored(count_words(docs), "lm-counts")
    vocabulary = build_vocabulary(docs, counts)
    w = train(docs, vocabulary)
    spark = documents.sparkSession
    model = spark.sparkContext.broadcast((asdict(vocabulary), w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, w = Vocabulary(**model.value[0]), model.value[1]
        words = v.word_logs(w) / np.log(10)
        for part, t, offsets in _slices(batches, 2):
            cls = v.classes(t)
            f = features(t, offsets, cls)
            chosen = np.empty(len(t))
            for at in range(0, len(t), BATCH):
                z = logits(w, f[at : at + BATCH])
                chosen[at : at + BATCH] = z[np.arange(len(z)), cls[at : at + BATCH]] - np.log(np.exp(z).sum(1, dtype=np.float64))
            place = np.searchsorted(v.head, t)
            place[place == len(v.head)] = 0
            known = (v.head[place] == t) if len(v.head) else np.zeros(len(t), bool)
            log = chosen / np.log(10) + (np.where(known, v.head_log[place], 0.0) if len(v.head) else 0.0)
            top = v.places(t)
            is_top = np.flatnonzero((top >= 0) & known)
            log[is_top] += words[class_before(offsets, cls)[is_top], top[is_top]] - v.head_log[place[is_top]]
            base = np.where(known, np.log10(v.head_count[place] + 1.0), 0.0) if len(v.head) else np.zeros(len(t))
            starts = offsets[:-1]
            sums = [np.add.reduceat(x, starts) for x in (log, base, known.astype(np.int64))] if len(t) else [np.zeros(0)] * 3
            rare = t[~known].view(np.int64)
            rare_offsets = np.concatenate([[0], np.cumsum(~known)])[offsets].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0]), pa.ListArray.from_arrays(rare_offsets, pa.array(rare))],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "log", "rare"])

    scored = docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, log double, rare array<bigint>")
    scored = stored(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    known, unknown = (F.array(*[F.lit(float(x)) for x in a]) for a in (vocabulary.known_log, vocabulary.unknown_log))
    cell = F.col("id").bitwiseAND(255).cast("int") + 1
    rare = scored.select("row", F.explode("rare").alias("id")).join(counts, "id", "left")
    rare = rare.select("row", F.col("c").isNotNull().cast("bigint").alias("k"), F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)).alias("b"),
                       F.when(F.col("c").isNotNull(), F.log10(F.col("c").cast("double")) + F.element_at(known, cell)).otherwise(F.element_at(unknown, cell)).alias("l"))
    rare = rare.groupBy("row").agg(F.sum("k").alias("k"), F.sum("b").alias("b"), F.sum("l").alias("l"))
    out = scored.drop("rare").join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    floor = float(np.log10(vocabulary.n + vocabulary.v + 1.0))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("k")).alias("n_known"), F.lit(vocabulary.n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0)) - F.col("n_tokens") * floor).alias("base_score"), (F.col("log") + F.coalesce("l", F.lit(0.0))).alias("score"))
