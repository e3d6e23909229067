"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with multiprobe buckets and exact checks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, stored
from .components import components

COSINE = 0.9
#: At least so many tables; as keys grow longer with the number of rows, tables are added so that a pair at the threshold is
#: missed with a chance of about MISS at every size.
TABLES = 10
MISS = 1e-3
PROBES = 4
BLOCK = 2048
#: Rows of a block that are multiplied at once, and pairs whose buckets are looked up at once.
_SLAB = 256
_PAIRS = 1 << 18
#: The low bits of a key are hashed, the rest is its table's number: keys of two tables are never equal.
_KEY_BITS = 54
#: Groups of up to so many rows are compared together with others, larger ones by a matrix product each.
_FEW = 16
SEED = 20_240_607


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows of x, whose width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def keys(x: np.ndarray, parts: int, tables: int = TABLES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Bucket keys (rows, tables, probes) of unit vectors.

    A part of a key is the axis, with its sign, that lies nearest to the vector after three sign flips and rotations. Probe 0
    takes the nearest axis in each part; each further probe takes the second nearest in the part where that costs least, next least, ...
    """
    n, d = x.shape
    width = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, width))
    padded[:, :d] = x
    rng = np.random.default_rng(seed)
    out = np.zeros((n, tables, probes), np.uint64)
    for t in range(tables):
        first, second, cost = [], [], []
        for _ in range(parts):
            y = padded
            for _ in range(3):
                y = hadamard(y * rng.choice([-1.0, 1.0], width))
            size = np.abs(y)
            i = size.argmax(1)
            r = np.arange(n)
            top = size[r, i]
            first.append(2 * i + (y[r, i] > 0))
            size[r, i] = -1
            j = size.argmax(1)
            second.append(2 * j + (y[r, j] > 0))
            cost.append(top - size[r, j])
        order = np.argsort(np.stack(cost, 1), axis=1, kind="stable")
        for p in range(probes):
            key = np.full(n, t + 1, np.uint64)
            for k in range(parts):
                other = (order[:, p - 1] == k) if 0 < p <= parts else np.zeros(n, bool)
                key = mix(key * np.uint64(1_000_003) + np.where(other, second[k], first[k]).astype(np.uint64))
            out[:, t, p] = key >> np.uint64(64 - _KEY_BITS) | np.uint64(t << _KEY_BITS)
    return out


def _unit(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows can link, and their unit vectors in double precision. Rows of another width than the batch's commonest are handled by callers per width."""
    rows = vectors.to_pylist()
    good, out = [], []
    for i, v in enumerate(rows):
        if v and None not in v:
            a = np.asarray(v, np.float64)
            most = np.abs(a).max() if len(a) else 0.0
            if np.isfinite(a).all() and most > 0:
                a = a / most  # huge or tiny components must not overflow
                good.append(i)
                out.append(a / np.linalg.norm(a))
    return np.array(good, np.int64), out


def _parts(rows: int, width: int) -> int:
    """How many axes make up a key: so many that vectors at random angles share few buckets, by the number of rows."""
    axes = 2 << max(1, (max(2, width) - 1).bit_length())
    return max(1, math.ceil(math.log(max(rows, 2) * 4) / math.log(axes)))


def tables_for(parts: int, width: int, cosine: float = COSINE, probes: int = PROBES, miss: float = MISS) -> int:
    """Tables needed for a pair at exactly this cosine to share a bucket but for a chance of about miss. The chance of meeting in
    one table is taken from 400 random pairs, drawn with a fixed seed and not from the data."""
    rng = np.random.default_rng(SEED + 1)
    n, d, trial = 400, max(2, width), 8
    x, z = rng.normal(size=(2, n, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    one, two = keys(x, parts, trial, probes), keys(cosine * x + math.sqrt(max(0.0, 1 - cosine**2)) * z, parts, trial, probes)
    meet = float((one[:, :, :, None] == two[:, :, None, :]).any((2, 3)).mean())
    return max(TABLES, math.ceil(math.log(miss) / math.log1p(-min(max(meet, 1e-3), 0.99))))


def _compare(batches: Iterator[pa.RecordBatch], cosine: float, probes: int) -> Iterator[pa.RecordBatch]:
    """What _linked finds in rows (bucket, i, j, node, block, copies, e, keys) in the order of bucket, i, j, block. A group of
    those three has at most about 2 * BLOCK rows; small groups are taken many at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        at = 0
        while at < b.num_rows:
            part = b.slice(at, 2048)
            at += part.num_rows
            group = np.stack([part.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            new = np.flatnonzero((group[1:] != group[:-1]).any(1)) + 1
            begins = [0, *new] if last is not None and (group[0] != last).any() else [*new]
            last = group[-1]
            cut = int(begins[-1]) if len(begins) else None  # where the last group begins, which may go on in the next part
            if cut is None:
                held.append(part)
                continue
            yield from _linked([*held, part.slice(0, cut)], cosine, probes)
            held = [part.slice(cut)]
    if held:
        yield from _linked(held, cosine, probes)


def _meet_first(keys: np.ndarray, bucket: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Which pairs of rows share no bucket before this one. keys: (rows, tables, probes); bucket: the one that each row is here for."""
    table = bucket >> _KEY_BITS
    first = np.ones(len(one), bool)
    left = np.arange(len(one))
    for t in range(keys.shape[1]):
        left = left[table[one[left]] >= t]
        if not len(left):
            break
        a, b = keys[one[left], t][:, :, None], keys[two[left], t][:, None, :]
        before = ((a == b) & (a < bucket[one[left]][:, None, None])).any((1, 2))
        first[left[before]] = False
        left = left[~before]
    return first


def _unite(label: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Gives rows that pairs connect the label of the least of them. Labels are rows that carry their own number."""
    while True:
        a, b = label[one], label[two]
        apart = a != b
        if not apart.any():
            return
        one, two = one[apart], two[apart]
        np.minimum.at(label, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _near_pairs(x: np.ndarray, group: np.ndarray, block: np.ndarray, apart: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group with a product of at least cosine, but none of one block where it is of two (apart)."""
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(first, len(group)))
    few = np.repeat(size <= _FEW, size)
    for d in range(1, min(_FEW, len(group))):
        a = np.flatnonzero(few[:-d] & (group[:-d] == group[d:]) & ~(apart[:-d] & (block[:-d] == block[d:])))
        a = a[np.einsum("ij,ij->i", x[a], x[a + d]) >= cosine]
        yield a, a + d
    for f, m in zip(first[size > _FEW], size[size > _FEW], strict=True):
        own = block[f : f + m]
        end = int(np.searchsorted(own, own[-1])) if apart[f] else m  # rows come in the order of blocks
        for low in range(0, end, _SLAB):
            begin = end if apart[f] else low
            near = x[f + low : f + min(low + _SLAB, end)] @ x[f + begin : f + m].T >= cosine
            r, c = np.nonzero(near if apart[f] else np.triu(near, 1))
            yield r + f + low, c + f + begin


def _linked(parts: list[pa.RecordBatch], cosine: float, probes: int) -> Iterator[pa.RecordBatch]:
    """(node, linked, other) for each node that these groups link: how many vectors with it that it meets here first, and a node
    that such links lead to. So what goes on grows with the rows of a group, not with its pairs."""
    rows = pa.Table.from_batches(parts).combine_chunks()
    if not rows.num_rows:
        return
    at = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
    node, block, copies = (rows.column(k).to_numpy() for k in (3, 4, 5))
    group = np.concatenate([[0], np.cumsum((at[1:] != at[:-1]).any(1))])
    e, keys = rows.column(6).combine_chunks(), rows.column(7).combine_chunks()
    width = pa.compute.list_value_length(e).to_numpy()
    for w in np.unique(width):
        pick = np.flatnonzero(width == w)
        x = e.take(pa.array(pick)).flatten().to_numpy().astype(np.float64).reshape(len(pick), w)
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        k = keys.take(pa.array(pick)).flatten().to_numpy().reshape(len(pick), -1, probes)
        bucket, times = at[pick, 0], copies[pick].astype(np.float64)
        linked, label = np.zeros(len(pick)), np.arange(len(pick))
        for a, b in _near_pairs(x, group[pick], block[pick], at[pick, 1] != at[pick, 2], cosine):
            for cut in range(0, len(a), _PAIRS):
                one, two = a[cut : cut + _PAIRS], b[cut : cut + _PAIRS]
                new = _meet_first(k, bucket, one, two)
                one, two = one[new], two[new]
                linked += np.bincount(one, times[two], len(pick)) + np.bincount(two, times[one], len(pick))
                _unite(label, one, two)
        some = np.flatnonzero(linked)
        if len(some):
            nodes = node[pick]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(linked[some].astype(np.int64)), pa.array(nodes[label[some]])], ["node", "linked", "other"])


def near_vectors(embeddings: DataFrame, cosine: float = COSINE, tables: int | None = None, probes: int = PROBES) -> DataFrame:
    """All rows with their links: vec_id, n_links, component_id, kept.

    Without a number of tables, tables_for gives it from the number of different vectors, so that recall does not fall as they grow.

    Equal vectors are first gathered into one class, whose members all link. Class vectors are put in the buckets of their
    probes; a bucket of more than BLOCK classes is cut into blocks and every two blocks are a group of their own, compared by
    matrix products, so that no group grows with the data. Products of at least cosine, in double precision, are links. A pair
    counts in the first bucket that both share; a group hands on a count and one connection for each of its rows, not its pairs.
    Null and zero vectors, and those with null or non-finite components, link with nothing. Vectors of different widths
    never link. Rows with equal vec_id are one node: their links are joined; rows with a null vec_id are nodes of their own without links.
    """
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").alias("e"))
    usable = rows.where(F.col("vec_id").isNotNull() & (F.size("e") > 0)).where(~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("e", lambda x: x != 0))
    # the same direction at the same length: the class key is a strong hash of the components, -0.0 as 0.0
    exact = F.sha2(F.concat_ws(",", F.transform("e", lambda x: (x + F.lit(0.0)).cast("string"))), 256)
    members = stored(usable.select("vec_id", exact.alias("class"), "e").dropDuplicates(["vec_id", "class"]), "vectors")
    classes = members.groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("head"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    heads = members.join(classes, "class").where("vec_id = head").select("node", "copies", "e")
    n, width = heads.agg(F.count("*"), F.coalesce(F.max(F.size("e")), F.lit(1))).first()
    parts = _parts(n, width)
    tables = tables_for(parts, width, cosine, probes) if tables is None else tables
    kind = embeddings.schema["embedding"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good, unit = _unit(b.column(2))
            widths = np.array([len(u) for u in unit], np.int64)
            for w in np.unique(widths):
                pick = np.flatnonzero(widths == w)
                x = np.stack([unit[i] for i in pick])
                k = keys(x, parts, tables, probes) ^ (mix(np.full(1, w, np.uint64)) >> np.uint64(64 - _KEY_BITS))
                k = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * (tables * probes), k.view(np.int64).ravel())
                own = b.take(pa.array(good[pick]))
                yield pa.RecordBatch.from_arrays([*own.columns, k], ["node", "copies", "e", "keys"])

    vectors = stored(heads.mapInArrow(hashed, f"node bigint, copies bigint, e {kind}, keys array<bigint>"), "hashed-vectors")
    slim = vectors.select("node", F.explode(F.array_distinct("keys")).alias("bucket"))
    # only buckets of two or more classes go on; larger ones are cut into blocks
    many = slim.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    many = stored(many, "buckets")
    placed = slim.join(many, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
    # every two blocks (i <= j) of a bucket are one task's group; a row goes to those of its block
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    spread = placed.withColumn("other", F.explode(others)).select(
        "node", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block")
    dealt = spread.join(vectors, "node").select("bucket", "i", "j", "node", "block", "copies", "e", "keys")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "block", "node")
    linked = stored(dealt.mapInArrow(lambda batches: _compare(batches, cosine, probes), "node bigint, linked bigint, other bigint"), "vector-links")
    return _report(embeddings, members, classes, linked)


def _report(embeddings: DataFrame, members: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    weight = linked.groupBy("node").agg(F.sum("linked").alias("linked"))
    of_class = classes.join(weight, "node", "left").select("class", "head", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n"))
    # components of the classes, named by the smallest id of their members
    head = lambda c: classes.select(F.col("node").alias(c), F.col("head").alias(f"head_{c}"))
    edges = linked.where("node <> other").select("node", "other").distinct()
    named = edges.join(head("node"), "node").join(head("other"), "other").select(F.col("head_node").alias("a"), F.col("head_other").alias("b"))
    reach = components(named)
    of_class = of_class.join(reach.withColumnRenamed("node", "head"), "head", "left").select("class", "n", F.coalesce("component", "head").alias("c"))
    found = members.select("vec_id", "class").join(of_class, "class").groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("c").alias("c"))
    ids = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"))
    out = ids.join(found, "vec_id", "left")
    component = F.coalesce("c", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
