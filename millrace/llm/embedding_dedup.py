"""Embedding near-duplicates by a pivot-permutation index.

The reference points are vectors of a bounded sample, each the farthest from those before it, until all of the sample
is within cosine APART of one: a dense group holds few pivots, so its members see the same ones. Their number grows
with the root of the table's, up to PIVOTS. Each vector is described by its permutation: its NEAREST nearest pivots in
order. Inverted lists hold the vectors under pairs of those pivots, all pairs of places whose sum is below NEAREST
(the nearest pivot with all others, the farther ones only with near ones), so vectors that meet share two pivots high
in both permutations. Lists with one vector are left out before the vectors themselves are joined. Pairs that meet
are verified by cosine in double precision; a pair that several lists bring together counts in the first of them only.

Equal vectors are one class before all that, so copies are never paired. A list longer than BUCKET is divided
into chunks that meet pairwise in tasks of their own: none is capped, and no task holds a whole list. What
leaves a task is, for each of its vectors, the number of links and one link towards the root it reaches
there, not the pairs.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
vectors of another length than most. Very large and very small finite components count as they are. Repeated rows
are separate vectors. Ties: of pivots equally near the one with the smaller number comes first. Extra columns are
ignored. Empty tables give an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, in_arrow, scratch

PIVOTS, NEAREST, BUCKET = 16_384, 8, 512
#: Vectors sampled for each pivot; the cosine that no two pivots reach; rows of a list that is compared as a matrix.
SAMPLE, APART, MATRIX = 4, 0.8, 33


def pivots_for(n: int) -> int:
    """How many pivots n distinct vectors get: lists, which go with the square, stay as short as the table grows."""
    return min(PIVOTS, 64 + int(4 * n**0.5))


def list_keys(order: np.ndarray, n_pivots: int) -> np.ndarray:
    """The lists of each permutation: pairs of its pivots at places whose sum is below its length."""
    k = order.shape[1]
    places = [(i, j) for i, j in combinations(range(k), 2) if i + j < k]
    a, b = (order[:, [p[x] for p in places]].astype(np.int64) for x in (0, 1))
    return np.minimum(a, b) * n_pivots + np.maximum(a, b)


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, h1, h2) for all rows, h1 null where a vector links with nothing; and a row for each distinct vector."""
    e = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select("vec_id", e.alias("e"))
    ok = F.col("e").isNotNull() & ~F.exists("e", bad) & F.exists("e", lambda x: x != 0)
    rows = rows.withColumn("e", F.when(ok, F.col("e"))).withColumn("n", F.size("e"))
    usual = rows.where("e is not null").groupBy("n").count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = usual[0][0] if usual else 0
    e = F.when(F.col("n") == width, F.col("e"))
    rows = rows.select("vec_id", e.alias("e"), F.when(e.isNotNull(), F.xxhash64("e")).alias("h1"), F.when(e.isNotNull(), F.xxhash64(F.lit(1), "e")).alias("h2"))
    distinct = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("e").alias("e"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
    return rows.select("vec_id", "h1", "h2"), distinct


def describe(distinct: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """(cid, list, near): a row for each list of a vector; near holds its nearest pivots in order."""
    shared = distinct.sparkSession.sparkContext.broadcast(pivots)

    def batches(it):
        pivots = shared.value
        for b in it:
            for c in (b.slice(i, 2048) for i in range(0, len(b), 2048)):
                order = np.argsort(-(_unit(c.column(1), pivots.shape[1]) @ pivots.T), axis=1, kind="stable")[:, :nearest] if nearest * 4 > len(pivots) else _top(_unit(c.column(1), pivots.shape[1]) @ pivots.T, nearest)
                lists = list_keys(order, len(pivots))
                at = pa.array(np.repeat(np.arange(len(c)), lists.shape[1]))
                near = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * nearest), len(c), [None, pa.py_buffer(order.astype("<u2").tobytes())])
                yield pa.RecordBatch.from_arrays([c.column(0).take(at), pa.array(lists.ravel()), near.take(at).cast(pa.binary())], names=["cid", "list", "near"])

    return distinct.select(F.col("h1").alias("cid"), "e").transform(in_arrow, batches, "cid long, list long, near binary")


def _top(sim: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row, in order."""
    top = np.sort(np.argpartition(-sim, k - 1, axis=1)[:, :k], axis=1)
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(sim, top, axis=1), axis=1, kind="stable"), axis=1)


def _unit(col: pa.Array, width: int) -> np.ndarray:
    """Unit vectors; the largest component is taken out first, so that no square over- or underflows."""
    x = col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), width)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def farthest_first(sample: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of the unit vectors, each the farthest from those before it and below cosine APART to them all."""
    near, chosen, at = np.full(len(sample), -np.inf), [], 0
    while len(chosen) < most:
        chosen.append(at)
        near = np.maximum(near, sample @ sample[at])
        at = int(near.argmin())
        if near[at] >= APART:
            break
    return sample[chosen]


def _told(cid: np.ndarray, n: np.ndarray, p: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
    """(src, dst, links) of the vectors that the links p, q reach: how many, and the root of each."""
    links = np.bincount(p, weights=n[q], minlength=len(cid)) + np.bincount(q, weights=n[p], minlength=len(cid))
    root = np.arange(len(cid))
    while True:
        low = root.copy()
        np.minimum.at(low, p, root[q])
        np.minimum.at(low, q, root[p])
        low = low[low]
        if (low == root).all():
            break
        root = low
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(cid[root[some]]), pa.array(links[some].astype(np.int64))], names=["src", "dst", "links"])


def _pairs(u: np.ndarray, keys: np.ndarray, side: np.ndarray | None, key: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The links among the vectors of one list, or across its sides, that no earlier list brings together."""
    row, col = np.nonzero(keys < key)
    names, at = np.unique(keys[row, col], return_inverse=True)
    shared = np.bincount(at, minlength=1) > 1  # lists of one vector here bring nobody together
    row, at = row[shared[at]], at[shared[at]]
    names, at = np.unique(at, return_inverse=True)
    less = np.zeros((len(u), max(1, len(names))), np.float32)
    less[row, at] = 1
    a = np.arange(len(u)) if side is None else np.flatnonzero(side == 0)
    b = a if side is None else np.flatnonzero(side == 1)
    hit = (u[a] @ u[b].T >= cosine) & (less[a] @ less[b].T == 0)
    i, j = np.nonzero(np.triu(hit, 1) if side is None else hit)
    return a[i], b[j]


def verify(listed: DataFrame, vectors: DataFrame, width: int, nearest: int, n_pivots: int, cosine: float) -> DataFrame:
    """(src, dst, links): for the vectors of each sorted run of lists, links found there and a vector each reaches."""

    def runs(it):
        """Record batches joined so that none ends within a group of (list, a, b)."""
        held = None
        for b in it:
            t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            key = np.stack([t.column(c).to_numpy() for c in ("list", "a", "b")])
            same = (key == key[:, -1:]).all(axis=0)
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            if last:
                yield t.slice(0, last).combine_chunks()
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield held.combine_chunks()

    def batches(it):
        for t in runs(it):
            cid, lists, a, b, n = (t.column(c).to_numpy() for c in ("cid", "list", "a", "b", "n"))
            u = _unit(t.column("e").combine_chunks() if isinstance(t.column("e"), pa.ChunkedArray) else t.column("e"), width)
            near = list_keys(np.frombuffer(b"".join(t.column("near").to_pylist()), "<u2").reshape(-1, nearest), n_pivots)
            group = np.cumsum(np.concatenate([[True], (lists[1:] != lists[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            side = t.column("side").to_numpy()
            size = np.bincount(group)
            end = np.cumsum(size)
            for g in np.flatnonzero(size >= MATRIX):
                at = slice(int(end[g] - size[g]), int(end[g]))
                i, j = _pairs(u[at], near[at], None if a[at.start] == b[at.start] else side[at], int(lists[at.start]), cosine)
                if len(i):
                    yield _told(cid[at], n[at], i, j)
            few = size[group] < MATRIX
            cid, lists, a, b, n, u, near, group, side = (x[few] for x in (cid, lists, a, b, n, u, near, group, side))
            left, right = [], []
            d = 1
            while d < len(group):
                i = np.flatnonzero((group[d:] == group[:-d]) & ((a[:-d] == b[:-d]) | (side[d:] != side[:-d])) & (cid[d:] != cid[:-d]))
                if not len(i) and not (group[d:] == group[:-d]).any():
                    break
                for part in np.array_split(i, max(1, len(i) // 20_000)):
                    hit = part[np.einsum("ij,ij->i", u[part], u[part + d]) >= cosine]
                    left.append(hit)
                    right.append(hit + d)
                d += 1
            if not left or not sum(map(len, left)):
                continue
            i, j = np.concatenate(left), np.concatenate(right)
            common = (near[i][:, :, None] == near[j][:, None, :]).any(axis=2)
            own = np.where(common, near[i], np.iinfo(np.int64).max).min(axis=1) == lists[i]
            i, j = i[own], j[own]
            if not len(i):
                continue
            ids, at = np.unique(np.concatenate([cid[i], cid[j]]), return_inverse=True)
            p, q = at[: len(i)], at[len(i) :]
            weight = np.zeros(len(ids), np.int64)
            weight[p], weight[q] = n[i], n[j]
            yield _told(ids, weight, p, q)

    sizes = scratch(listed.groupBy("list").agg(F.count("*").alias("rows")).where("rows > 1"), "list-sizes")
    chunks = F.ceil(F.col("rows") / BUCKET).cast("int")
    met = listed.join(sizes, "list").join(vectors.select(F.col("h1").alias("cid"), "e", "n"), "cid")
    dealt = met.withColumn("k", F.pmod(F.xxhash64("cid"), chunks).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1))).select("cid", "list", F.least("k", "other").alias("a"), F.greatest("k", "other").alias("b"), (F.col("k") > F.col("other")).cast("int").alias("side"), "near", "e", "n")
    sorted_ = dealt.repartition("list", "a", "b").sortWithinPartitions("list", "a", "b")
    return sorted_.transform(in_arrow, batches, "src long, dst long, links long")


def near_vectors(vectors: DataFrame, cosine: float = 0.9, pivots: int | None = None, nearest: int = NEAREST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row; pivots_for says how many pivots unless pivots does."""
    rows, distinct = classes_of(vectors)
    rows, distinct = scratch(rows, "vectors"), scratch(distinct, "distinct")
    pivots = pivots or pivots_for(distinct.count())
    got = distinct.orderBy(F.xxhash64("h2"), "h1").limit(SAMPLE * pivots).select("e").toArrow().column("e")  # at most SAMPLE * PIVOTS vectors
    sums = roots = None
    if len(got):
        got = got.combine_chunks()
        points = farthest_first(_unit(got, len(got[0])), pivots)
        nearest = min(nearest, len(points))
        if nearest < 2:
            points, nearest = np.concatenate([points, -points]), 2
        listed = scratch(describe(distinct, points, nearest), "lists")
        found = scratch(verify(listed, distinct, points.shape[1], nearest, len(points), cosine), "links")
        sums = scratch(found.groupBy(F.col("src").alias("h1")).agg(F.sum("links").alias("links")), "link-sums")
        roots = components(found.select("src", "dst"), "vectors").select(F.col("id").alias("h1"), F.col("component").alias("root"))
        classes = distinct.select("h1", "h2", "least", "n").join(sums, "h1", "left").join(roots, "h1", "left").withColumn("root", F.coalesce("root", "h1"))
        classes = scratch(classes, "classes")
        named = scratch(classes.groupBy("root").agg(F.min("least").alias("component_id")), "named")
        classes = scratch(classes.join(named, "root").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")), "class-results")
        rows = rows.join(classes, ["h1", "h2"], "left")
    else:
        rows = rows.withColumns({"component_id": F.lit(None).cast("long"), "n_links": F.lit(0).cast("long")})
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").cast("long").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
