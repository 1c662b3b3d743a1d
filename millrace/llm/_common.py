"""Shared pieces of the corpus operators: scratch tables, whole-text word hashing, components."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_SPACE = b" \t\n\x0b\x0c\r"
#: Bytes of text that the numpy kernels hold at once; a dozen temporary arrays of eight bytes a byte follow.
CHUNK = 1 << 19
#: Bytes after which a long row is divided behind any separator, where a better place was asked for and not found.
REACH = 16 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once, so that their Python workers find it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_corpus_package", None):
        return
    package = Path(__file__).resolve().parent.parent
    at = Path(tempfile.mkdtemp(prefix="package-")) / f"{package.name}.zip"
    with zipfile.ZipFile(at, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(at))
    sc._corpus_package = str(at)


def release() -> None:
    """Gives freed memory back to the system; a worker that waits for its next task, or runs another stage, else keeps it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def sliced(it, rows: int = 1000):
    """The batches in slices of some rows, so that what is made of them is not held for a whole batch."""
    for b in it:
        for a in range(0, len(b), rows):
            yield b.slice(a, rows)


def in_arrow(df: DataFrame, batches, schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the workers, which give their memory back after each task."""
    ship(df.sparkSession)

    def tidy(it):
        try:
            yield from batches(it)
        finally:
            release()

    return df.mapInArrow(tidy, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of our own only in local mode."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-"))
        where = sc.getCheckpointDir()
    return where.rstrip("/")


def scratch(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def identity(*cols) -> list:
    """128 bits that identify a row by the given columns (nulls count as values)."""
    return [F.xxhash64(*cols).alias("rid"), F.xxhash64(F.lit(1), *cols).alias("rid2")]


# ---------------------------------------------------------------- words


@functools.cache
def _keys() -> tuple[np.ndarray, np.ndarray]:
    """A random number for each byte and for each place in a word."""
    g = np.random.default_rng(20240607)
    return g.integers(1, 2**63, 256, dtype=np.uint64), g.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


@functools.cache
def byte_values(fold: bool) -> np.ndarray:
    t = _keys()[0].copy()
    if fold:
        t[65:91] = t[97:123]
    return t


@functools.cache
def separators(punctuation: bool) -> np.ndarray:
    """True for the ASCII white space, and also for all other ASCII bytes that are no letter or digit."""
    s = np.zeros(256, dtype=bool)
    s[list(ASCII_SPACE)] = True
    if punctuation:
        s[[i for i in range(128) if not chr(i).isalnum()]] = True
    return s


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary() if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_large_binary(col.type) else "")
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def pieces_of(buf: np.ndarray, offsets: np.ndarray, cut) -> list[list[tuple[int, int, int]]]:
    """Groups (row, start, end) of about CHUNK bytes; longer rows are divided where cut(buf, start, end) says."""
    groups, group, size = [], [], 0
    for row in range(len(offsets) - 1):
        at, end = int(offsets[row]), int(offsets[row + 1])
        while True:
            to = end if end - at <= CHUNK else cut(buf, at, end)
            group.append((row, at, to))
            size += to - at
            at = to
            if size >= CHUNK:
                groups.append(group)
                group, size = [], 0
            if at >= end:
                break
    return groups + [group] if group else groups


def cut_at(*tables: np.ndarray):
    """Divides a long row near CHUNK bytes from its start, behind a byte of the first table; where the next REACH bytes
    have none, behind one of the next table."""

    def cut(buf, at, end):
        for k, sep in enumerate(tables):
            step, to = CHUNK // 2, at + CHUNK // 2
            while to < end and (k == len(tables) - 1 or to - at < REACH):
                hits = np.flatnonzero(sep[buf[to : min(to + step, end)]])
                if len(hits):
                    return to + int(hits[0]) + 1
                to += step
        return end

    return cut


def spans_hash(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray, prefixes: tuple[int, ...] = ()) -> list[np.ndarray]:
    """64-bit hashes of the byte spans, then of their first bytes for each prefix length (0 if shorter)."""
    lens = ends - starts
    if not len(lens):
        return [np.zeros(0, np.uint64)] * (1 + len(prefixes))
    first = np.cumsum(lens) - lens
    place = np.arange(int(lens.sum()), dtype=np.int64)
    where = np.repeat(starts - first, lens) + place
    pos = place - np.repeat(first, lens)
    weights = _keys()[1][pos & 4095]
    if int(lens.max()) > 4096:  # the places of a long span differ in weight beyond the table's length too
        weights = weights + ((pos >> 12).astype(np.uint64) * np.uint64(0xD1342543DE82EF96))
    val = values[b[where]] * weights
    out = [np.add.reduceat(val, first) + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)]
    for k in prefixes:
        val[pos >= k] = 0
        h = np.add.reduceat(val, first) + np.uint64(k * 7919 + 1)
        h[lens <= k] = 0
        out.insert(1, h)
    for h in out:
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return out


def words(col: pa.Array, punctuation: bool = False, fold: bool = True, prefixes: tuple[int, ...] = (), divide: np.ndarray | None = None):
    """Yields (rows, starts, ends, hashes): the words of whole texts, a bounded number of bytes at a time.

    divide: table of the bytes, separators all, behind which long texts are divided if they have any; default all separators.

    rows: row number of each word, ascending; starts, ends: its bytes in the row's text; hashes: a list, the
    word's hash and those of its prefixes (longest last named first). A row may go on in the next item.
    """
    buf, offsets = text_buffers(col)
    sep, values = separators(punctuation), byte_values(fold)
    for group in pieces_of(buf, offsets, cut_at(sep) if divide is None else cut_at(divide, sep)):
        rows, lo, hi = (np.array(x, dtype=np.int64) for x in zip(*group, strict=True))
        base = int(lo[0])
        b = buf[base : int(hi[-1])]
        if not len(b):
            continue
        s = sep[b]
        before, after = np.empty(len(b), bool), np.empty(len(b), bool)
        before[0], after[-1] = True, True
        before[1:], after[:-1] = s[:-1], s[1:]
        full = hi > lo
        before[lo[full] - base] = True
        after[hi[full] - base - 1] = True
        starts, ends = np.flatnonzero(~s & before), np.flatnonzero(~s & after) + 1
        which = np.searchsorted(lo[full] - base, starts, side="right") - 1
        r = rows[full][which]
        yield r, starts + base - offsets[r], ends + base - offsets[r], spans_hash(b, starts, ends, values, tuple(sorted(prefixes, reverse=True)))


def words_by_row(col: pa.Array, **kw):
    """Yields (row, starts, ends, hashes) with a row's words together; rows without words come with empty arrays."""
    n, held, at = len(col), [], 0
    empty = np.zeros(0, np.int64)

    def join(parts):
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if len(parts) > 1 else parts[0]

    for rows, starts, ends, (h, *_) in words(col, **kw):
        if not len(rows):
            continue
        edges = np.flatnonzero(np.diff(rows)) + 1
        for a, z in zip([0, *edges.tolist()], [*edges.tolist(), len(rows)], strict=True):
            row = int(rows[a])
            if held and row != at:
                yield at, *join(held)
                held, at = [], at + 1
            while at < row:
                yield at, empty, empty, np.zeros(0, np.uint64)
                at += 1
            held.append((starts[a:z], ends[a:z], h[a:z]))
    if held:
        yield at, *join(held)
        at += 1
    for row in range(at, n):
        yield row, empty, empty, np.zeros(0, np.uint64)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, tag: str) -> DataFrame:
    """(id, component): the smallest id reachable over edges (src, dst), for each id that has an edge.

    Labels go along all edges, then each label jumps to its own label, until no label falls: a number of
    rounds that grows with the logarithm of a component's width. Both sides of each join are written tables,
    so that Spark can split a hub's rows; the minimum is taken before the shuffle.
    """
    s, t = F.col("src"), F.col("dst")
    both = edges.select(F.explode(F.array(*(F.struct(a.alias("src"), b.alias("dst")) for a, b in ((s, t), (t, s), (s, s), (t, t))))).alias("e")).select("e.*")
    e = scratch(both.groupBy("src", "dst").agg(F.lit(1).alias("one")).drop("one"), tag)
    labels, total = scratch(e.groupBy("src").agg(F.min("dst").alias("label")).withColumnRenamed("src", "id"), tag), None
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count("*")).first()
        if total is not None and now[0] == total:
            return labels.withColumnRenamed("label", "component")
        total = now[0]
        if not now[1]:
            return labels.withColumnRenamed("label", "component")
        told = scratch(e.join(labels, F.col("dst") == F.col("id")).groupBy("src").agg(F.min("label").alias("label")).withColumnRenamed("src", "id"), tag)
        labels = scratch(told.alias("a").join(told.alias("b"), F.col("a.label") == F.col("b.id")).select("a.id", F.col("b.label").alias("label")), tag)
