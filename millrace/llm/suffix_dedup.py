"""Repeated passages by sparse suffix arrays.

Of all suffixes of the word streams only those that start at content-selected positions stay: the minimisers
of every run of SPREAD word 5-grams. So equal passages keep the same suffixes, and any passage of min_words
words holds the minimum of its first SPREAD grams, followed by `reach` words of the passage at least.

The retained suffixes are sorted by their first `reach` words, as hashes of PARTS stretches one after another, then by
document and position: dealt out by range, document included, so that a suffix that a third of the documents share is
divided among tasks, and sorted within each. One pass compares neighbours: suffixes with all parts in common with one
of another document stay. The first and the last run of a task may go on in the next; these, a few rows from each
task, are settled by an aggregation.

Then matches are extended left and right: each suffix stands for the stretch of all passages of min_words words that
have their minimum there. Where a document's stretch does not match as a whole, it holds a passage's edge: there, and
only there, the passages of all documents with that suffix are compared one by one. Comparisons are of 64-bit hashes
of the words, counted before the shuffle, so a passage that a third of the documents share is one row from each task;
no pair of documents is ever formed.

Words are runs of letters, digits and non-ASCII characters, lower-cased in A-Z. Nulls: a null text has no
words; a null doc_id stays null. Rows that repeat both doc_id and text are one document. Ties: of equal minima the
first position counts. Texts of fewer than min_words words, empty ones too, have no passage; texts of any length are
worked through whole. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import in_arrow, scratch, words_by_row

MIN_WORDS, GRAM, SPREAD, PARTS = 50, 5, 24, 3
_A = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_A, -1, 1 << 64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse modulo 2**64, up to n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_A, _INVERSE)):
            p = np.full(max(n, 1 << 16), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Stream:
    """A document's words with hashes of any stretch of them."""

    def __init__(self, h: np.ndarray):
        up, self.down = _power(len(h) + 1)
        self.n, self.sums = len(h), np.concatenate([[np.uint64(0)], np.cumsum(h * up[:-1], dtype=np.uint64)])

    def hash(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        x = (self.sums[stop] - self.sums[start]) * self.down[start] + (stop - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))).view(np.int64)

    def retained(self, spread: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions p of the retained suffixes, ascending, each with the first and last start of the min_words
        words whose first `spread` grams have their minimum at p."""
        n = self.n - min_words + 1
        if n < 1:
            return (np.zeros(0, np.int64),) * 3
        at = np.arange(n + spread - 1)
        grams = self.hash(at, at + GRAM).view(np.uint64)
        least = np.empty(n, np.int64)
        for a in range(0, n, 1 << 16):
            z = min(a + (1 << 16), n)
            least[a:z] = np.lib.stride_tricks.sliding_window_view(grams[a : z + spread - 1], spread).argmin(axis=1) + np.arange(a, z)
        first = np.flatnonzero(np.diff(least, prepend=-1))
        return least[first], first, np.append(first[1:], n) - 1


def _map(df: DataFrame, make, names: list[str]) -> DataFrame:
    """Longs (rid and names) made by make(Stream, starts, ends, row's other columns) for each row of (rid, text, ...)."""

    def batches(it):
        for b in it:
            rids, out = b.column(0).to_pylist(), []
            rest = [b.column(i) for i in range(2, b.num_columns)]
            for row, starts, ends, h in words_by_row(b.column(1), punctuation=True):
                got = make(Stream(h), starts, ends, [c[row].as_py() for c in rest])
                if got is not None and len(got[0]):
                    out.append((np.full(len(got[0]), rids[row], np.int64), *got))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out, strict=True)], names=["rid", *names])

    return df.transform(in_arrow, batches, ", ".join(f"{c} long" for c in ["rid", *names]))


def _in_two_documents(rows: DataFrame, tag: str) -> DataFrame:
    """The keys that rows of different documents have, counted before the shuffle."""
    ends = rows.groupBy("key").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"))
    return scratch(ends.where(F.col("lo") != F.col("hi")).select("key"), tag)


def neighbours(it):
    """Of a task's sorted suffixes (parts, rid, p) those that a neighbour of another document equals, open = 0. Of its
    first and last run, which may go on elsewhere, the rows not settled here and the run's least and greatest rid
    (p = -1), open = 1."""

    def batch(*found):
        rows = np.concatenate([np.concatenate([a, np.full((1, a.shape[1]), flag, np.int64)]) for a, flag in found if a.shape[1]] or [np.zeros((PARTS + 3, 0), np.int64)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=[*(f"part{i}" for i in range(PARTS)), "rid", "p", "open"])

    def ends(run):
        out = run[:, [0, -1]].copy()
        out[-1] = -1
        return out

    held, emitted, shared, first = np.zeros((PARTS + 2, 0), np.int64), 0, False, True  # the run that may go on
    for b in it:
        a = np.concatenate([held, np.stack([c.to_numpy() for c in b.columns])], axis=1)
        if not a.shape[1]:
            continue
        begin = np.flatnonzero(np.concatenate([[True], (a[:PARTS, 1:] != a[:PARTS, :-1]).any(axis=0)]))
        stop = np.append(begin[1:], a.shape[1])
        equal = a[PARTS, begin] != a[PARTS, stop - 1]
        equal[0] |= shared
        keep = np.repeat(equal, stop - begin)
        keep[:emitted] = False
        out = [(a[:, keep], 0)]
        if len(begin) > 1 and first:
            run = a[:, : stop[0]]
            out.append((ends(run), 1))
            if not equal[0]:
                out.append((run, 1))
            first = False
        shared = bool(equal[-1])
        held = a[:, begin[-1] :]
        if shared:  # its rows are out; the least rid, for the run's ends, and the last row remain
            held = held[:, [0, -1]] if held.shape[1] > 1 else held
        emitted = held.shape[1] if shared else 0
        yield batch(*out)
    if held.shape[1]:
        yield batch((ends(held), 1), (held[:, emitted:], 1))


def shared_suffixes(kept: DataFrame) -> DataFrame:
    """(rid, p): the suffixes (parts, rid, p) that another document has too."""
    parts = [f"part{i}" for i in range(PARTS)]
    array = kept.repartitionByRange(*parts, "rid").sortWithinPartitions(*parts, "rid", "p").select(*parts, "rid", "p")
    found = scratch(array.transform(in_arrow, neighbours, ", ".join(f"{c} long" for c in [*parts, "rid", "p", "open"])), "neighbours")
    border = found.where("open = 1")
    both = border.groupBy(*parts).agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi")
    return found.where("open = 0").select("rid", "p").unionByName(border.where("p >= 0").join(both, parts, "left_semi").select("rid", "p"))


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, spread: int = SPREAD) -> DataFrame:
    """(doc_id, start_word, n_words, start_byte, n_bytes): the passages, as long as they go, all of whose runs of min_words words occur in another document too."""
    if min_words < spread + GRAM:
        raise ValueError("min_words must be spread + 5 at least")
    reach = min_words - spread + 1

    def suffixes(s: Stream, starts, ends, rest):
        p, _, _ = s.retained(spread, min_words)
        at = [reach * i // PARTS for i in range(PARTS + 1)]
        return *(s.hash(p + a, p + z) for a, z in zip(at[:-1], at[1:], strict=True)), p

    def extended(s: Stream, starts, ends, rest):
        p, first, last = s.retained(spread, min_words)
        own = np.isin(p, np.array(rest[0], dtype=np.int64))
        p, a, z = p[own], first[own], last[own] + min_words
        return s.hash(a, z), s.hash(p, p + reach), a, z, starts[a], ends[z - 1]

    def edges(s: Stream, starts, ends, rest):
        a, z = np.array(rest[0], dtype=np.int64), np.array(rest[1], dtype=np.int64)
        n = np.maximum(z - min_words - a + 1, 0)
        first = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return s.hash(first, first + min_words), first, first + min_words, starts[first], ends[first + min_words - 1]

    whole = docs.where("text is not null").select(F.xxhash64("doc_id", "text").alias("rid"), "text")
    kept = scratch(_map(whole, suffixes, [*(f"part{i}" for i in range(PARTS)), "p"]), "suffixes")
    flagged = scratch(shared_suffixes(kept).groupBy("rid").agg(F.collect_set("p").alias("p")), "shared-suffixes")
    texts = scratch(docs.where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("rid"), "text").join(flagged, "rid").dropDuplicates(["rid"]), "matched-texts")

    found = scratch(_map(texts.select("rid", "text", "p"), extended, ["key", "suffix", "a", "z", "byte", "end"]), "stretches")
    same = _in_two_documents(found.select("key", "rid"), "stretch-keys")
    inner = found.join(same, "key", "left_semi").select("rid", "a", "z", "byte", "end")
    # where one document's stretch stays alone, its passages may still lie within the stretches of all that share the suffix
    alone = scratch(found.join(same, "key", "left_anti").groupBy("suffix").agg(F.lit(1).alias("one")).select("suffix"), "alone")
    open_ = scratch(found.join(alone, "suffix", "left_semi").groupBy("rid").agg(F.collect_list(F.struct("a", "z")).alias("e")), "edges")
    parts = scratch(_map(texts.select("rid", "text").join(open_, "rid").select("rid", "text", "e.a", "e.z"), edges, ["key", "a", "z", "byte", "end"]), "passages")
    equal = _in_two_documents(parts.select("key", "rid"), "passage-keys")
    outer = parts.join(equal, "key", "left_semi").select("rid", "a", "z", "byte", "end")

    order = Window.partitionBy("rid").orderBy("a", "z")
    before = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = inner.unionByName(outer).withColumn("new", F.coalesce((F.col("a") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    spans = islands.groupBy("rid", "island").agg(F.min("a").alias("a"), F.max("z").alias("z"), F.min("byte").alias("byte"), F.max("end").alias("end"))
    return spans.join(texts.select("rid", "doc_id"), "rid").select("doc_id", F.col("a").alias("start_word"), (F.col("z") - F.col("a")).alias("n_words"), F.col("byte").alias("start_byte"), (F.col("end") - F.col("byte")).alias("n_bytes"))
