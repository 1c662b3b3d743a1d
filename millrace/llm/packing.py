"""Best-fit packing with large-item matching.

Texts are tokenised whole; a document is its ids and an end id. Documents beyond the capacity are cut into
full pieces, the remainder first. What is left is packed by length: the counts of each length (as many
numbers as the capacity) reach the driver, which plans kinds of bins and how often each is used. Pieces
above a third of the capacity go at most two to a bin, each with the largest partner that still fits;
smaller ones go, longest first, into the smallest gap that takes them. The plan's size depends on the
capacity, not on the number of documents. A piece finds its place by its length and its rank among the
pieces of that length; ranks are counted within partitions and then moved by the earlier partitions' counts.

Nulls: a null text is empty, a document of the end id alone. A null doc_id stays null. Repeated rows are
packed each. Ties: pieces of one length are alike to the plan and take their places in order of their partition. A text
of any length is tokenised whole. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import CHUNK, byte_values, in_arrow, pieces_of, scratch, sliced, spans_hash, text_buffers

CAPACITY, END_ID = 1024, 2
#: Units whose ids a worker remembers, beyond which it starts anew; bytes of a unit worth remembering.
REMEMBERED, LONG = 1_000_000, 64


def _table(bytes_: str | bytes) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(bytes_ if isinstance(bytes_, bytes) else bytes_.encode("latin-1"))] = True
    return t


_PRINTED = _table(bytes(range(33, 127)))
_LETTER = _table(string.ascii_letters)
_SIGN = _table(string.punctuation)
#: Bytes that begin a character which is no white space: all but those that lead U+0080 to U+00BF or U+1000 to U+3FFF.
_NEXT = _PRINTED | _table(bytes(x for x in range(0xC3, 0xF5) if x not in (0xE1, 0xE2, 0xE3)))


def _solid(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends at the byte `at` is surely no white space."""
    last, second, third = b[at], b[np.maximum(at - 1, 0)], b[np.maximum(at - 2, 0)]
    two, three = (second >= 0xC3) & (second < 0xE0) & (at > 0), (second >= 0x80) & (second < 0xC0) & (at > 1)
    return _PRINTED[last] | ((last >= 0x80) & (last < 0xC0) & (two | (three & _NEXT[third] & (third >= 0xE0)) | (three & (third >= 0x80) & (third < 0xC0))))


class Encoder:
    """Ids of whole texts by a byte-level BPE tokenizer, whose merges never go over the start of a new word.

    A text is cut before single spaces, on both sides of single line ends, and between a letter and a sign, which
    are ends of words to such a tokenizer; repeated units are encoded once, and the ids are put together again.
    Units are found by a hash and then compared byte by byte. Longer ones than LONG are encoded anew each time. A
    tokenizer of another make, or one whose added tokens hold or swallow white space, gets whole texts.
    """

    _own: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        self.splits = safe_to_split(made)
        self.added = [t["content"].encode() for t in made.get("added_tokens", [])]
        self.values = byte_values(False)
        if self.splits:
            self.widths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in made["model"]["vocab"].items():
                self.widths[i] = len(token)  # a character of the vocabulary stands for a byte
            for t in made.get("added_tokens", []):
                self.widths[t["id"]] = len(t["content"].encode())
        self.forget()

    @classmethod
    def at(cls, path: str) -> "Encoder":
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def forget(self) -> None:
        self.known, self.number = np.zeros(0, np.int64), np.zeros(0, np.int64)  # hashes of units, sorted, and the units' numbers among off and raw_off
        self.off, self.ids = Grown(np.int64, [0]), Grown(np.uint32)
        self.raw_off, self.raw = Grown(np.int64, [0]), Grown(np.uint8)

    def breaks(self, b: np.ndarray) -> np.ndarray:
        """Where a unit may begin."""
        if not self.splits or len(b) < 2:
            return np.zeros(0, np.int64)
        gap = np.flatnonzero((b[1:-1] == 32) | (b[1:-1] == 10)) + 1
        gap = gap[_NEXT[b[gap + 1]] & _solid(b, gap - 1)]
        sign = np.flatnonzero(_LETTER[b[:-1]] & _SIGN[b[1:]]) + 1
        at = np.sort(np.concatenate([gap, gap[b[gap] == 10] + 1, sign]))
        for token in self.added:  # none within an added token
            raw, k = b.tobytes(), -1
            while (k := raw.find(token, k + 1)) >= 0:
                at = at[(at <= k) | (at >= k + len(token))]
        return at

    def cut(self, buf: np.ndarray, at: int, end: int) -> int:
        """Divides a long text at a single space near CHUNK bytes from its start."""
        step, to = CHUNK // 2, at + CHUNK // 2
        while to < end:
            b = buf[to - 4 : min(to + step, end)]
            hits = self.breaks(b)
            hits = hits[(hits > 3) & (b[hits] == 32)]
            if len(hits):
                return to - 4 + int(hits[0])
            to += step - 4
        return end

    def encode(self, col: pa.Array):
        """Yields (row, ids, is the row's last part) in order."""
        buf, offsets = text_buffers(col)
        for group in pieces_of(buf, offsets, self.cut):
            lo = np.array([g[1] for g in group], dtype=np.int64)
            base, end = int(lo[0]), group[-1][2]
            b = buf[base:end]
            hi = np.array([g[2] for g in group], dtype=np.int64) - base
            lo = lo - base
            begin = np.zeros(len(b), bool)
            begin[self.breaks(b)] = True
            begin[lo[hi > lo]] = True
            starts = np.flatnonzero(begin)
            ends = np.append(starts[1:], len(b)) if len(starts) else starts
            code = self.learn(b, starts, ends)
            off = self.off.array()
            lens = off[code + 1] - off[code]
            total = np.concatenate([[0], np.cumsum(lens)])
            place = np.repeat(off[code] - total[:-1], lens) + np.arange(total[-1])
            ids = self.ids.array()[place]
            of = np.searchsorted(starts, np.stack([lo, hi]))
            for (row, _, stop), a, z in zip(group, total[of[0]], total[of[1]], strict=True):
                yield row, ids[a:z], stop == offsets[row + 1]

    def learn(self, b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each unit, after new ones have been added."""
        if not len(starts):
            return np.zeros(0, np.int64)
        from pandas import factorize  # on the workers only

        if len(self.known) > REMEMBERED or self.ids.n > 16 * REMEMBERED:
            self.forget()
        h = spans_hash(b, starts, ends, self.values)[0].view(np.int64)
        code, uniq = factorize(h)
        first = np.empty(len(uniq), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        odd = np.flatnonzero(~same_bytes(b, starts, ends, b, starts[first[code]], ends[first[code]]))
        if len(odd):  # equal hashes of different bytes: units of their own, not remembered
            code[odd] = len(first) + np.arange(len(odd))
            first = np.concatenate([first, odd])
        s, e, n = starts[first], ends[first], len(uniq)
        mine = np.full(len(first), -1, np.int64)
        if len(self.known):
            at = np.minimum(np.searchsorted(self.known, uniq), len(self.known) - 1)
            mine[:n] = np.where(self.known[at] == uniq, self.number[at], -1)
        hit = np.flatnonzero(mine >= 0)
        raw_off = self.raw_off.array()
        false = hit[~same_bytes(b, s[hit], e[hit], self.raw.array(), raw_off[mine[hit]], raw_off[mine[hit] + 1])]
        mine[false] = -1
        new = np.flatnonzero(mine < 0)
        if len(new):
            order, lens, ids = self.fresh(b, s[new], e[new])
            new = new[order]
            mine[new] = self.off.n - 1 + np.arange(len(new))
            self.off.add(self.ids.n + np.cumsum(lens))
            self.ids.add(ids)
            short = (e[new] - s[new] <= LONG) & (new < n) & ~np.isin(new, false)
            kept = np.where(short, e[new] - s[new], 0)
            self.raw_off.add(self.raw.n + np.cumsum(kept))
            self.raw.add(b[flat(s[new], kept)])
            key = uniq[new[short]]
            by = np.argsort(key)
            at = np.searchsorted(self.known, key[by])
            self.known, self.number = np.insert(self.known, at, key[by]), np.insert(self.number, at, mine[new[short]][by])
        return mine[code]

    def fresh(self, b: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the units, the number of ids of each in that order, and the ids. Units that may stand side by
        side go through the tokenizer as one text, which is quicker; the tokens' widths tell where each ends."""
        left, done = np.ones(len(s), bool), []
        if self.splits:
            whole = _solid(b, e - 1)
            spaced = (b[s] == 32) & (e - s > 1) & _NEXT[b[np.minimum(s + 1, len(b) - 1)]] & whole
            for own, gap in ((np.flatnonzero(spaced), 0), (np.flatnonzero(_NEXT[b[s]] & whole), 1)):  # the latter behind line ends
                lens = (e - s)[own]
                stop = np.cumsum(lens + gap)
                joined = np.full(int(lens.sum()) + gap * len(lens), 10, np.uint8)
                joined[flat(stop - lens, lens)] = b[flat(s[own], lens)]
                try:
                    text = joined.tobytes().decode()
                except UnicodeDecodeError:
                    continue
                ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                end = np.concatenate([[0], np.cumsum(self.widths[ids])])
                a, z = (np.minimum(np.searchsorted(end, x), len(ids)) for x in (stop - lens, stop))
                fits = (end[a] == stop - lens) & (end[z] == stop)
                own, a, z = own[fits], a[fits], z[fits]
                left[own] = False
                done.append((own, z - a, ids[flat(a, z - a)]))
        rest = np.flatnonzero(left)
        texts = [b[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(s[rest].tolist(), e[rest].tolist(), strict=True)]
        got = [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        done.append((rest, np.array([len(x) for x in got], np.int64), np.concatenate([np.zeros(0, np.uint32), *got])))
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


class Grown:
    """An array that grows at its end, by doubling."""

    def __init__(self, kind, first=()):
        self.held, self.n = np.empty(1024, kind), 0
        self.add(np.array(first, kind))

    def add(self, more: np.ndarray) -> None:
        if self.n + len(more) > len(self.held):
            held = np.empty(2 * (self.n + len(more)), self.held.dtype)
            held[: self.n] = self.held[: self.n]
            self.held = held
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)

    def array(self) -> np.ndarray:
        return self.held[: self.n]


def flat(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places of all spans, one span after another."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))


def same_bytes(a: np.ndarray, s: np.ndarray, e: np.ndarray, b: np.ndarray, t: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Whether the spans [s, e) of a hold the same bytes as the spans [t, f) of b."""
    same = e - s == f - t
    other = np.flatnonzero(same & ((s != t) if a is b else True))
    lens = (e - s)[other]
    differs = np.flatnonzero(a[flat(s[other], lens)] != b[flat(t[other], lens)])
    if len(differs):
        same[other[np.searchsorted(np.cumsum(lens), differs, side="right")]] = False
    return same


def safe_to_split(made: dict) -> bool:
    """Whether a tokenizer, by its own description, is byte-level BPE whose tokens never go on over a single space."""
    pre = made.get("pre_tokenizer") or {}
    plain = made["model"].get("type") == "BPE" and not made.get("normalizer") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    return bool(plain) and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in made.get("added_tokens", []))


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Lengths of a document's pieces: the remainder first, then full ones."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


def tokenised(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, part, and nth, the place among the part's pieces of its length."""

    def batches(it):
        enc, seen, end = Encoder.at(tokenizer), defaultdict(int), np.array([end_id], np.uint32)
        for batch in sliced(it):
            out, held = defaultdict(list), []
            part = batch.column(2)[0].as_py() if len(batch) else 0
            for row, ids, last in enc.encode(batch.column(1)):
                held.append(ids)
                if not last:
                    continue
                ids = np.concatenate([*held, end])
                held, at = [], 0
                for k, n in enumerate(cut_lengths(len(ids), capacity)):
                    own = ids[at : at + n]
                    for name, v in (("row", row), ("piece", k), ("start", at), ("length", n), ("ids_crc32", zlib.crc32(own.astype("<u4").tobytes())), ("nth", seen[n])):
                        out[name].append(v)
                    if with_ids:
                        out["ids"].append(own.astype(np.int64))
                    seen[n] += 1
                    at += n
            doc = batch.column(0).take(pa.array(out["row"], pa.int64()))
            cols = [doc, *(pa.array(out[c], pa.int32() if c == "piece" else pa.int64()) for c in ("piece", "start", "length", "ids_crc32", "nth")), pa.array([part] * len(doc), pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "nth", "part"]
            if with_ids:
                cols, names = [*cols, pa.array(out["ids"], pa.list_(pa.int64()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, nth long, part int" + ", ids array<long>" * with_ids
    return docs.select("doc_id", "text", F.spark_partition_id().alias("part")).transform(in_arrow, batches, schema)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Kinds of bins as (how many, lengths) for counts[length] pieces of each length below the capacity."""
    left = counts.astype(np.int64).copy()
    gaps: dict[int, list[list]] = defaultdict(list)  # gap: kinds of bins [how many, lengths]
    large = capacity // 3 + 1
    for a in range(capacity - 1, large - 1, -1):  # greedy matching, largest first
        while left[a]:
            b = min(a, capacity - a)
            while b >= large and not left[b] - (b == a and left[a] < 2):
                b -= 1
            if b < large:
                gaps[capacity - a].append([int(left[a]), [a]])
                left[a] = 0
            else:
                n = int(left[a] // 2 if a == b else min(left[a], left[b]))
                left[a] -= n
                left[b] -= n
                gaps[capacity - a - b].append([n, [a, b]])
    for a in range(min(large - 1, capacity - 1), 0, -1):  # best fit, longest first
        while left[a]:
            gap = next((g for g in range(a, capacity) if gaps.get(g)), None)
            if gap is None:
                each = capacity // a
                full, rest = divmod(int(left[a]), each)
                if full:
                    gaps[capacity - each * a].append([full, [a] * each])
                if rest:
                    gaps[capacity - rest * a].append([1, [a] * rest])
                left[a] = 0
                continue
            kind = gaps[gap][-1]
            each = gap // a
            n, rest = min(kind[0], int(left[a]) // each), each
            if not n:
                n, rest = 1, int(left[a])
            kind[0] -= n
            if not kind[0]:
                gaps[gap].pop()
            gaps[gap - rest * a].append([n, kind[1] + [a] * rest])
            left[a] -= n * rest
    return [(n, lengths) for kinds in gaps.values() for n, lengths in kinds]


def places(bins: list[tuple[int, list[int]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: the first rank of each run of pieces, the sequence of that rank, the offset in it."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    sequence = 0
    for n, lengths in bins:
        offset = 0
        for a in lengths:
            runs[a].append((rank[a], sequence, offset))
            rank[a] += n
            offset += a
        sequence += n
    return {a: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for a, r in runs.items()}


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """All pieces with sequence_id and offset; with_ids adds the ids themselves."""
    spark = docs.sparkSession
    pieces = scratch(tokenised(docs, tokenizer, capacity, end_id, with_ids), "pieces")
    short = pieces.where(F.col("length") < capacity)
    parts = scratch(short.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in parts.groupBy("length").agg(F.sum("n")).collect():  # fewer rows than the capacity
        counts[length] = n
    found = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = scratch(parts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")), "bases")

    def seat(it):
        for b in it:
            length, rank = (b.column(k).to_numpy(zero_copy_only=False) for k in ("length", "rank"))
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for i in range(len(edges) - 1):
                own = order[edges[i] : edges[i + 1]]
                begin, seq, off = found.value[int(length[own[0]])]
                run = np.searchsorted(begin, rank[own], side="right") - 1
                sequence[own], offset[own] = seq[run] + rank[own] - begin[run], off[run]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(sequence), pa.array(offset)], names=[*out, "sequence_id", "offset"])

    out = [c for c in pieces.columns if c not in ("part", "nth")]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name in out)
    # a merge join: bases has a row for each partition and length, too many to broadcast where there are many partitions
    seated = short.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth")).transform(in_arrow, seat, f"{kinds}, sequence_id long, offset long")
    # full pieces fill a sequence each, numbered below zero by their part and their place in it
    whole = pieces.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - (F.col("nth") + F.col("part").cast("long") * (1 << 40)), "offset": F.lit(0).cast("long")})
    return seated.unionByName(whole.select(*seated.columns))
