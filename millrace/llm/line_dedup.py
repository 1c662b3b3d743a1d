"""Line dedup by range-partitioned hashes with secondary sort; DataFrame functions only.

Each line's key is hashed to 128 bits. The hashes are dealt out by range and sorted by hash, document and
position, so that one pass over a partition meets the first occurrence of each key and its number of
documents. What comes back is no text but, for each document, the ranges of dropped lines: a run-length
compressed keep bitmap, which `apply_keep` lays over the text.

Keys with over a fixed share of all lines never enter that sort: their counts come from a pre-aggregation,
and as there can be at most HOT of them, they are broadcast.

Nulls: a null text is one empty line. Documents are rows: rows that repeat doc_id and text count as
separate documents and get equal bitmaps. Keys shorter than min_chars are always kept. Ties (a key more than once
in a document, or first in equal rows) fall by position and count once a document. Texts of any length are split
whole. Extra columns stay, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import ascii_lower, fresh, identity, scratch

STRIPPED = " \t\n\x0b\x0c\r"
HOT = 2048
PLACE = ("doc_id", "rid", "rid2", "pos")


def lines_of(text):
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, rid, rid2, h1, h2, pos, first): a row for each line whose key is long enough; first marks a key's first line in its document."""
    key = lambda x: ascii_lower(F.btrim(x, F.lit(STRIPPED)))
    hashed = F.transform(lines_of(F.col("text")), lambda x, i: F.struct(key(x).alias("k"), i.alias("pos")))
    if min_chars > 0:
        hashed = F.filter(hashed, lambda x: F.length(x["k"]) >= min_chars)
    hashed = F.transform(hashed, lambda x: F.struct(F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit(1), x["k"]).alias("h2"), x["pos"].alias("pos")))
    sorted_ = docs.select("doc_id", *identity("doc_id", "text"), F.array_sort(hashed).alias("ls"))
    marked = F.transform(
        "ls",
        lambda x, i: F.struct(
            x["h1"].alias("h1"),
            x["h2"].alias("h2"),
            x["pos"].alias("pos"),
            F.when((i > 0) & (F.get("ls", i - 1)["h1"] == x["h1"]) & (F.get("ls", i - 1)["h2"] == x["h2"]), 0).otherwise(1).alias("first"),
        ),
    )
    return sorted_.select("doc_id", "rid", "rid2", F.explode(marked).alias("l")).select("doc_id", "rid", "rid2", "l.*")


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(rid, rid2, dropped): ranges [start, length] of the lines to drop, for documents that lose any.

    A key in min_docs documents or more loses all its lines, or all but the first in order of document and
    position if keep_first; rows that repeat doc_id and text are first together, as they share a bitmap.
    """
    lines = scratch(line_rows(docs, min_chars), "lines")
    counts = lines.groupBy("h1", "h2").agg(F.sum("first").alias("df"), F.count("*").alias("n"), F.min(F.struct(*PLACE)).alias("lead"))
    total = lines.count()
    hot = scratch(counts.where(F.col("n") > F.lit(total) / HOT), "hot-lines")  # at most HOT rows
    key = ["h1", "h2"]
    w = Window.partitionBy(*key)
    streamed = (
        lines.join(F.broadcast(hot.select(*key)), key, "left_anti")
        .repartitionByRange(*key)
        .sortWithinPartitions(*key, *PLACE)
        .withColumn("df", F.sum("first").over(w))
        .withColumn("least", F.min(F.struct(*PLACE)).over(w))
        .select("rid", "rid2", "pos", "df", F.struct(*PLACE).eqNullSafe(F.col("least")).alias("lead"))
    )
    common = lines.join(F.broadcast(hot), key).select("rid", "rid2", "pos", "df", (F.struct(*PLACE).eqNullSafe(F.col("lead"))).alias("lead"))
    out = streamed.unionByName(common).where(F.col("df") >= min_docs)
    if keep_first:
        out = out.where(~F.col("lead"))
    drops = out.groupBy("rid", "rid2").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    starts = F.filter("p", lambda x, i: (i == 0) | (F.get("p", i - 1) != x - 1))
    ends = F.filter("p", lambda x, i: (i == F.size("p") - 1) | (F.get("p", i + 1) != x + 1))
    return drops.select("rid", "rid2", F.zip_with(starts, ends, lambda a, z: F.struct(a.alias("start"), (z - a + 1).alias("length"))).alias("dropped"))


def line_keep(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, name: str = "__dropped") -> DataFrame:
    """docs with a column of that name: array<struct<start, length>>, empty where all lines stay; it replaces one of docs."""
    docs = docs.drop(name)
    bitmaps = scratch(repeated_lines(docs, min_docs, min_chars, keep_first), "bitmaps")
    a, b = fresh(docs, "__rid", "__rid2")
    tagged = docs.select(*docs.columns, *(c.alias(n) for n, c in zip((a, b), identity("doc_id", "text"), strict=True)))
    bitmaps = bitmaps.select(F.col("rid").alias(a), F.col("rid2").alias(b), F.col("dropped").alias(name))
    none = F.array().cast("array<struct<start:int,length:int>>")
    return tagged.join(bitmaps, [a, b], "left").withColumn(name, F.coalesce(name, none)).select(*docs.columns, name)


def apply_keep(text, dropped):
    """The text without its dropped ranges of lines; ranges are sorted and do not touch."""
    ls = lines_of(text)
    begins = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda r: r["start"] + r["length"]))
    ends = F.concat(F.transform(dropped, lambda r: r["start"]), F.array(F.size(ls)))
    kept = F.flatten(F.zip_with(begins, ends, lambda a, z: F.slice(ls, a + 1, z - a)))
    return F.when(F.size(dropped) == 0, F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))
