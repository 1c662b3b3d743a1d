"""SimHash near-duplicates with pigeonring filtering.

Fingerprints: 64 bits over XXH64 hashes of word shingles. Two fingerprints within 3 bits, cut into a ring of
16 segments of 4 bits, must have a segment from which every chain of l consecutive segments differs in at
most 3 l / 16 bits in all: no bit over 5 segments, one over 10, two over 15. So each fingerprint is listed
at 16 ring positions under its 20 bits that must agree; as the next 20 bits differ in one bit at most, one
half of them agrees too and lengthens the key to 30 bits. Pairs that meet pass the chain budgets, then the
full Hamming check, inside the join: only links leave it. Equal fingerprints are one before all that.

Fingerprints of texts at 0.8 Jaccard differ in 7 to 10 bits on average, too many for any list of agreeing bits.
So `alike` brings texts together by BANDS bands of BAND min-hashes of their shingles (one band at least for 0.9996 of
the pairs at 0.8) and checks the exact Jaccard similarity of the shingle sets. Inside the join an odd sketch drops pairs
before that: the parity of a text's distinct shingles in each of BITS bins. Two sketches differ in no more bins than the
sets differ in shingles, which sets of known sizes at 0.8 bound: up to BITS shingles this loses no pair. Of longer texts
a half, a quarter and so on is sketched, chosen by hash, and the bound is five standard deviations wider (a pair at 0.8 is
lost less than once in 200,000). Pairs below 0.7 seldom pass (long texts: 0.6), so a group of texts that are like one
another but not linked leaves few pairs. Only bands whose texts are not all in one component are worked on. Each of
their texts is first compared with the least text of its level that it shares a band with; then each two components that
still meet, by their closest pair; then all pairs that meet and are in different components. The largest component of
a band is compared with the others only, never with itself, so a group of copies costs time in proportion to its size.

Nulls: a null text is empty; a text without words has the fingerprint 0 and is linked like any other. A null
doc_id keeps its row, never names a component while another id is there, and else gives null. Repeated rows
stay repeated. Ties: a bit that half of the hashes have is 0; of equal doc_ids the smaller text hash stays. Texts
of any length are worked through whole. Extra columns are ignored by `fingerprints`, kept by `drop_near_copies`,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import components, fresh, identity, in_arrow, scratch

SEGMENTS, WIDTH, MOST = 16, 4, 3
BLOCK = 1 << 16
BANDS, BAND = 20, 5
#: Bins of a sketch, and the most shingles that are sketched; both a power of two.
BITS = 1 << 10
#: Identities that are broadcast at most; more of them are shuffled with the texts.
SMALL = 1 << 20


def hashes(text: str | None, shingle: int):
    """Yields blocks of XXH64 hashes of the text's word shingles, repeats included; a shorter text is one shingle."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return
    if len(w) < shingle:
        grams, n = iter([b" ".join(w)]), 1
    else:
        grams, n = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)), len(w) - shingle + 1
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        size = min(BLOCK, n - at)
        yield np.fromiter((digest(g, 42) for g, _ in zip(grams, range(size), strict=False)), dtype=np.uint64, count=size)


def fingerprint(blocks) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes; repeats count."""
    n, ones = 0, np.zeros(64, dtype=np.int64)
    for h in blocks:
        n += len(h)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def bands(blocks) -> list[int]:
    """A hash of each band of min-hashes; none for a text without words."""
    least = None
    odd = np.random.default_rng(20240611).integers(1, 2**63, BANDS * BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for h in blocks:
        for part in np.array_split(h, len(h) // 4096 + 1):
            x = part[:, None] * odd
            low = (x ^ (x >> np.uint64(29))).min(axis=0)
            least = low if least is None else np.minimum(least, low)
    if least is None:
        return []
    b = (least * odd[::-1]).reshape(BANDS, BAND).sum(axis=1, dtype=np.uint64)
    return (b ^ (b >> np.uint64(31))).view(np.int64).tolist()


def _level(n: int) -> int:
    """So often are n shingles halved until BITS or fewer are left."""
    return max(0, (n - 1).bit_length() - BITS.bit_length() + 1)


def sketches(grams: np.ndarray, jaccard: float) -> list[list[int]]:
    """For a text's own level and those of longer texts that may be as similar: the level, then the words of the sketch.

    At level l only hashes that end in l zero bits are counted. A pair is compared at the higher of its own levels.
    """
    out = []
    for level in range(_level(len(grams)), _level(int(len(grams) / jaccard) + 1) + 1):
        some = grams[(grams & np.uint64((1 << level) - 1)) == 0]
        odd = np.bincount((some >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64), minlength=BITS) & 1
        out.append([level, *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()])
    return out


def fingerprints(docs: DataFrame, shingle: int = 5, banded: bool = False) -> DataFrame:
    """(doc_id, rid, rid2, fp): a signed 64-bit fingerprint of each whole text; rid and rid2 identify doc_id and text.

    If banded, also digest, a hash of all shingles with their repeats, and bands.
    """

    def batches(it):
        for b in it:
            fps, digests, found = [], [], []
            for x in b.column(3):
                blocks = list(hashes(x.as_py(), shingle))
                fps.append(fingerprint(blocks))
                if banded:
                    digests.append(int(sum((h.sum(dtype=np.uint64) for h in blocks), np.uint64(0)).view(np.int64)))
                    found.append(bands(blocks))
            more = [pa.array(digests, pa.int64()), pa.array(found, pa.list_(pa.int64()))] if banded else []
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(fps, pa.int64()), *more], names=["doc_id", "rid", "rid2", "fp", "digest", "bands"][: 4 + len(more)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = ", digest long, bands array<long>" if banded else ""
    return docs.select("doc_id", *identity("doc_id", "text"), "text").transform(in_arrow, batches, f"doc_id {kind}, rid long, rid2 long, fp long{more}")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _ring_mask(start: int, bits: int) -> int:
    """The bits of a fingerprint from segment `start` on, round the ring."""
    m, at = (1 << bits) - 1, start * WIDTH
    return ((m << at) | (m >> (64 - at))) & ((1 << 64) - 1)


def _lists() -> list[tuple[int, int, int]]:
    """For each inverted list: the bits that agree, then the chains over which one and two bits may differ."""
    out = []
    for i in range(SEGMENTS):
        five, ten, half = _ring_mask(i, 20), _ring_mask(i, 40), _ring_mask(i, 30)
        for agree in (half, five | (ten & ~half)):
            out.append((_signed(agree), _signed(ten), _signed(_ring_mask(i, 60))))
    return out


def links(fps: DataFrame, most: int = MOST) -> DataFrame:
    """(src, dst): all pairs src < dst of the distinct values fp that differ in at most `most` (1 to 3) bits.

    A pair that several lists bring together leaves the join from the first whose chains it passes.
    """
    if not 1 <= most <= MOST:
        raise ValueError("most must be 1 to 3")
    lists = _lists()
    keys = [F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(agree)).alias("part")) for k, (agree, _, _) in enumerate(lists)]
    listed = scratch(fps.select("fp", F.explode(F.array(*keys)).alias("l")).select("fp", "l.*"), "ring")
    x = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.coalesce(*(F.when((x.bitwiseAND(F.lit(agree)) == 0) & (F.bit_count(x.bitwiseAND(F.lit(ten))) <= 1) & (F.bit_count(x.bitwiseAND(F.lit(fifteen))) <= 2), k) for k, (agree, ten, fifteen) in enumerate(lists)))
    a, b = listed.alias("a"), listed.alias("b")
    met = (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.fp") < F.col("b.fp"))
    return a.join(b, met & (first == F.col("a.k")) & (F.bit_count(x) <= most)).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))


def _if_small(rows: DataFrame) -> DataFrame:
    """rows (a written table of identities), to be broadcast if there are SMALL or fewer of them."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def _shingle_sets(docs: DataFrame, wanted: DataFrame, shingle: int, jaccard: float) -> DataFrame:
    """(rid, n, grams, sketches): the distinct shingles of the wanted texts, as hashes, their number and sketches."""

    def batches(it):
        for b in it:
            sets = [np.unique(np.concatenate(list(hashes(x.as_py(), shingle)))) for x in b.column(1)]
            grams = pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))
            found = pa.array([sketches(x, jaccard) for x in sets], pa.list_(pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, sets), pa.int64()), grams, found], names=["rid", "n", "grams", "sketches"])

    texts = docs.select(identity("doc_id", "text")[0], "text").join(_if_small(wanted), "rid", "left_semi").dropDuplicates(["rid"])
    return texts.transform(in_arrow, batches, "rid long, n long, grams array<long>, sketches array<array<long>>")


def _check(pairs: DataFrame, sets: DataFrame, jaccard: float) -> DataFrame:
    """(src, dst): fingerprints of the pairs (rid, fp, other, ofp) of texts whose shingle sets are that similar."""
    pairs = pairs.select(F.least("rid", "other").alias("rid"), F.greatest("rid", "other").alias("other"), F.least("fp", "ofp").alias("src"), F.greatest("fp", "ofp").alias("dst"))
    pairs = scratch(pairs.groupBy("rid", "other").agg(F.first("src").alias("src"), F.first("dst").alias("dst")), "pairs")
    sets = sets.select("rid", "grams")
    both = pairs.join(sets, "rid").join(sets.select(F.col("rid").alias("other"), F.col("grams").alias("others")), "other")
    a, b = F.size("grams"), F.size("others")
    both = both.where(F.least(a, b) >= jaccard * F.greatest(a, b))
    common = F.size(F.array_intersect("grams", "others"))
    return scratch(both.where(common >= jaccard * (a + b - common)).select("src", "dst").distinct(), "alike")


def alike(rows: DataFrame, docs: DataFrame, shingle: int, jaccard: float, known: DataFrame) -> DataFrame:
    """known, links (src, dst) of fingerprints, and those of the texts with at least that Jaccard similarity of shingles.

    Texts that are in one component anyway need not be linked to each other.
    """
    texts = scratch(rows.where(F.size("bands") > 0).groupBy("fp", "digest").agg(F.min("rid").alias("rid"), F.first("bands").alias("bands")), "texts")
    listed = scratch(texts.select(F.posexplode("bands").alias("k", "part"), "rid"), "bands")
    shared = listed.groupBy("k", "part").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo <> hi").select("k", "part")
    listed = scratch(listed.join(shared, ["k", "part"], "left_semi"), "shared-bands")
    texts = texts.select("rid", "fp")

    def mixed(found: DataFrame) -> DataFrame:
        """(k, part, rid, fp, root, big): the texts of the bands that hold several components, and the band's largest component."""
        root = components(found, "alike").select(F.col("id").alias("fp"), F.col("component").alias("root"))
        rooted = scratch(texts.join(root, "fp", "left").select("rid", "fp", F.coalesce("root", "fp").alias("root")), "rooted")
        rooted = scratch(listed.join(rooted, "rid"), "rooted-bands")
        sizes = rooted.groupBy("k", "part", "root").agg(F.count("*").alias("n"))
        several = sizes.groupBy("k", "part").agg(F.max(F.struct("n", "root")).alias("big"), F.count("*").alias("roots")).where("roots > 1").select("k", "part", F.col("big.root").alias("big"))
        return scratch(rooted.join(several, ["k", "part"]), "mixed-bands")

    band = mixed(known)  # later rounds have no other texts than these
    sets = scratch(_shingle_sets(docs, scratch(band.select("rid").distinct(), "wanted"), shingle, jaccard), "sets")
    words = [f"w{i}" for i in range(BITS // 64)]
    sketched = sets.select("rid", "n", F.col("sketches")[0][0].alias("own"), F.explode("sketches").alias("w"))
    sketched = scratch(sketched.select("rid", "n", "own", F.col("w")[0].alias("level"), *(F.col("w")[i + 1].alias(w) for i, w in enumerate(words))), "sketches")

    def marked(band: DataFrame) -> DataFrame:
        """(k, part, level, t, big): the same with the texts' sketches."""
        return scratch(band.join(sketched, "rid").select("k", "part", "level", F.struct("rid", "fp", "root", "n", "own", *words).alias("t"), "big"), "marked-bands")

    far = sum(F.bit_count(F.col(f"t.{w}").bitwiseXOR(F.col(f"o.{w}"))) for w in words)
    t, o, level = F.col("t.n"), F.col("o.n"), F.greatest("t.own", "o.own")
    differ = (t + o) * ((1 - jaccard) / (1 + jaccard))  # most shingles that one of two such texts has and the other has not
    sampled = differ * F.pow(F.lit(0.5), level)
    bound = F.when(level == 0, differ + 1e-6).otherwise(sampled + 5 * F.sqrt(sampled))
    apart = (F.col("t.root") != F.col("o.root")) & (F.least(t, o) >= jaccard * F.greatest(t, o)) & (far <= bound)
    pair = [F.col("t.rid"), F.col("t.fp"), F.col("o.rid").alias("other"), F.col("o.fp").alias("ofp")]

    def check(found: DataFrame, pairs: DataFrame) -> DataFrame:
        return scratch(found.unionByName(_check(pairs, sets, jaccard)), "found")

    def meetings(rows: DataFrame) -> DataFrame:
        """The pairs of texts of different components in a band; of the largest component only with the others."""
        a, b = rows.where("t.root <> big").alias("a"), rows.withColumnRenamed("t", "o").alias("b")
        met = (F.col("a.k") == F.col("b.k")) & (F.col("a.part") == F.col("b.part")) & (F.col("a.level") == F.col("b.level")) & (F.col("a.level") == level)
        once = (F.col("o.root") == F.col("b.big")) | (F.col("t.rid") < F.col("o.rid"))
        return a.join(b, met & once & apart).select(*pair, F.least("t.root", "o.root").alias("lower"), F.greatest("t.root", "o.root").alias("upper"), (far / sampled).alias("far"))

    band = marked(band)
    least = scratch(band.groupBy("k", "part", "level").agg(F.min("t").alias("o")), "least")
    near = band.join(least, ["k", "part", "level"]).where((F.col("level") == level) & apart)
    found = check(known, near.groupBy("t.rid", "t.fp").agg(F.min(F.struct("o.rid", "o.fp")).alias("m")).select("rid", "fp", F.col("m.rid").alias("other"), F.col("m.fp").alias("ofp")))
    closest = meetings(marked(mixed(found))).groupBy("lower", "upper").agg(F.min(F.struct("far", "rid", "fp", "other", "ofp")).alias("m"))
    found = check(found, closest.select("m.rid", "m.fp", "m.other", "m.ofp"))
    return check(found, meetings(marked(mixed(found))).select("rid", "fp", "other", "ofp"))


def near_copies(docs: DataFrame, shingle: int = 5, most: int = MOST, jaccard: float | None = None) -> DataFrame:
    """(doc_id, rid, rid2, fp, root, component_id): root is the component's fingerprint, component_id is the smallest doc_id that links reach.

    With jaccard, texts whose shingle sets are that similar are linked too, however many bits they differ in.
    """
    rows = scratch(fingerprints(docs, shingle, banded=jaccard is not None), "fingerprints")
    classes = scratch(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    edges = links(classes.select("fp"), most)
    if jaccard is not None:
        edges = alike(rows, docs, shingle, jaccard, scratch(edges, "ring-links"))
    found = components(edges, "simhash").select(F.col("id").alias("fp"), F.col("component").alias("root"))
    rooted = classes.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch(rooted, "rooted")
    named = scratch(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "named")
    of_fp = scratch(rooted.join(named, "root").select("fp", "root", "component_id"), "components")
    return rows.join(of_fp, "fp").select("doc_id", "rid", "rid2", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = 5, most: int = MOST, jaccard: float | None = None) -> DataFrame:
    """docs with one row for each component: of its rows with the smallest doc_id (nulls last) the one with the smallest text hash."""
    found = near_copies(docs, shingle, most, jaccard)
    texts = scratch(found.groupBy("root", "rid", "rid2").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("n")), "copies")
    best = texts.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid", "rid2", "n")).alias("m"))
    kept = scratch(best.select("m.rid", "m.rid2", "m.n"), "kept")
    a, b = fresh(docs, "__rid", "__rid2")
    names = (F.col("rid").alias(a), F.col("rid2").alias(b))
    repeated = scratch(kept.where("n > 1").select(*names), "repeated")
    other = scratch(texts.join(kept, ["rid", "rid2"], "left_anti").select(*names).union(repeated), "dropped")
    tagged = docs.select(*docs.columns, *(c.alias(n) for n, c in zip((a, b), identity("doc_id", "text"), strict=True)))
    once = tagged.join(_if_small(other), [a, b], "left_anti").select(*docs.columns)
    # rows that repeat both doc_id and text: one of them
    return once.union(tagged.join(_if_small(repeated), [a, b], "left_semi").dropDuplicates([a, b]).select(*docs.columns))
