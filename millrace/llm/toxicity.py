"""Toxic spans by a linear-chain conditional random field.

Only documents carry labels, so token labels come from them: over a bounded sample of labelled rows, words
and word beginnings get the log-odds of occurring in toxic rather than clean documents; in a toxic document
the tokens with the highest odds are the toxic ones. A two-state CRF (bins of those odds, how the best
evidence matched, word length, transitions between neighbours) is then trained on windows of such tokens,
each token's own document left out of its odds. Scoring runs forward-backward over each sentence of the
whole text; the marginals give the offending offsets, the largest of them, calibrated on the documents of the
sample, the document's score.

The fit sees at most MAX_ROWS labelled rows of each class and keeps the LEXICON word forms that tell most; all of
these rows train the chain, in small lots. Scoring sees all rows and whole texts; a sentence of more than 16 MiB is
divided.

Nulls: a null text is empty and gets the score 0.0; a null doc_id counts as held out. Labels that are null are
ignored, repeated ones count as their maximum. Without labels of both classes, or without a word in the labelled
texts, all scores are 0. Ties: of equal odds the shorter form of a token counts, of equal forms the one with the
smallest hash stays. Repeated rows are scored each; extra columns stay in `score`, except for those with the new
columns' names. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import in_arrow, scratch, text_buffers, words

MAX_ROWS, LEXICON, WINDOW, LOT = 16_384, 65_536, 24, 2048
BEGINNINGS = (4, 5, 6)
BINS = np.array([0.5, 1.5, 2.5, 3.25, 4.0, 4.75, 5.5, 6.25, 7.0, 8.0])
ENDERS = np.zeros(256, dtype=bool)
ENDERS[list(b"\n.!?")] = True


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


@dataclass
class Crf:
    """hashes: sorted 64-bit word forms; toxic, clean: documents that hold them; totals: documents of each class."""

    hashes: np.ndarray
    toxic: np.ndarray
    clean: np.ndarray
    totals: tuple[int, int]
    emit: np.ndarray | None = None
    move: np.ndarray | None = None  # log weights of start and of the four moves
    scale: tuple[float, float] = (1.0, 0.0)  # a document's log-odds from those of its largest marginal

    def odds(self, toxic, clean):
        return np.log((toxic + 0.5) / (self.totals[0] + 1)) - np.log((clean + 0.5) / (self.totals[1] + 1))

    def lookup(self, forms: list[np.ndarray], label: np.ndarray | None = None):
        """The best odds over each token's forms, and which form had them; label leaves the token's own document out."""
        best, kind = np.zeros(len(forms[0])), np.zeros(len(forms[0]), np.int8)
        if not len(self.hashes):
            return best, kind
        seen = self.filter()
        for k, h in enumerate(forms):
            at = np.flatnonzero(seen[(h & np.uint64(0xFFFFF)).astype(np.int64)])
            if not len(at):
                continue
            i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
            hit = self.hashes[i] == h[at]
            at, i = at[hit], i[hit]
            toxic, clean = self.toxic[i].astype(float), self.clean[i].astype(float)
            if label is not None:
                own = label[at]
                toxic, clean = toxic - (own == 1), clean - (own == 0)
            s = self.odds(np.maximum(toxic, 0), np.maximum(clean, 0))
            better = s > best[at]
            best[at[better]], kind[at[better]] = s[better], k + 1
        return best, kind

    def filter(self) -> np.ndarray:
        if not hasattr(self, "_seen"):
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self._seen = seen
        return self._seen

    def score(self, feats: np.ndarray) -> np.ndarray:
        return self.emit[feats].sum(axis=1)

    def of_document(self, top: np.ndarray) -> np.ndarray:
        """Scores of documents from their largest marginals; no marginal at all gives 0."""
        a, b = self.scale
        return np.where(top > 0, 1 / (1 + np.exp(-np.clip(a * logit(top) + b, -40, 40))), 0.0)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-12, 1 - 1e-12)
    return np.log(p) - np.log1p(-p)


def calibrate(top: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic fit of document labels on the logits of their largest marginals.

    Of the many words of a document one is bound to look bad, the more so the fewer labels there are; the
    marginals, each token's own document left out, show how far. A small penalty holds the fit near (1, 0).
    """
    x, w = np.stack([logit(top), np.ones(len(top))], axis=1), np.array([1.0, 0.0])
    loss = lambda w: np.logaddexp(0, np.where(label > 0, -1, 1) * (x @ w)).sum() + 0.5 * ((w - (1.0, 0.0)) ** 2).sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.eye(2), x.T @ (p - label) + w - (1.0, 0.0))
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-6:
            step = step / 2
        w = w - step
    return (float(w[0]), float(w[1])) if w[0] > 0.05 and np.isfinite(w).all() else (1.0, 0.0)


N_FEATURES = 1 + (len(BINS) + 1) + (len(BEGINNINGS) + 2) + 4


def features(best: np.ndarray, kind: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Four active features for each token: bias, bin of the odds, kind of evidence, length."""
    a = 1 + np.digitize(best, BINS)
    b = 2 + len(BINS) + kind
    c = 2 + len(BINS) + len(BEGINNINGS) + 2 + np.digitize(length, [3, 6, 10])
    return np.stack([np.zeros(len(a), np.int64), a, b, c], axis=1)


def marginals(gain: np.ndarray, starts: np.ndarray, lens: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for each token; sequences are gain[s : s + n], gain the log emission ratio.

    Forward and backward ratios of the two states run over all sequences at once, the longest first.
    """
    g = np.exp(np.clip(gain, -40, 40))
    begin, m00, m01, m10, m11 = np.exp(move)
    order = np.argsort(-lens, kind="stable")
    s, n = starts[order], lens[order]
    out = np.empty(len(g))
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), side="right")
    r = np.zeros(len(n))
    for t, k in enumerate(active.tolist()):
        at = s[:k] + t
        r = g[at] * begin if t == 0 else g[at] * (m01 + r[:k] * m11) / (m00 + r[:k] * m10)
        r = np.clip(r, 1e-30, 1e30)
        out[at] = r
    q = np.ones(len(n))
    for t in range(len(active) - 1, 0, -1):
        k = int(active[t])
        at = s[:k] + t
        x = g[at] * q[:k]
        q[:k] = np.clip((m10 + m11 * x) / (m00 + m01 * x), 1e-30, 1e30)
        out[at - 1] *= q[:k]
    return out / (1 + out)


def train(windows: list[tuple[np.ndarray, np.ndarray]], rounds: int = 150, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray]:
    """Weights by Adam on the mean log-likelihood of (features, labels) windows, with a small L2 term.

    Each round takes the next LOT windows in a fixed random order; there are as many rounds as to see each window
    three times at least, the last half of which are averaged.
    """
    wide = max((len(y) for _, y in windows), default=0)
    emit, move = np.zeros(N_FEATURES), np.zeros(5)
    if not wide:
        emit[0] = -20.0
        return emit, move
    rows = len(windows)
    x = np.zeros((rows, wide, 4), np.int8)
    y = np.zeros((rows, wide), np.int8)
    mask = np.zeros((rows, wide), np.int8)
    for i, (f, labels) in enumerate(windows):
        x[i, : len(labels)], y[i, : len(labels)], mask[i, : len(labels)] = f, labels, 1
    lots = np.array_split(np.random.default_rng(17).permutation(rows), -(-rows // LOT))
    free, m, v, mean = np.concatenate([emit, move]), 0.0, 0.0, 0.0
    odds = slice(1, 2 + len(BINS))  # a bin's weight is the sum of its step and of those of all lower bins: unseen bins follow their neighbours
    rounds = max(rounds, 3 * len(lots))
    half = rounds // 2 if len(lots) > 1 else rounds - 1
    for step in range(1, rounds + 1):
        own = lots[step % len(lots)]
        w = free.copy()
        w[odds] = np.cumsum(free[odds])
        grad = _gradient(x[own], y[own], mask[own], w) / len(own)
        grad[odds] = np.cumsum(grad[odds][::-1])[::-1]
        grad -= 1e-4 * free
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        free = free + rate * min(1.0, 2 - 2 * step / rounds + 0.05) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if step > half:
            mean = mean + free / (rounds - half)
    free = mean
    free[odds] = np.cumsum(free[odds])
    return free[:N_FEATURES], free[N_FEATURES:]


def _gradient(x: np.ndarray, y: np.ndarray, mask: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Of the log-likelihood of windows: counts of features and moves in the labels less those that the chain expects."""
    rows, wide = y.shape
    pair_true = np.zeros(5)
    pair_true[0] = y[:, 0].sum()
    both = mask[:, 1:] > 0
    for k in range(4):
        pair_true[1 + k] = ((2 * y[:, :-1] + y[:, 1:] == k) & both).sum()
    true = np.bincount(x.ravel(), weights=np.repeat((y * mask).ravel(), 4), minlength=N_FEATURES)
    g = np.exp(np.clip(w[:N_FEATURES][x].sum(axis=2), -40, 40))
    begin, *mm = np.exp(w[N_FEATURES:])
    mm = np.array(mm).reshape(2, 2)
    alpha = np.zeros((rows, wide, 2))
    beta = np.ones((rows, wide, 2))
    alpha[:, 0] = np.stack([np.ones(rows), begin * g[:, 0]], axis=1)
    alpha[:, 0] /= alpha[:, 0].sum(axis=1, keepdims=True)
    for t in range(1, wide):
        a = alpha[:, t - 1] @ mm
        a[:, 1] *= g[:, t]
        a /= a.sum(axis=1, keepdims=True)
        alpha[:, t] = np.where(mask[:, t, None] > 0, a, alpha[:, t - 1])
    pair = np.zeros(5)
    for t in range(wide - 1, 0, -1):
        e = beta[:, t].copy()
        e[:, 1] *= g[:, t]
        joint = alpha[:, t - 1, :, None] * mm * e[:, None, :]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        pair[1:] += (joint * mask[:, t, None, None]).sum(axis=0).ravel()
        b = e @ mm.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, t - 1] = np.where(mask[:, t, None] > 0, b, beta[:, t - 1])
    post = alpha * beta
    post = post[:, :, 1] / post.sum(axis=2)
    pair[0] = post[:, 0].sum()
    expected = np.bincount(x.ravel(), weights=np.repeat((post * mask).ravel(), 4), minlength=N_FEATURES)
    return np.concatenate([true, pair_true]) - np.concatenate([expected, pair])


def _forms(col: pa.Array):
    """(rows, starts, ends, forms) of the words: whole word, then beginnings from the shortest on."""
    return words(col, punctuation=True, fold=True, prefixes=BEGINNINGS, divide=ENDERS)


def _sentences(buf, offsets, rows, starts, ends) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of words between which no line or sentence ends."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, z = starts + offsets[rows], ends + offsets[rows]
    base = int(a[0])
    enders = np.concatenate([[0], np.cumsum(ENDERS[buf[base : int(z[-1])]])])
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (enders[a[1:] - base] > enders[z[:-1] - base])
    s = np.flatnonzero(new)
    return s, np.diff(np.append(s, len(rows)))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic): the bounded sample of labelled rows outside the held-out fifth; equal texts once."""
    known = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    by_hash = lambda k: known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    chosen = scratch(by_hash(1).unionByName(by_hash(0)), "labelled")  # at most 2 max_rows rows
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    once = found.groupBy(F.xxhash64("text").alias("t"), "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "toxic")
    once = scratch(once, "sample")
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(once), "doc_id").select("text", "toxic")


def _counts(it):
    """Partial counts of documents by word form and class; the parts of a long text count as one document."""
    for b in it:
        label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        before, seen = -1, np.zeros(0, np.uint64)  # the row that may go on, its forms
        for rows, _, _, forms in _forms(b.column(0)):
            if not len(rows):
                continue
            h, r = np.concatenate(forms), np.tile(rows, len(forms))
            h, r = h[h != 0], r[h != 0]
            order = np.lexsort((r, h))
            h, r = h[order], r[order]
            one = np.ones(len(h), dtype=bool)
            one[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
            h, r = h[one], r[one]
            last = int(rows[-1])
            known = (r == before) & np.isin(h, seen)
            seen = np.concatenate([seen, h[(r == last) & ~known]]) if last == before else h[r == last]
            before = last
            u, inv = np.unique(h[~known].view(np.int64), return_inverse=True)
            n1, n = np.bincount(inv, weights=label[r[~known]], minlength=len(u)), np.bincount(inv, minlength=len(u))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n1.astype(np.int64)), pa.array((n - n1).astype(np.int64))], names=["form", "toxic", "clean"])


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, lexicon: int = LEXICON) -> Crf:
    rows = sample(docs, labels, max_rows)
    totals = {t: n for t, n in rows.groupBy("toxic").count().collect()}
    model = Crf(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), (totals.get(1, 0), totals.get(0, 0)))
    if not all(model.totals):
        model.emit, model.move = train([])
        return model
    forms = rows.transform(in_arrow, _counts, "form long, toxic long, clean long").groupBy("form").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (model.totals[0] + 1)) - F.log((F.col("clean") + 0.5) / (model.totals[1] + 1))
    got = forms.where((F.col("toxic") >= 2) & (odds >= float(BINS[0]))).orderBy(odds.desc(), "form").limit(lexicon).toLocalIterator()
    table = np.fromiter((x for r in got for x in r), np.int64).reshape(-1, 3)
    h = np.ascontiguousarray(table[:, 0]).view(np.uint64)
    order = np.argsort(h)
    model.hashes, model.toxic, model.clean = h[order], table[order, 1], table[order, 2]
    tables = docs.sparkSession.sparkContext.broadcast(model)

    def windows(it):
        """For each document a window round its best token and one elsewhere: features and labels."""
        crf = tables.value
        for b in it:
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            out = []
            for r, starts, ends, fs in _forms(b.column(0)):
                if not len(r):
                    continue
                best, kind = crf.lookup(fs, label[r])
                x = features(best, kind, ends - starts)
                edges = np.concatenate([[0], np.flatnonzero(np.diff(r)) + 1, [len(r)]])
                for a, z in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    top = a + int(best[a:z].argmax())
                    bar = max(best[top] - 1.0, BINS[3]) if label[r[a]] == 1 else np.inf
                    y = (best[a:z] >= bar).astype(np.int8)
                    for mid in dict.fromkeys((top, a + (top - a + (z - a) // 2) % (z - a))):
                        lo = max(a, mid - WINDOW // 2)
                        hi = min(z, lo + WINDOW)
                        out.append((x[lo:hi].astype(np.int8).tobytes(), y[lo - a : hi - a].tobytes(), int(label[r[a]]) if mid == top else -1))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in out], pa.binary()), pa.array([k[1] for k in out], pa.binary()), pa.array([k[2] for k in out], pa.int32())], names=["x", "y", "doc"])

    got = rows.transform(in_arrow, windows, "x binary, y binary, doc int").orderBy(F.xxhash64("x", "y"), "x", "y").toLocalIterator()  # two windows at most for each row of the sample
    kept = [(np.frombuffer(bytes(a), np.int8).reshape(-1, 4), np.frombuffer(bytes(y), np.int8), doc) for a, y, doc in got]
    model.emit, model.move = train([k[:2] for k in kept])
    best = [k for k in kept if k[2] >= 0]
    if not best:
        return model
    lens = np.array([len(k[0]) for k in best])
    starts = np.cumsum(lens) - lens
    p = marginals(model.score(np.concatenate([k[0] for k in best])), starts, lens, model.move)
    model.scale = calibrate(np.maximum.reduceat(p, starts), np.array([k[2] for k in best], float))
    return model


def score(docs: DataFrame, model: Crf, bar: float = 0.5, names: tuple[str, str] = ("score", "spans")) -> DataFrame:
    """docs with score and spans: array<struct<start, length, score>> in code points, the tokens whose marginal reaches bar.

    names: of the two new columns; they replace columns of docs with these names.
    """
    tables = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*names)
    kept = docs.columns
    at = kept.index("text")

    def batches(it):
        crf = tables.value
        for b in it:
            buf, offsets = text_buffers(b.column(at))
            top = np.zeros(len(b))
            spans: dict[int, list] = {}
            for rows, starts, ends, fs in _forms(b.column(at)):
                if not len(rows) or not len(crf.hashes):
                    continue
                best, kind = crf.lookup(fs)
                s, n = _sentences(buf, offsets, rows, starts, ends)
                p = marginals(crf.score(features(best, kind, ends - starts)), s, n, crf.move)
                own = np.flatnonzero(np.diff(rows, prepend=-1))
                top[rows[own]] = np.maximum(top[rows[own]], np.maximum.reduceat(p, own))
                for i in np.flatnonzero(p >= bar).tolist():
                    spans.setdefault(int(rows[i]), []).append((int(starts[i]), int(ends[i]), float(p[i])))
            found = []
            for row in range(len(b)):
                if row not in spans:
                    found.append([])
                    continue
                points = np.concatenate([[0], np.cumsum((buf[int(offsets[row]) : int(offsets[row + 1])] & 0xC0) != 0x80)])
                found.append([{"start": int(points[s]), "length": int(points[e] - points[s]), "score": x} for s, e, x in spans[row]])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crf.of_document(top)), pa.array(found, kind)], names=[*kept, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.transform(in_arrow, batches, f"{kinds}, `{names[0]}` double, `{names[1]}` array<struct<start:long,length:long,score:double>>")
