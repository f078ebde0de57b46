"""Quality classifier (operator 1): histogram gradient-boosted trees over
statistics of whole texts.

Statistics are sums over bytes, words and lines of a text, taken with numpy
for a slice of an Arrow batch at a time.  Fitting reads a bounded sample of
labelled rows, about ``SAMPLE`` of them chosen by a hash of the id, bins each
statistic into at most ``BINS`` quantile bins, and grows complete trees of
one depth level by level from histograms of gradients.  The trees are
flattened into arrays (statistic, threshold, leaf), so scoring walks all
texts of a slice one level at a time without a Python step per row.

Null and empty texts have all statistics 0 and get the score of that point.
Repeated rows are scored each.  An empty table gives an empty table; fitting
on no labelled rows raises ``ValueError``; with one class only, every score
is near that class.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import cut_words, lean, slices, text_bytes, white_words

SAMPLE = 20_000
BINS = 64
TREES, DEPTH, RATE, RIDGE, LEAST = 60, 5, 0.15, 1.0, 20

#: Signs whose share is a statistic of its own.
SIGNS = ".,;:!?#$%&*|@<>/\\_=+-\"'()[]{}~^`"


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics): shares and means, 0 where there is nothing."""
    docs = len(offsets) - 1
    size = np.diff(offsets)
    owner = np.repeat(np.arange(docs), size)
    per = lambda mask, o=owner: np.bincount(o[mask], minlength=docs)
    share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0.0)
    cols = [np.log1p(size)]
    # bytes: one count of all byte values per text
    table = np.bincount(owner * 256 + buf, minlength=docs * 256).reshape(docs, 256)
    upper, lower = table[:, 65:91].sum(axis=1), table[:, 97:123].sum(axis=1)
    digits, high = table[:, 48:58].sum(axis=1), table[:, 128:].sum(axis=1)
    cols += [share(x, size) for x in (upper, lower, digits, high, table[:, 32], table[:, 10])]
    cols += [share(upper, upper + lower)]
    cols += [share(table[:, ord(c)], size) for c in SIGNS]
    # words
    w = cut_words(buf, offsets, white_words(), lower=False)
    n = w.counts
    wo = w.owner()
    cols += [np.log1p(n), share(np.bincount(wo, w.sizes, docs), n)]
    mean = cols[-1]
    cols += [np.sqrt(share(np.bincount(wo, (w.sizes - mean[wo]) ** 2, docs), n))]
    longest = np.zeros(docs)
    np.maximum.at(longest, wo, w.sizes)
    cols += [longest, share(per(w.sizes <= 2, wo), n)]
    if len(w.starts):
        first, last = buf[w.starts], buf[w.ends - 1]
        caps = (first >= 65) & (first <= 90)
        sign = (last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128))
        all_caps = caps & (last >= 65) & (last <= 90) & (w.sizes > 1)
        words = len(w.dictionary)
        types = np.bincount(np.unique(wo * words + w.codes) // words, minlength=docs)
        pair_ok = wo[1:] == wo[:-1]
        same = (w.codes[1:] == w.codes[:-1]) & pair_ok
        key = (w.codes[:-1].astype(np.int64) * words + w.codes[1:])[pair_ok]
        pair_owner = wo[1:][pair_ok]
        order = np.lexsort((key, pair_owner))
        k, o = key[order], pair_owner[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
        pairs = np.bincount(o[fresh], minlength=docs)
        cols += [share(per(caps, wo), n), share(per(sign, wo), n), share(per(all_caps, wo), n), share(types, n),
                 share(per(same, wo[1:]), n), share(pairs, n - 1)]
    else:
        cols += [np.zeros(docs)] * 6
    # lines
    lines = table[:, 10] + (size > 0)
    breaks = np.flatnonzero(buf == 10)
    before = buf[np.maximum(breaks - 1, 0)]
    closed = np.isin(before, np.frombuffer(b".!?:;\"", np.uint8))
    cols += [np.log1p(lines), share(size, lines), share(n, lines), share(per(closed, owner[breaks]), lines),
             share(n, table[:, 46] + table[:, 33] + table[:, 63] + 1)]
    if len(breaks):
        cut = np.unique(np.concatenate([breaks + 1, offsets[:-1][size > 0]]))
        cut = cut[cut < len(buf)]
        mixed = (buf.astype(np.uint64) + np.uint64(1)) * (np.arange(len(buf), dtype=np.uint64) - np.repeat(cut, np.diff(np.append(cut, len(buf)))).astype(np.uint64) + np.uint64(7))
        line_hash = np.add.reduceat(mixed * mixed, cut)
        lo = owner[cut]
        order = np.lexsort((line_hash, lo))
        fresh = np.ones(len(cut), bool)
        fresh[1:] = (line_hash[order][1:] != line_hash[order][:-1]) | (lo[order][1:] != lo[order][:-1])
        cols += [share(np.bincount(lo[order][fresh], minlength=docs), np.bincount(lo, minlength=docs))]
    else:
        cols += [(size > 0).astype(float)]
    return np.column_stack(cols).astype(np.float64)


@dataclass
class Forest:
    """Complete trees as arrays: node k has the children 2k + 1 and 2k + 2."""

    base: float
    feature: np.ndarray  # (trees, inner nodes)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Forest:
    """Boost complete trees on logistic loss from histograms."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    flat = binned + np.arange(m) * BINS
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    total = np.full(n, base)
    inner, leaves = 2 ** depth - 1, 2 ** depth
    feature, threshold = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)  # within its level
        for d in range(depth):
            width = 2 ** d
            index = (node[:, None] * (m * BINS) + flat).ravel()
            shape = (width, m, BINS)
            gs, hs, ns = (np.bincount(index, np.repeat(v, m), width * m * BINS).reshape(shape).cumsum(axis=2)
                          for v in (g, h, np.ones(n)))
            gt, ht, nt = gs[..., -1:], hs[..., -1:], ns[..., -1:]
            gain = gs ** 2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt ** 2 / (ht + RIDGE)
            gain[(ns < LEAST) | (nt - ns < LEAST)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            f, b = np.divmod(best, BINS)
            good = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            at = width - 1 + np.arange(width)
            feature[t, at] = np.where(good, f, 0)
            threshold[t, at] = [edges[i][j] if ok and j < len(edges[i]) else np.inf for i, j, ok in zip(f, b, good, strict=True)]
            node = 2 * node + (x[np.arange(n), feature[t, at][node]] > threshold[t, at][node])
        gl, hl = np.bincount(node, g, leaves), np.bincount(node, h, leaves)
        leaf[t] = -rate * gl / (hl + RIDGE)
        total += leaf[t][node]
    return Forest(base, feature, threshold, leaf)


def _source(docs: DataFrame, id_col: str, text_col: str, *more) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the statistics of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", rows=1 << 13):
                x = statistics(*text_bytes(part.column("text")))
                cuts = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.ravel()))], names=["id", "x"])

    return _source(docs, id_col, text_col).mapInArrow(lean(run), f"id {kind}, x array<double>").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text",
        sample: int = SAMPLE) -> Forest:
    """Learn 0/1 labels from about ``sample`` labelled documents; a label that
    is repeated for one id counts once, and so does an id with several texts.
    If a label is not among them: from at
    most ``sample`` documents of each label, those whose hashes come first."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("y is not null and id is not null")
    found = {r["y"]: r["count"] for r in known.distinct().groupBy("y").count().collect()}
    if not found:
        raise ValueError("no labelled rows to learn from")
    chance = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    chosen = known.where(chance < -(-sample * (1 << 20) // sum(found.values()))).distinct()
    if {r["y"] for r in chosen.select("y").distinct().collect()} != set(found):
        each = [known.where(F.col("y") == y).distinct().orderBy(chance, "id").limit(sample) for y in sorted(found)]
        chosen = reduce(DataFrame.union, each)
    # the sample's size is bounded, so it may be broadcast
    texts = _source(docs, id_col, text_col).join(F.broadcast(chosen.select("id").distinct()), "id")
    # one row per label: of several texts under one id the one with the smallest statistics
    rows = document_statistics(texts, "id", "text").groupBy("id").agg(F.min("x").alias("x")) \
        .join(F.broadcast(chosen), "id").select("id", "x", "y").collect()
    if not rows:
        raise ValueError("no labelled rows to learn from")
    rows.sort(key=lambda r: (r["id"], r["y"], r["x"]))
    return grow(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        trees = shared.value
        for batch in batches:
            for part in slices(batch, "text", rows=1 << 13):
                x = statistics(*text_bytes(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(trees.scores(x))], names=["id", "score"])

    return _source(docs, id_col, text_col).mapInArrow(lean(run), f"id {kind}, score double").withColumnRenamed("id", id_col)
