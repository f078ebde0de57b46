"""MinHash near-duplicates with tensored banding (operator 6).

Two collections A and B of ``m`` band keys each are made from ``r`` minhashes
a key.  Table (i, j) of the m * m tables has the key (A_i, B_j), so m * m
tables of 2r rows cost 2 * m * r minhashes instead of 2 * m * m * r.  Two sets
of similarity s miss all tables with a probability of at most
2 * (1 - s**r)**m; m is the smallest number for which that is below 1e-6 (r = 4:
20 bands for s = 0.85, 28 for 0.8).  Documents that only share a template
(s = 0.3) meet by chance in 2 to 4 % of cases.

From there on everything is exact:

1. documents with equal sets are one class, kept by its smallest id;
2. table keys are made only from halves A_i that at least two classes share
   (others cannot collide); each bucket's members hang on its smallest one;
3. components of that candidate graph bound the search: every pair of a
   component whose sizes allow it is compared on full shingle sets, in groups
   of bounded size (a large component is dealt by size class, then in pairs of
   blocks); a group gives back only the links that join its parts;
4. components of the links, spread to all members of the classes.

Shingles are 52-bit hashes of 3 words.  Nulls, empty texts and texts without
words have size 0 and are linked with nothing.  Repeated rows, also under one
id, are documents of their own.  A row without id links nothing; it has the
component of documents with the same set, else none.  An empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import cut_words, lean, mix, slices, text_bytes, white_words, window_hashes, word_hashes
from lendlens.llm.graph import components
from lendlens.sources.tables import materialize

ROWS, MISS = 4, 1e-6
DOC_BITS = 12  # texts in a slice; the other bits hold a shingle's hash
GROUP, GROUP_SHINGLES = 512, 1 << 20  # documents, and their shingles, that one group compares


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text: sorted hashes, and text offsets."""
    w = cut_words(buf, offsets, white_words(), lower=True)
    h = word_hashes(w.dictionary)[w.codes] if len(w.codes) else np.zeros(0, np.uint64)
    n = w.counts
    owner = w.owner()
    parts, owners = [], []
    for size in range(1, width + 1):
        runs = window_hashes(h, size) if size > 1 else h
        if not len(runs):
            continue
        fits = np.arange(len(runs)) + size <= w.first[1:][owner[:len(runs)]]
        # the full width, or a whole text that is shorter
        fits &= (n[owner[:len(runs)]] == size) if size < width else True
        parts.append(mix(runs[fits] + np.uint64(size)))
        owners.append(owner[:len(runs)][fits])
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    low = np.uint64(64 - DOC_BITS)
    key = np.sort((np.concatenate(owners).astype(np.uint64) << low) | (np.concatenate(parts) >> np.uint64(DOC_BITS)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    first = np.searchsorted(key >> low, np.arange(len(n) + 1, dtype=np.uint64))
    return key & np.uint64((1 << int(low)) - 1), first


def _per_text(op, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, values.dtype)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        out[full] = op.reduceat(values, first[:-1][full])
    return out


def band_keys(sets: np.ndarray, first: np.ndarray, rows: int, bands: int) -> tuple[np.ndarray, np.ndarray]:
    """Collections A and B: (texts, bands) keys from ``rows`` minhashes each."""
    x = mix(sets + np.uint64(0x9E3779B97F4A7C15))
    seeds = mix(np.arange(1, 4 * rows * bands + 1, dtype=np.uint64))
    out = np.zeros((2, len(first) - 1, bands), np.uint64)
    for k in range(2 * bands * rows):
        low = _per_text(np.minimum, x * (seeds[2 * k] | np.uint64(1)) + seeds[2 * k + 1], first)
        side, band = divmod(k // rows, bands)
        out[side, :, band] = mix(out[side, :, band] * np.uint64(0x9E3779B97F4A7C15) + low)
    return out[0], out[1]


def bands_for(percent: int, rows: int, miss: float = MISS) -> int:
    """Bands that miss a pair at the limit with a probability below ``miss``."""
    return max(1, int(np.ceil(np.log(miss / 2) / np.log(1 - (percent / 100) ** rows))))


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, rows: int, bands: int) -> DataFrame:
    """(id, n, s1, s2, a, b): set size, 128-bit set hash, both collections."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n bigint, s1 bigint, s2 bigint, a array<bigint>, b array<bigint>"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", rows=1 << DOC_BITS):
                sets, first = shingle_sets(*text_bytes(part.column("text")), width)
                s1, s2 = (_per_text(np.add, mix(sets + np.uint64(c)), first).view(np.int64) for c in (11, 1 << 60))
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, bands, dtype=np.int32)),
                                                  pa.array(x.ravel().view(np.int64)))
                         for x in band_keys(sets, first, rows, bands)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(first)), pa.array(s1), pa.array(s2), *lists],
                    names=["id", "n", "s1", "s2", "a", "b"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(lean(run), schema)


def candidate_edges(classes: DataFrame) -> DataFrame:
    """(u, v): members of each shared table bucket and its smallest member.
    ``classes`` has (id, a, b)."""
    halves = classes.select("id", F.posexplode("a").alias("i", "x")).select("id", F.xxhash64("i", "x").alias("half"))
    shared = materialize(halves.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "halves")
    alive = materialize(halves.join(shared, "half"), "shared-halves")
    keys = alive.join(classes.select("id", "b"), "id").select("id", "half", "c", F.posexplode("b").alias("j", "y")) \
        .select("id", "c", F.xxhash64("half", "j", "y").alias("key"))
    buckets = materialize(
        keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("v"), F.max("id").alias("u"))
        .where("n > 1"), "buckets")
    # a bucket of two is its own edge; only larger ones meet their members again
    hung = keys.where("c > 2").join(buckets.where("n > 2").select("key", "v"), "key").select(F.col("id").alias("u"), "v")
    return buckets.select("u", "v").union(hung).where("u <> v").distinct()


def _links(ids, sets, first, sides, needed):
    """Links that join the parts of one group, on full sets.

    Documents are compared one against all others of the group until those
    not yet compared are all in one part: further pairs among them cannot
    join anything.  ``sides`` tells the two blocks of a group apart and
    ``needed`` whether pairs within the one block are wanted too.
    """
    n = len(ids)
    size = np.diff(first)
    owner = np.repeat(np.arange(n), size)
    _, code, df = np.unique(sets, return_inverse=True, return_counts=True)
    keep = df[code] > 1
    code, owner = code[keep], owner[keep]
    order = np.argsort(code, kind="stable")
    posting, begin = owner[order], np.searchsorted(code[order], np.arange(len(df) + 1))
    mine = np.searchsorted(owner, np.arange(n + 1))
    part = np.arange(n)
    out, open_ = [], np.ones(n, bool)
    while True:
        left = np.flatnonzero(open_)
        if len(left) < 2:
            return out
        names, counts = np.unique(part[left], return_counts=True)
        if len(names) == 1:
            return out
        # next: a document outside the largest part
        x = left[np.argmax(part[left] != names[np.argmax(counts)])] if out or not open_.all() else left[0]
        open_[x] = False
        own = code[mine[x]:mine[x + 1]]
        lens = begin[own + 1] - begin[own]
        at = np.repeat(begin[own] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        both = np.bincount(posting[at], minlength=n)
        linked = needed(both, size[x], size) & (part != part[x])
        if sides is not None:
            linked &= sides != sides[x]
        for y in np.flatnonzero(linked):
            if part[y] != part[x]:
                out.append((ids[x], ids[y]))
                part[part == part[y]] = part[x]


def verified_links(members: DataFrame, percent: int) -> DataFrame:
    """(u, v) links with 100 * intersection >= percent * union among documents
    (g, id, n, sets) of one group g; only as many as join the parts."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum("n") / GROUP_SHINGLES))
    sizes = materialize(members.groupBy("g").agg(parts.alias("parts")), "group-sizes")
    step = F.lit(float(np.log(100 / percent)))
    # sizes that can be linked lie in one class or in two that follow each other
    classed = materialize(members.join(sizes, "g").withColumn(
        "k", F.when(F.col("parts") > 1, F.floor(F.log("n") / step + 1e-9)).otherwise(F.lit(0)).cast("bigint")), "sets")
    blocks = materialize(classed.groupBy("g", "k").agg(parts.alias("nb")), "blocks")
    up = blocks.select("g", (F.col("k") - 1).alias("k"), F.col("nb").alias("nb_up"))
    down = blocks.select("g", (F.col("k") + 1).alias("k"), F.col("nb").alias("nb_down"))
    deal = materialize(blocks.join(up, ["g", "k"], "left").join(down, ["g", "k"], "left"), "deal")
    own = classed.join(deal, ["g", "k"]).withColumn("blk", F.pmod(F.xxhash64("id", "n"), F.col("nb")))
    lane = lambda kind, k, x, y, side: F.struct(
        F.lit(kind).alias("kind"), k.alias("k"), x.alias("x"), y.alias("y"), F.lit(side).alias("side"))
    k, blk = F.col("k"), F.col("blk")
    each = lambda n, f: F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1), f)) \
        .otherwise(F.array().cast("array<struct<kind:string,k:bigint,x:bigint,y:bigint,side:int>>"))
    lanes = F.concat(
        each("nb", lambda x: lane("same", k, F.least(x, blk), F.greatest(x, blk), 0)),
        each("nb_up", lambda x: lane("next", k, blk, x, 0)),
        each("nb_down", lambda x: lane("next", k - 1, x, blk, 1)))
    dealt = own.select("g", "id", "n", "sets", F.explode(lanes).alias("l")).select(
        "g", "l.kind", "l.k", "l.x", "l.y", "l.side", "id", "sets")
    kind = members.schema["id"].dataType.simpleString()
    needed = lambda both, a, b: 100 * both >= percent * (a + b - both)

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        col = table.column("sets").chunk(0) if table.num_rows else None
        ids = table.column("id").to_pylist()
        first = np.concatenate([[0], np.cumsum(np.asarray(col.value_lengths()))])
        sides = np.asarray(table.column("side")) if table.column("kind")[0].as_py() == "next" else None
        found = _links(ids, np.asarray(col.flatten()), first, sides, needed)
        t = table.schema.field("id").type
        return pa.table({"u": pa.array([u for u, _ in found], t), "v": pa.array([v for _, v in found], t)})

    return dealt.groupBy("g", "kind", "k", "x", "y").applyInArrow(run, f"u {kind}, v {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3,
                    percent: int = 85, rows: int = ROWS) -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    bands = bands_for(percent, rows)
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    sig = materialize(signatures(src, "id", "text", width, rows, bands), "signatures")
    full = sig.where("n > 0 and id is not null")
    classes = materialize(full.groupBy("s1", "s2", "n").agg(F.min("id").alias("id")), "classes")
    first = materialize(full.select("id", "s1", "s2", "n", "a", "b").join(classes, ["id", "s1", "s2", "n"])
                        .dropDuplicates(["id", "s1", "s2", "n"]), "class-bands")
    around = materialize(components(candidate_edges(first)), "candidates")

    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", rows=1 << DOC_BITS):
                sets, at = shingle_sets(*text_bytes(part.column("text")), width)
                yield pa.RecordBatch.from_arrays(
                    [part.column("g"), part.column("id"), pa.array(np.diff(at)),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(sets.view(np.int64)))],
                    names=["g", "id", "n", "sets"])

    # by shuffle at every size: the candidates grow with the corpus
    near = around.select(F.col("node").alias("id"), F.col("component").alias("g")).hint("merge")
    members = materialize(src.join(near, "id").select("g", "id", "text")
                          .mapInArrow(lean(run), f"g {kind}, id {kind}, n bigint, sets array<bigint>").where("n > 0"), "members")
    linked = materialize(components(verified_links(members, percent)), "linked")
    # classes of one id are one document's; equal sets share the class's smallest id
    of_class = materialize(classes.join(linked, classes["id"] == linked["node"], "left").select(
        "s1", "s2", "n", F.coalesce("component", "id").alias("component_id")), "class-components")
    return sig.select("id", "n", "s1", "s2").join(of_class, ["s1", "s2", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"))
