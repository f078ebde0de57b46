"""Source divergence audit (operator 12).

A document's bytes go through one translate table that lowers A-Z and blanks
every separator, are split at the blanks and counted in a ``Counter`` of the
document; its counts go into sparse counters of its (lang, source), which a
task writes out whenever they hold ``FLUSH`` terms.  So what is shuffled is
one row per task and term of a group, and a group that holds a third of all
documents is added up where they lie.

Everything after that is arithmetic on the sparse counts.  A term's smoothed
share p in a group is 1 + floor(10^9 (count + 5) / (N + 5 V)), taken by long
division in 64 bits, exact while N + 5 V stays below 9 * 10^15.

* Part ``pair`` (a group against every other source of its language): a term
  that neither has adds the same |p - q| as every other such term.  What the
  other terms change in that sum is added up for ``TILE`` x ``TILE`` sources
  and about ``TERMS`` terms at a time, in a dense matrix.
* Part ``term``: the terms of a group that are commoner there than in its
  language, the first ``TOP`` of them.

Null text, language and source count as ''.  A document without terms still
makes its group occur.  Repeated rows are documents each.  A text of any
length is split a piece at a time.  Equal values are ranked by their item's
UTF-8 bytes.  An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lendlens.llm.blocks import lean
from lendlens.sources.tables import materialize

SCALE, PRIOR = 1_000_000_000, 5
LEAST_DOCS, TOP = 30, 50
FLUSH = 200_000
PIECE = 1 << 20
TILE = 256
TERMS = 5_000

#: Letters and bytes of letters beyond ASCII stay, A-Z are lowered, the rest is blank.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def pieces(text: memoryview, size: int) -> Iterator[bytes]:
    """The translated text, cut at blanks into pieces of about ``size`` bytes."""
    rest = b""
    for at in range(0, len(text), size):
        part = rest + bytes(text[at:at + size]).translate(TABLE)
        cut = len(part) if at + size >= len(text) else part.rfind(b" ") + 1
        yield part[:cut]
        rest = part[cut:]


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                flush: int = FLUSH, piece: int = PIECE) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group and
    the group's documents that have it."""
    src = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"), (text_col, "text"))])

    def rows(freq, seen):
        for (lang, source), counts in freq.items():
            have, n = seen[lang, source], len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([*counts], pa.binary()).cast(pa.string()),
                 pa.array([*counts.values()], pa.int64()), pa.array([have[t] for t in counts], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    def run(batches):
        freq, seen, held = {}, {}, 0
        for batch in batches:
            texts, langs, sources = (batch.column(c) for c in ("text", "lang", "source"))
            for i, group in enumerate(zip(langs.to_pylist(), sources.to_pylist(), strict=True)):
                if group not in freq:
                    freq[group], seen[group] = Counter(), Counter()
                own = Counter()
                for part in pieces(memoryview(texts[i].as_buffer()), piece):
                    own.update(part.split())
                counts = freq[group]
                before = len(counts)
                counts.update(own)
                seen[group].update(own.keys())
                held += len(counts) - before
                if held >= flush:
                    yield from rows(freq, seen)
                    freq, seen, held = {}, {}, 0
        yield from rows(freq, seen)

    parts = src.mapInArrow(lean(run), "lang string, source string, term string, n bigint, docs bigint")
    # dealt by (lang, term): the sums per source and per language need no other exchange
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 kept)), three digits at a time."""
    rest, below, out = count + PRIOR, total + PRIOR * kept, F.lit(1)
    for scale in (1_000_000, 1_000, 1):
        out = out + F.call_function("div", rest * 1000, below) * scale
        rest = rest * 1000 % below
    return out


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
          least_docs: int = LEAST_DOCS, top: int = TOP, tile: int = TILE, terms_at_once: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring group."""
    counted = term_counts(docs, text_col, lang_col, source_col)
    kept = materialize(counted.groupBy("lang", "term").agg(
        F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("per"))
        .where(F.col("docs") >= least_docs), "kept-terms")
    occurs = kept.select("lang", "term", "lang_n", F.explode("per").alias("p")).select("lang", "term", "lang_n", "p.*")

    # a scan of two columns, added up where it reads
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in (
        (lang_col, "lang"), (source_col, "source"))]).distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = occurs.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = F.lit(0).cast("bigint")
    groups = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "lang_total", "v")])
    p0 = F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(0)
    groups = materialize(groups.select(
        "*", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("k"),
        F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / tile).cast("int").alias("tiles"), p0.alias("p0")), "groups")

    shares = materialize(occurs.join(groups, ["lang", "source"]).select(
        "lang", "source", "k", "tiles", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")), "shares")
    terms = shares.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))

    change = _changes(shares, groups, max(1, -(-kept.count() // terms_at_once)), tile)
    other = groups.select("lang", F.col("source").alias("item"), F.col("k").alias("j"), F.col("p0").alias("q0"))
    pairs = groups.join(other, "lang").where("source <> item").join(change, ["lang", "k", "j"], "left").select(
        "lang", "source", F.lit("pair").alias("part"), "item",
        (F.col("v") * F.abs(F.col("p0") - F.col("q0")) + F.coalesce("change", zero)).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(pairs).union(ranked(terms).where(F.col("rank") <= top))


def _changes(shares: DataFrame, groups: DataFrame, buckets: int, size: int) -> DataFrame:
    """(lang, k, j, change): what the terms that sources k or j have change in
    the sum of |p - q| as if they had none."""
    tile = F.floor(F.col("k") / size).cast("int")

    def by_tiles(df: DataFrame, *cols) -> DataFrame:
        """Every row once for each pair of tiles that its source's is in."""
        met = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        return met.select("lang", F.least(tile, "other").alias("left"), F.greatest(tile, "other").alias("right"), "k", *cols)

    rows = by_tiles(shares, F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"), "term", "p")
    bases = by_tiles(groups, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(buckets - 1).cast("bigint"))).alias("bucket"), "p0")
    key = ["lang", "left", "right", "bucket"]
    parts = rows.groupBy(*key).cogroup(bases.groupBy(*key)).applyInArrow(
        lambda x, y: _tile_changes(x, y, size), "lang string, k bigint, j bigint, change bigint")
    return parts.groupBy("lang", "k", "j").agg(F.sum("change").alias("change"))


def _tile_changes(rows: pa.Table, bases: pa.Table, size: int) -> pa.Table:
    names = ["lang", "k", "j", "change"]
    if not rows.num_rows:
        return pa.table({c: pa.array([], pa.string() if c == "lang" else pa.int64()) for c in names})
    ints = lambda t, c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
    k, p0 = ints(bases, "k"), ints(bases, "p0")
    p0 = p0[np.argsort(k)]
    k = np.sort(k)
    term = rows.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    terms, at, p = int(term.max()) + 1, ints(rows, "k"), ints(rows, "p")

    def dense(tile):
        own = p0[k // size == tile]
        out, mine = np.tile(own, (terms, 1)), at // size == tile
        out[term[mine], at[mine] - tile * size] = p[mine]
        return out, own

    (x, x0), (y, y0) = dense(left), dense(right)
    change = np.array([np.abs(x[:, i:i + 1] - y).sum(axis=0) for i in range(x.shape[1])]) - terms * np.abs(x0[:, None] - y0)
    i, j = (a.ravel() for a in np.indices(change.shape))
    i, j, value = i + left * size, j + right * size, change.ravel()
    if left != right:
        i, j, value = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([value, value])
    keep = i != j
    return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()] * int(keep.sum()), pa.string()), "k": i[keep], "j": j[keep], "change": value[keep]})
