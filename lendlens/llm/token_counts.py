"""Token counts (operator 5): exact token count at every prefix of a text.

The encoding of a prefix ends in one token only, so a table over prefixes
fills in one pass: the last token of a prefix is the token that ends there
and may stand next to the last token of what lies before it
(:meth:`WordBpe.prefix_counts`).  Units of a text are encoded apart, so a
text's table is the running sum over its units plus the table of the unit
that the prefix cuts.  It holds the places inside units too, as runs of equal
counts.

Null or empty text has no tokens and empty lists.  Other columns of the
input are kept as they are; equal names are no problem because the added
columns are renamed by the caller's choice of prefix.  An empty table gives
an empty table.
"""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import lean, slices, text_bytes
from lendlens.llm.bpe import UNIT_BYTES, Memo, WordBpe, loaded, units, vocabulary

_MEMOS: dict[str, tuple[WordBpe, Memo]] = {}


TABLE_BYTES = 64  # longer units are seldom met again: their tables are not kept

TABLES = 200_000  # of one generation of kept tables

#: Writer options for a stored table: places and counts as packed differences.
PACKED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "false"}


class Generations(Memo):
    """A memo in two generations: when the younger one is full it becomes the
    older one, so that what is met again and again stays."""

    def __init__(self, answer, limit: int = TABLES):
        super().__init__(answer, limit)
        self.older: dict = {}

    def __call__(self, word):
        got = self.known.get(word)
        if got is None:
            got = self.older.get(word)
            if got is None:
                got = self.answer(word)
            if len(self.known) >= self.limit:
                self.older, self.known = self.known, {}
            self.known[word] = got
        return got


def _memo(shared, name: str, answer, kind: type[Memo] = Memo) -> Memo:
    bpe = loaded(shared)
    if _MEMOS.get(name, (None,))[0] is not bpe:
        _MEMOS[name] = bpe, kind(lambda unit: answer(bpe, unit))
    return _MEMOS[name][1]


def unit_tokens(bpe: WordBpe, unit: bytes) -> int:
    """Tokens of one unit: the last entries of its pieces' prefix tables."""
    return sum(1 if isinstance(p, int) else bpe.prefix_counts(p)[0][-1] for p in bpe.unit_pieces(unit))


def unit_counts(bpe: WordBpe, unit: bytes) -> bytes:
    """Tokens of a unit's prefixes, one 32-bit number per byte; the bytes of a
    character all have the count of the prefix that ends with it."""
    text = unit.decode()
    if text.isalpha() and max(text) < "\u0100" and text == text.lower():
        each = bpe.cut_counts(bpe.symbols(text))
        if len(unit) > len(text):
            for i in range(len(unit) - 1, 0, -1):
                if unit[i] & 0xC0 == 0x80:
                    each[i] = each[i + 1]
    else:
        each = bpe.text_counts(text)
        if len(unit) > len(text):
            each = [0, *(n for c, n in zip(text, each[1:], strict=True) for _ in c.encode())]
    return array("i", each).tobytes()[4:]


def text_runs(w, offsets: np.ndarray, tables: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of all texts: (first run of each, end bytes, tokens), and the
    tokens of each distinct unit; ``tables`` are those of :func:`unit_counts`
    in the order of the distinct units.  White space goes on with the count
    before it."""
    dense = np.frombuffer(b"".join(tables), np.int32)
    bytes_of = np.fromiter(map(len, tables), np.int64, len(tables)) // 4
    stop = np.cumsum(bytes_of)
    last = np.ones(len(dense), bool)  # a run of equal counts ends here
    last[:-1] = dense[1:] != dense[:-1]
    last[stop - 1] = True
    place = np.flatnonzero(last)
    tokens = dense[stop - 1].astype(np.int64)
    until = np.searchsorted(place, stop)
    size = np.diff(np.concatenate([[0], until]))
    within = place + 1 - np.repeat(stop - bytes_of, size)
    value = dense[place]
    n = size[w.codes]
    stop = np.cumsum(n)
    at = np.arange(int(n.sum())) - np.repeat(stop - n, n) + np.repeat((until - size)[w.codes], n)
    owner, total = w.owner(), np.concatenate([[0], np.cumsum(tokens[w.codes])])
    before = total[:-1] - total[w.first[:-1]][owner]
    ends = within[at] + np.repeat(w.starts - offsets[:-1][owner], n)
    counts = value[at] + np.repeat(before, n)
    # a unit's last run reaches to the next unit of its text, or the text's end
    after = np.append(w.starts[1:], 0)
    after[w.first[1:][w.counts > 0] - 1] = offsets[1:][w.counts > 0]
    ends[stop - 1] = after - offsets[:-1][owner]
    # what lies before the first unit has no tokens
    starts = np.append(w.starts, 0)[w.first[:-1]]
    head = np.where(w.counts > 0, starts, offsets[1:]) - offsets[:-1]
    run = np.concatenate([[0], stop])[w.first]
    lead = np.flatnonzero(head > 0)
    ends, counts = np.insert(ends, run[lead], head[lead]), np.insert(counts, run[lead], 0)
    return run + np.concatenate([[0], np.cumsum(head > 0)]), ends.astype(np.int32), counts.astype(np.int32), tokens


def token_prefixes(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text",
                   keep_prefixes: bool = True) -> DataFrame:
    """(id, n_bytes, n_tokens, ends, counts, text_md5) of every whole text.

    ``counts[i]`` is the token count of every prefix that ends after byte
    ``ends[i - 1]`` up to byte ``ends[i]``; the last run ends with the text.
    Without ``keep_prefixes`` the lists and the digest are left out (the
    counts still come from the prefix tables).
    """
    shared = vocabulary(docs.sparkSession, vocab_path)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_bytes bigint, n_tokens bigint" + (
        ", ends array<int>, counts array<int>, text_md5 string" if keep_prefixes else "")

    def run(batches):
        bpe = loaded(shared)
        count, table = _memo(shared, "count", unit_tokens), _memo(shared, "prefixes", unit_counts, Generations)
        for batch in batches:
            for part in slices(batch, "text", UNIT_BYTES):
                buf, offsets = text_bytes(part.column("text"))
                w = units(buf, offsets)
                distinct = w.dictionary.to_pylist()
                if keep_prefixes:
                    tables = [table(u) if len(u) <= TABLE_BYTES else unit_counts(bpe, u) for u in distinct]
                    first, ends, counts, each = text_runs(w, offsets, tables)
                else:
                    each = np.fromiter(map(count, distinct), np.int64, len(distinct))
                total = np.zeros(len(w.codes) + 1, np.int64)
                np.cumsum(each[w.codes], out=total[1:])
                cols = [part.column("id"), pa.array(np.diff(offsets)), pa.array(total[w.first[1:]] - total[w.first[:-1]])]
                if keep_prefixes:
                    begins = pa.array(first.astype(np.int32))
                    cols += [pa.ListArray.from_arrays(begins, pa.array(ends)), pa.ListArray.from_arrays(begins, pa.array(counts)),
                             part.column("md5")]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in schema.split(", ")])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if keep_prefixes:
        src = src.withColumn("md5", _digest(F.col("text")))
    return src.mapInArrow(lean(run), schema).withColumnRenamed("id", id_col)


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _whole(text: bytes, at: int) -> int:
    """The place ``at``, or the start of the character that it cuts."""
    while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
        at -= 1
    return at


def count_at(prefixes: DataFrame, docs: DataFrame, at_col: str, vocab_path: str, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """(id, at, n_tokens) for a byte place per document, read off the stored
    table; nothing is encoded.  A table fits a document by id and text, so
    rows without an id and ids with several texts find theirs; a document
    without a table has null."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).cast("string")
    src = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.col(at_col).cast("bigint").alias("at"), _digest(text).alias("md5"))
    tables = prefixes.select(F.col(id_col).alias("of"), F.col("text_md5").alias("of_md5"), "ends", "counts") \
        .dropDuplicates(["of", "of_md5"])
    src = src.join(tables, src["id"].eqNullSafe(tables["of"]) & (src["md5"] == tables["of_md5"]), "left") \
        .select("id", "text", "at", "ends", "counts")

    def run(batches):
        for batch in batches:
            out = []
            for text, at, ends, counts in zip(*(batch.column(c) for c in ("text", "at", "ends", "counts")), strict=True):
                at = at.as_py()
                if at is None or not ends.is_valid:
                    out.append(None)
                    continue
                at = _whole((text.as_py() or "").encode(), at)
                ends = ends.values.to_numpy()
                i = min(int(np.searchsorted(ends, at)), len(ends) - 1)
                out.append(counts.values[i].as_py() if at > 0 and len(ends) else 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at"), pa.array(out, pa.int64())],
                                             names=["id", "at", "n_tokens"])

    return src.mapInArrow(lean(run), f"id {kind}, at bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def fit_budget(prefixes: DataFrame, budget: int, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep_bytes, keep_tokens): the longest prefix of whole characters
    with at most ``budget`` tokens, read off the stored table; and the
    columns ``keep`` of the table."""
    fits = F.filter(F.arrays_zip("ends", "counts"), lambda p: p["counts"] <= budget)
    last = F.try_element_at(fits, F.lit(-1))
    whole = F.col("n_tokens") <= budget  # no run has to be looked at
    part = lambda all_of, of: F.when(whole, F.col(all_of)).otherwise(F.coalesce(last[of].cast("bigint"), F.lit(0)))
    return prefixes.select(id_col, *keep, part("n_bytes", "ends").alias("keep_bytes"), part("n_tokens", "counts").alias("keep_tokens"))
