"""Substring dedup by level-wise doubling (operator 10).

Windows of words are looked for at growing lengths.  Only where both halves
of a window are repeated can the window be, so each level asks about the
survivors of the level before, at twice the length (the last step overlaps
its halves if the wanted length asks for it), until the wanted length is
reached or no candidates survive.

One level is one exchange.  Documents lie in blocks, one row each, written
once.  A block sends every distinct candidate hash once, one row for each
range of the hash space that it has hashes in (the corpus needs as many ranges
as its size, and a block has no more rows than hashes); a range's task sees which
hashes more than one block has and sends each block one bit per hash.  So a
window that a third of all documents hold costs one entry per block, and
what moves per level are a few bytes per distinct window and the blocks
themselves (compressed).  Blocks compute hashes anew instead of keeping them.

Hashes on the way up are cut to 40 bits: such a level may keep too much,
never too little.  The wanted length is decided on 128 bits.

Nulls, empty texts and texts shorter than the window have no windows and stay
whole.  Repeated rows are documents of their own; rows of one id never remove
each other's words, since neither id is smaller.  Ids are integers; a null id comes
after all others.  An empty table gives an empty table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import Words, cut_words, give_back, kept_columns, lean, mix, slices, text_bytes, white_words, window_hashes, word_hashes
from lendlens.llm.decontaminate import pack, unpack
from lendlens.sources.tables import materialize

BLOCK_BYTES = 2 << 20
RANGE_BYTES = 8 << 20  # text per hash range
SHORT = np.uint64(24)  # bits cut off on the way up
NO_ID = (1 << 63) - 1


def make_blocks(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """(block, ids, sizes, data, rows): whole documents; the texts end to end,
    compressed, with their sizes (null for a null text)."""
    src = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NO_ID)).alias("id"),
                      F.col(text_col).cast("string").alias("text"), kept_columns(docs, keep).alias("row"))

    def run(batches):
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                buf, offsets = text_bytes(part.column("text"))
                # the table is written once, so the names stand
                sizes = pc.if_else(part.column("text").is_null(), None, pa.array(np.diff(offsets)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([uuid.uuid4().hex]), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())),
                     pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), sizes),
                     pa.array([squeeze.compress(buf.tobytes())], pa.binary()),
                     pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("row"))],
                    names=["block", "ids", "sizes", "data", "rows"])

    return materialize(src.mapInArrow(
        lean(run), "block string, ids array<bigint>, sizes array<bigint>, data binary, "
        f"rows array<{src.schema['row'].dataType.simpleString()}>"), "blocks")


class Block:
    """A block's words and, level by level, its surviving windows."""

    def __init__(self, ids, sizes, data: bytes):
        self.ids = np.asarray(ids, np.int64)
        self.null = np.array([x is None for x in sizes], bool)
        self.offsets = np.concatenate([[0], np.cumsum(np.array([x or 0 for x in sizes], np.int64))])
        self.buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8) if self.offsets[-1] \
            else np.zeros(0, np.uint8)
        self.words: Words = cut_words(self.buf, self.offsets, white_words(), lower=False)
        self.owner = self.words.owner()
        h = word_hashes(self.words.dictionary)
        self.hashes = h[self.words.codes] if len(h) else np.zeros(0, np.uint64)

    def whole(self, length: int) -> np.ndarray:
        """Places where a window of this length fits into one document."""
        at = np.arange(max(0, len(self.hashes) - length + 1))
        return at[at + length <= self.words.first[1:][self.owner[at]]]

    def grow(self, alive: np.ndarray, length: int, longer: int) -> np.ndarray:
        """Places whose both halves survive: the candidates of a longer length."""
        ok = np.zeros(len(self.hashes) + longer, bool)
        ok[alive] = True
        at = self.whole(longer)
        return at[ok[at] & ok[at + longer - length]]

    def short(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct 40-bit hashes of windows, and each window's number in them."""
        h = window_hashes(self.hashes, length)[places] >> SHORT
        return np.unique(h, return_inverse=True)

    def long(self, places: np.ndarray, length: int):
        """Distinct 128-bit hashes, each window's number in them, and the
        smallest document that has each."""
        h1 = window_hashes(self.hashes, length)[places]
        h2 = window_hashes(mix(self.hashes ^ np.uint64(0xA24BAED4963EE407)), length)[places]
        order = np.lexsort((h2, h1))
        s1, s2 = h1[order], h2[order]
        new = np.ones(len(order), bool)
        new[1:] = (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        doc = self.ids[self.owner[places]]
        least = np.minimum.reduceat(doc[order], np.flatnonzero(new)) if len(order) else doc
        return s1[new], s2[new], number, least


def _bits(column: pa.Array, i: int) -> np.ndarray:
    return np.frombuffer(column[i].as_py() or b"", np.uint8).astype(bool)


def _levels(wanted: int | None, start: int) -> list[int]:
    """Lengths from ``start``, doubling; the last step is cut to ``wanted``."""
    out = [start]
    while wanted is not None and out[-1] < wanted:
        out.append(min(2 * out[-1], wanted))
    return out


def _survivors(block: Block, lengths: list[int], replies: list[np.ndarray]) -> np.ndarray:
    """Replay the levels so far: places alive after the last reply."""
    alive = block.whole(lengths[0])
    for k, (length, reply) in enumerate(zip(lengths, replies, strict=False)):
        if k:
            alive = block.grow(alive, lengths[k - 1], length)
        _, number = block.short(alive, length)
        many = np.bincount(number, minlength=len(reply)) > 1
        alive = alive[(reply | many)[number]]
    return alive


def _ask(blocks: DataFrame, lengths: list[int], ranges: int, final: bool) -> DataFrame:
    """(block, r, payload): distinct hashes of the last of ``lengths``."""
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column("block")[i].as_py()
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "data")))
                replies = [_bits(batch.column(f"reply{k}"), i) for k in range(len(lengths) - 1)]
                if replies:
                    alive = block.grow(_survivors(block, lengths[:-1], replies), lengths[-2], lengths[-1])
                else:
                    alive = block.whole(lengths[-1])
                if final:
                    h1, h2, _, least = block.long(alive, lengths[-1])
                    some, cut = _cuts(h1, ranges, 64)
                    load = [np.concatenate([h1[a:b], h2[a:b], least[a:b].view(np.uint64)]).tobytes()
                            for a, b in zip(cut[:-1], cut[1:], strict=True)]
                else:
                    h, _ = block.short(alive, lengths[-1])
                    some, cut = _cuts(h, ranges, 64 - int(SHORT))
                    load = [pack(np.diff(h[a:b], prepend=np.uint64(0)))[0].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(load, pa.binary())],
                    names=["block", "r", "payload"])

    return blocks.mapInArrow(lean(run), "block string, r bigint, payload binary")


def _cuts(sorted_hashes: np.ndarray, ranges: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash ranges that a block has hashes in, and where each one's begin:
    as many as the block has hashes at most, however many ranges there are."""
    top = sorted_hashes >> np.uint64(bits - 32)
    r = ((top * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
    begin = np.flatnonzero(np.diff(r, prepend=-1))
    return r[begin], np.append(begin, len(r))


def _answer(asked: DataFrame, final: bool) -> DataFrame:
    """(block, bits): per block one bit for each hash it sent, in its order.
    On the way up: another block has it.  At the end: a smaller document has it."""
    def run(table: pa.Table) -> pa.Table:
        names, loads = table.column("block").to_pylist(), table.column("payload").to_pylist()
        if final:
            parts = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in loads]
            h1, h2, doc = np.concatenate(parts, axis=1)
            doc = doc.view(np.int64)
            order = np.lexsort((h2, h1))
            new = np.ones(len(order), bool)
            new[1:] = (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            number = np.cumsum(new) - 1
            least = np.minimum.reduceat(doc[order], np.flatnonzero(new))
            bits = np.empty(len(order), np.uint8)
            bits[order] = least[number] < doc[order]
            size = [p.shape[1] for p in parts]
        else:
            parts = [np.cumsum(unpack(np.frombuffer(x, np.uint8))) for x in loads]
            every = np.sort(np.concatenate(parts))
            many = np.unique(every[1:][every[1:] == every[:-1]])
            size = [len(p) for p in parts]
            mine = np.concatenate(parts)
            at = np.searchsorted(many, mine)
            bits = np.zeros(len(mine), np.uint8)
            inside = at < len(many)
            bits[inside] = many[at[inside]] == mine[inside]
        cut = np.cumsum([0, *size])
        out = [bits[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
        give_back()
        return pa.table({"block": pa.array(names, pa.string()), "r": table.column("r"), "bits": pa.array(out, pa.binary())})

    said = asked.groupBy("r").applyInArrow(run, "block string, r bigint, bits binary")
    # a block's answers are bounded by its own size
    return said.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("r", "bits"))).alias("all")).select(
        "block", F.aggregate("all", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["bits"])).alias("bits"))


def _with_reply(blocks: DataFrame, reply: DataFrame, name: str) -> DataFrame:
    return blocks.join(materialize(reply.withColumnRenamed("bits", name), "replies"), "block", "left")


def remove_repeats(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text",
                   keep: list[str] = ("doc_id",)) -> DataFrame:
    """(row, text, n_words, n_removed, kept_text, spans) of every document:
    words covered by a window of ``window`` words that also begins in a
    document with a smaller id are removed; ``spans`` are their places,
    ``text`` is the whole text and ``row`` is a struct of the columns ``keep``
    (the text need not be among them)."""
    blocks = make_blocks(docs, id_col, text_col, keep)
    lengths = _levels(window, -(-window // 2))
    ranges = _ranges(blocks)
    known = blocks
    for k in range(len(lengths)):
        final = k == len(lengths) - 1
        known = _with_reply(known, _answer(_ask(known, lengths[:k + 1], ranges, final), final), f"reply{k}")

    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "data")))
                replies = [_bits(batch.column(f"reply{k}"), i) for k in range(len(lengths))]
                if len(lengths) > 1:
                    alive = block.grow(_survivors(block, lengths[:-1], replies[:-1]), lengths[-2], window)
                else:
                    alive = block.whole(window)
                _, _, number, least = block.long(alive, window)
                doc = block.ids[block.owner[alive]]
                hit = alive[replies[-1][number] | (doc > least[number])]
                yield _kept(block, batch.column("rows")[i].values, hit, window, span)

    return known.mapInArrow(
        lean(run), f"row {blocks.schema['rows'].dataType.elementType.simpleString()}, text string, n_words bigint, n_removed bigint, "
        "kept_text string, spans array<struct<begin:bigint,stop:bigint>>")


def _ranges(blocks: DataFrame) -> int:
    total = blocks.select(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))).alias("s")).agg(F.sum("s")).first()[0]
    return min(max(1, -(-(total or 0) // RANGE_BYTES)), (1 << 32) - 1)


def _kept(block: Block, rows: pa.Array, hit: np.ndarray, window: int, span: pa.DataType) -> pa.RecordBatch:
    w, n = block.words, len(block.hashes)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    gone = np.cumsum(edge)[:n] > 0
    owner, docs = block.owner, len(block.ids)
    # runs of removed words, cut at documents
    before = np.zeros(n, bool)
    before[1:] = gone[:-1] & (owner[1:] == owner[:-1])
    after = np.zeros(n, bool)
    after[:-1] = gone[1:] & (owner[1:] == owner[:-1])
    begin, stop = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    base = w.first[:-1][owner[begin]] if len(begin) else begin
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(owner[begin], np.arange(docs + 1)).astype(np.int32)),
        pa.StructArray.from_arrays([pa.array(begin - base), pa.array(stop - base)], fields=list(span.value_type)))
    keep = np.flatnonzero(~gone)
    count = np.bincount(owner[keep], minlength=docs)
    size = w.sizes[keep] + 1  # one space behind each word
    ends = np.cumsum(size)
    take = np.repeat(w.starts[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    data = np.append(block.buf, np.uint8(32))[take]
    data[ends - 1] = 32
    stop_at = np.concatenate([[0], ends])[np.cumsum(count)]
    stays = np.ones(len(data), bool)
    stays[stop_at[count > 0] - 1] = False
    place = np.concatenate([[0], stop_at - np.cumsum(count > 0)]).astype(np.int32)
    text = pa.StringArray.from_buffers(docs, pa.py_buffer(place), pa.py_buffer(data[stays]))
    whole = pc.if_else(pa.array(block.null), None, pa.StringArray.from_buffers(
        docs, pa.py_buffer(block.offsets.astype(np.int32)), pa.py_buffer(block.buf)))
    return pa.RecordBatch.from_arrays(
        [rows, whole, pa.array(w.counts), pa.array(w.counts - count), text, spans],
        names=["row", "text", "n_words", "n_removed", "kept_text", "spans"])


def longest_repeats(docs: DataFrame, start: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, longest) of every id: the largest of start, 2 * start,
    4 * start, ... at which it has a window that occurs twice in the corpus
    (0: none), doubling until no candidates survive."""
    blocks = make_blocks(docs, id_col, text_col, [id_col])
    ranges = _ranges(blocks)
    known, lengths = blocks, [start]
    kind = docs.schema[id_col].dataType.simpleString()
    out = None
    while True:
        known = _with_reply(known, _answer(_ask(known, lengths, ranges, False), False), f"reply{len(lengths) - 1}")

        def run(batches, lengths=tuple(lengths)):
            for batch in batches:
                for i in range(batch.num_rows):
                    block = Block(*(batch.column(c)[i].as_py() for c in ("ids", "sizes", "data")))
                    replies = [_bits(batch.column(f"reply{k}"), i) for k in range(len(lengths))]
                    alive = _survivors(block, list(lengths), replies)
                    has = np.bincount(block.owner[alive], minlength=len(block.ids)) > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block.ids), pa.array(np.where(has, lengths[-1], 0))], names=["id", "longest"])

        level = materialize(known.mapInArrow(lean(run), "id bigint, longest bigint"), "level")
        some = level.where("longest > 0").limit(1).count()
        out = level if out is None else out.union(level.where("longest > 0"))
        if not some:
            return out.groupBy(F.nullif(F.col("id"), F.lit(NO_ID)).cast(kind).alias(id_col)).agg(F.max("longest").alias("longest"))
        lengths.append(2 * lengths[-1])
