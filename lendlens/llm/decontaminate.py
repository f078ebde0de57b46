"""Benchmark decontamination (operator 2) over a positional inverted index.

The index is kept in segments, as search engines do: one row per block of
whole documents with its terms and, per term, the places of its occurrences
(sorted, as byte-coded differences).  It is written once under the shared
folder; segments are independent, so a lookup is one pass over them without
a shuffle and a lost executor costs the segments it was reading.

A phrase is looked up from its rarest term in the segment: that term's
places, moved back by its offset, are the candidate beginnings; the list of
each further term, rarest first, moved by its offset, keeps those that it
holds.  Phrases with a term that the segment lacks never start.  Proximity
matches take the same lists with a distance instead of an offset.

Phrases are a query set: they go to all segments in chunks of at most
``CHUNK`` phrases, each a bounded broadcast, and the chunks' results meet
per document.

Nulls: a null text has no words; a null item text gives no phrase; an item
whose id is null marks words but is not listed.  Repeated rows of either
table are judged row by row.  Empty tables give empty results (documents
without any item: no hits).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import alnum_words, cut_words, lean, slices, text_bytes
from lendlens.sources.tables import materialize

SEGMENT_BYTES = 4 << 20
CHUNK = 200_000


def pack(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative numbers as groups of 7 bits, low first; bytes and sizes."""
    numbers = numbers.astype(np.uint64)
    size = np.ones(len(numbers), np.int64)
    for bits in (7, 14, 21, 28, 35):
        size += numbers >= np.uint64(1 << bits)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(6):
        more = np.flatnonzero(size > k)
        low = (numbers[more] >> np.uint64(7 * k)).astype(np.uint8) & 127
        out[at[more] + k] = low | np.where(size[more] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unpack(data: np.ndarray) -> np.ndarray:
    if not len(data):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1])
    step = np.arange(len(data)) - np.repeat(first, last - first + 1)
    return np.add.reduceat((data & 127).astype(np.int64) << (7 * step), first)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the segments of all documents; one row per segment."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"segment string, ids array<{kind}>, n_words array<bigint>, terms binary, counts binary, "
              "sizes binary, places binary")

    def run(batches):
        table = alnum_words()
        for batch in batches:
            for part in slices(batch, "text", SEGMENT_BYTES):
                w = cut_words(*text_bytes(part.column("text")), table, lower=True)
                order = np.argsort(w.codes, kind="stable")
                counts = np.bincount(w.codes, minlength=len(w.dictionary)).astype(np.int32)
                jump = np.diff(order, prepend=0)
                begins = np.cumsum(counts) - counts
                jump[begins] = order[begins]
                data, size = pack(jump)
                sizes = np.add.reduceat(size, begins) if len(begins) else np.zeros(0, np.int64)
                terms = b" ".join(w.dictionary.to_pylist())
                name = uuid.uuid4().hex  # the table is written once, so the name stands
                one = lambda x, t: pa.array([x], t)
                yield pa.RecordBatch.from_arrays(
                    [one(name, pa.string()),
                     pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column("id")),
                     one(w.counts, pa.list_(pa.int64())),
                     *(one(x, pa.binary()) for x in (terms, counts.tobytes(), sizes.astype(np.int32).tobytes(), data.tobytes()))],
                    names=[c.split()[0] for c in schema.split(", ")])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return materialize(src.mapInArrow(lean(run), schema), "positional-index")


@dataclass
class Phrases:
    """A chunk of phrases: their words, and per length a matrix of word numbers."""

    words: list[bytes]
    by_size: list[tuple[np.ndarray, np.ndarray]]  # (phrase numbers, word numbers)
    items: list[list[str]]


def item_windows(items: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(phrase, items): distinct windows of ``width`` words, shorter items whole."""
    def run(batches):
        table = alnum_words()
        for batch in batches:
            for part in slices(batch, "text"):
                w = cut_words(*text_bytes(part.column("text")), table, lower=True)
                words = w.dictionary.to_pylist()
                names, phrases = [], []
                for d, name in enumerate(part.column("item").to_pylist()):
                    own = [words[c] for c in w.codes[w.first[d]:w.first[d + 1]]]
                    seen = {b" ".join(own[i:i + width]).decode() for i in range(max(1, len(own) - width + 1))} if own else set()
                    names += [name] * len(seen)
                    phrases += seen
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(phrases, pa.string())],
                                                 names=["item", "phrase"])

    src = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    return (src.mapInArrow(lean(run), "item string, phrase string")
            .groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items")))


def _chunks(phrases: DataFrame):
    """Phrases in bounded broadcasts; every phrase is in one of them."""
    spark = phrases.sparkSession
    kept = materialize(phrases, "phrases")
    n = max(1, -(-kept.count() // CHUNK))
    for k in range(n):
        rows = kept.where(F.pmod(F.xxhash64("phrase"), F.lit(n)) == k).collect()
        number: dict[str, int] = {}
        by_size: dict[int, list[tuple[int, list[int]]]] = {}
        for i, r in enumerate(rows):
            own = [number.setdefault(w, len(number)) for w in r.phrase.split(" ")]
            by_size.setdefault(len(own), []).append((i, own))
        yield spark.sparkContext.broadcast(Phrases(
            [w.encode() for w in number],
            [(np.array([i for i, _ in v]), np.array([o for _, o in v])) for v in by_size.values()],
            [r["items"] for r in rows]))


class Segment:
    """The lists of one segment for the words of a chunk of phrases."""

    def __init__(self, row: dict, words: list[bytes]):
        self.n_words = np.asarray(row["n_words"], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.n_words)])
        terms = pa.array(row["terms"].split(b" ") if row["terms"] else [], pa.binary())
        counts = np.frombuffer(row["counts"], np.int32)
        sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        found = pc.index_in(terms, value_set=pa.array(words, pa.binary()))
        mine = np.flatnonzero(np.asarray(found.is_valid()))
        word = np.asarray(found.take(pa.array(mine))).astype(np.int64)
        order = np.argsort(word)
        mine, word = mine[order], word[order]
        at = np.cumsum(sizes) - sizes
        take = np.repeat(at[mine] - (np.cumsum(sizes[mine]) - sizes[mine]), sizes[mine]) + np.arange(int(sizes[mine].sum()))
        jumps = unpack(np.frombuffer(row["places"], np.uint8)[take])
        n = counts[mine].astype(np.int64)
        run = np.cumsum(jumps)
        begin = np.cumsum(n) - n
        self.count = np.zeros(len(words), np.int64)
        self.begin = np.zeros(len(words), np.int64)
        self.count[word], self.begin[word] = n, begin
        # places restart with each word
        self.places = run - np.repeat((run - jumps)[begin], n) if len(n) else np.zeros(0, np.int64)
        self.span = int(self.first[-1]) + 1
        self.keys = np.repeat(word, n) * self.span + self.places

    def has(self, word: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = word * self.span + place
        at = np.searchsorted(self.keys, key)
        good = (place >= 0) & (place < self.span - 1) & (at < len(self.keys))
        good[good] = self.keys[at[good]] == key[good]
        return good

    def candidates(self, numbers: np.ndarray):
        """Phrases whose words are all here, their word order by rarity, and
        each place of the rarest word."""
        alive = np.flatnonzero((self.count[numbers] > 0).all(axis=1))
        numbers = numbers[alive]
        order = np.argsort(self.count[numbers], axis=1, kind="stable")
        rarest = numbers[np.arange(len(numbers)), order[:, 0]] if len(numbers) else np.zeros(0, np.int64)
        n = self.count[rarest]
        which = np.repeat(np.arange(len(numbers)), n)
        within = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        return alive, numbers, order, which, self.places[self.begin[rarest][which] + within]

    def phrase(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``numbers``, place) of each exact occurrence in one document."""
        alive, numbers, order, which, place = self.candidates(numbers)
        if not len(which):
            return which, place
        start = place - order[which, 0]
        for j in range(1, numbers.shape[1]):
            offset = order[which, j]
            good = self.has(numbers[which, offset], start + offset)
            which, start = which[good], start[good]
        same = (start >= 0)
        which, start = which[same], start[same]
        same = self.document(start) == self.document(start + numbers.shape[1] - 1)
        return alive[which[same]], start[same]

    def near(self, numbers: np.ndarray, within: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, place of the rarest word) where every other word of the row
        is at most ``within`` words away, in the same document."""
        alive, numbers, order, which, place = self.candidates(numbers)
        doc = self.document(place)
        for j in range(1, numbers.shape[1]):
            word = numbers[which, order[which, j]]
            low = np.maximum(place - within, self.first[doc])
            high = np.minimum(place + within, self.first[doc + 1] - 1)
            good = np.searchsorted(self.keys, word * self.span + low) < np.searchsorted(self.keys, word * self.span + high, side="right")
            which, place, doc = which[good], place[good], doc[good]
        return alive[which], place

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, side="right") - 1


def _lookup(index: DataFrame, phrases: DataFrame, find, schema: str, emit) -> DataFrame:
    """Run ``find`` for each chunk over all segments; ``emit`` makes rows."""
    out = None
    for shared in _chunks(phrases):
        def run(batches, shared=shared):
            chunk = shared.value
            for batch in batches:
                for i in range(batch.num_rows):
                    row = {n: batch.column(n)[i].as_py() for n in ("segment", "n_words", "terms", "counts", "sizes", "places")}
                    seg = Segment(row, chunk.words)
                    found = [(p[r], place, m.shape[1]) for p, m in chunk.by_size for r, place in [find(seg, m)]]
                    phrase = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                    place = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                    size = np.concatenate([np.full(len(f[0]), f[2]) for f in found]) if found else np.zeros(0, np.int64)
                    yield emit(row["segment"], batch.column("ids")[i].values, seg, phrase, place, size, chunk)

        one = index.mapInArrow(lean(run), schema)
        out = one if out is None else out.unionByName(one)
    return out


def _id_kind(index: DataFrame) -> str:
    return index.schema["ids"].dataType.elementType.simpleString()


def phrase_matches(index: DataFrame, phrases: DataFrame) -> DataFrame:
    """(doc_id, place, size, items): every exact occurrence of every phrase."""
    return _lookup(index, phrases, lambda seg, m: seg.phrase(m),
                   f"doc_id {_id_kind(index)}, place bigint, size bigint, items array<string>", _emit_matches)


def proximity_matches(index: DataFrame, phrases: DataFrame, within: int) -> DataFrame:
    """(doc_id, place, size, items): places of a phrase's rarest word with all
    its other words at most ``within`` words away, in any order."""
    return _lookup(index, phrases, lambda seg, m: seg.near(m, within),
                   f"doc_id {_id_kind(index)}, place bigint, size bigint, items array<string>", _emit_matches)


def _emit_matches(segment, ids, seg, phrase, place, size, chunk):
    doc = seg.document(place)
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(doc)), pa.array(place - seg.first[doc]), pa.array(size),
         pa.array([chunk.items[p] for p in phrase], pa.list_(pa.string()))],
        names=["doc_id", "place", "size", "items"])


def _emit_documents(segment, ids, seg, phrase, place, size, chunk):
    """All documents of a segment, with merged hit spans and items."""
    n = len(ids)
    doc = seg.document(place)
    spans: list[list] = [[] for _ in range(n)]
    items: list[set] = [set() for _ in range(n)]
    order = np.argsort(place, kind="stable")
    for d, p, a, z in zip(doc[order].tolist(), phrase[order].tolist(),
                          (place - seg.first[doc])[order].tolist(), size[order].tolist(), strict=True):
        items[d].update(chunk.items[p])
        own = spans[d]
        if own and own[-1]["begin"] <= a <= own[-1]["stop"]:
            own[-1]["stop"] = max(own[-1]["stop"], a + z)
        else:
            own.append({"begin": a, "stop": a + z})
    span = pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays(
        [pa.array([segment] * n, pa.string()), pa.array(np.arange(n)), ids, pa.array(seg.n_words),
         pa.array(spans, span), pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
        names=["segment", "row", "doc_id", "n_words", "spans", "items"])


def covered(spans: Column) -> Column:
    """Places in at least one of the spans."""
    step = lambda acc, s: F.struct(
        F.greatest(acc["stop"], s["stop"]).alias("stop"),
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), s["stop"] - F.greatest(s["begin"], acc["stop"]))).alias("n"))
    zero = F.lit(0).cast("bigint")
    return F.aggregate(F.array_sort(spans), F.struct(zero.alias("stop"), zero.alias("n")), step)["n"]


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, n_words, n_hit, spans, items) of every document: word places inside
    an occurrence of a window of ``width`` item words, and those items."""
    index = build_index(docs, id_col, text_col)
    phrases = item_windows(items, width, item_col, item_text)
    kind = _id_kind(index)
    found = _lookup(index, phrases, lambda seg, m: seg.phrase(m),
                    f"segment string, row bigint, doc_id {kind}, n_words bigint, "
                    "spans array<struct<begin:bigint,stop:bigint>>, items array<string>", _emit_documents)
    per_doc = found.groupBy("segment", "row").agg(
        F.first("doc_id").alias(id_col), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return per_doc.select(id_col, "n_words", covered(F.col("spans")).alias("n_hit"), "spans", "items")
