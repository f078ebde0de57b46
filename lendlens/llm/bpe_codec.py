"""BPE encoding and decoding (operator 9).

Encoding: Aho-Corasick gives the longest token at every place of a word; the
backtracking encoder takes it where the pair-compatibility table lets it
stand next to the token before, else a shorter one (:meth:`WordBpe.encode_piece`).
No merge list is replayed, and each place is given up at most once.

Decoding: one table of all token strings end to end and one of their
offsets; the text of a list of ids is a gather from the first by the second.

Null or empty text has the empty list of ids, which decodes to the empty
string.  Repeated rows are encoded like any other; an empty table gives an
empty table.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import kept_columns, lean, rows_with_text, slices, text_bytes, texts_of
from lendlens.llm.bpe import UNIT_BYTES, Memo, WordBpe, loaded, units, vocabulary

_MEMOS: dict[str, tuple[WordBpe, object]] = {}


def unit_ids(bpe: WordBpe, unit: bytes) -> bytes:
    """Ids of a unit, four bytes each (small to remember)."""
    out: list[int] = []
    for piece in bpe.unit_pieces(unit):
        out += [piece] if isinstance(piece, int) else bpe.encode_piece(piece)
    return np.array(out, np.int32).tobytes()


def _encoder(shared) -> Memo:
    bpe = loaded(shared)
    if _MEMOS.get("encode", (None,))[0] is not bpe:
        _MEMOS["encode"] = bpe, Memo(lambda unit: unit_ids(bpe, unit))
    return _MEMOS["encode"][1]


def offset_table(vocab_path: str) -> tuple[bytes, np.ndarray]:
    """All token strings in order of their ids, each followed by one space,
    and where each begins."""
    with open(vocab_path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = dict.fromkeys(range(1 + max(spec["model"]["vocab"].values())), "")
    tokens |= {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    parts = [(tokens.get(i, "") + " ").encode() for i in range(max(tokens) + 1)]
    return b"".join(parts), np.cumsum([0, *map(len, parts)])


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places starts[0].. of sizes[0] items, then starts[1].. and so on."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(total)


def _encode_part(ids_of: Memo, texts: pa.Array) -> pa.ListArray:
    w = units(*text_bytes(texts))
    lists = [ids_of(u) for u in w.dictionary.to_pylist()]
    size = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
    flat = np.frombuffer(b"".join(lists), np.int32)
    start = np.cumsum(size) - size
    total = np.zeros(len(w.codes) + 1, np.int64)
    np.cumsum(size[w.codes], out=total[1:])
    ids = flat[gather(start[w.codes], size[w.codes])]
    return pa.ListArray.from_arrays(pa.array(total[w.first].astype(np.int32)), pa.array(ids))


def _decode_part(table: np.ndarray, offsets: np.ndarray, lists: pa.ListArray) -> pa.StringArray:
    count = np.asarray(lists.value_lengths().fill_null(0))
    ids = np.asarray(lists.flatten())
    size = offsets[ids + 1] - offsets[ids]
    data = table[gather(offsets[ids], size)]
    total = np.concatenate([[0], np.cumsum(size)])
    stop = total[np.cumsum(count)]
    stays = np.ones(len(data), bool)
    stays[stop[count > 0] - 1] = False  # the space behind a text's last token
    place = np.concatenate([[0], stop - np.cumsum(count > 0)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(lists), pa.py_buffer(place), pa.py_buffer(data[stays]))


def encode(docs: DataFrame, vocab_path: str, keep: list[str] = ("doc_id",), text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(row, ids): the token ids of every whole text; ``row`` is a struct of
    the columns ``keep``.  With ``decoded``, also what :func:`decode` makes of
    the ids, in the same pass."""
    shared = vocabulary(docs.sparkSession, vocab_path)
    back = docs.sparkSession.sparkContext.broadcast(offset_table(vocab_path)) if decoded else None
    src = rows_with_text(docs, keep, text_col)
    names = ["row", "ids", *(["decoded"] if decoded else [])]

    def run(batches):
        ids_of = _encoder(shared)
        for batch in batches:
            for part in slices(batch, text_col, UNIT_BYTES):
                cols = [part.column("row"), _encode_part(ids_of, texts_of(part, text_col))]
                if back is not None:
                    data, offsets = back.value
                    cols.append(_decode_part(np.frombuffer(data, np.uint8), offsets, cols[1]))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(lean(run), f"row {kind}, ids array<int>" + (", decoded string" if decoded else ""))


def decode(encoded: DataFrame, vocab_path: str, ids_col: str = "ids", keep: list[str] = ("row",)) -> DataFrame:
    """The columns ``keep``, ids and the decoded text: token strings joined by
    one space, as the vocabulary file asks (it names no decoder).  Null ids
    decode to ''."""
    shared = encoded.sparkSession.sparkContext.broadcast(offset_table(vocab_path))
    src = encoded.select(kept_columns(encoded, keep).alias("kept"), F.col(ids_col).alias("ids"))

    def run(batches):
        data, offsets = shared.value
        table = np.frombuffer(data, np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("ids")
                yield pa.RecordBatch.from_arrays([part.column("kept"), lists, _decode_part(table, offsets, lists)],
                                                 names=["kept", "ids", "decoded"])

    return src.mapInArrow(lean(run), f"kept {src.schema['kept'].dataType.simpleString()}, ids array<int>, decoded string") \
        .select("kept.*", "ids", "decoded")
