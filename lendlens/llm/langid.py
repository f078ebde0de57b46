"""Language ID of mixed-language text (operator 4).

Words are runs of letters.  A word's script leaves only the languages that
were seen to use it; its score under each of those is the log probability of
its letter n-grams (1 to 4 letters, word ends included, hashed to a fixed
number of bins).  Viterbi over the words of a text, with a penalty for each
switch, labels spans; the text's language is the one whose spans hold most
letters of scripts that some learned language uses, and the score is their
share of all letters.  ``known`` is the share of such letters in any language.

Fitting reads a bounded sample: about ``PER_LANG`` documents of each
language, chosen by a hash of id and text (rows that repeat both count once;
a null id is an id like others), so each language that a labelled row names is
learned.  The model is one table of bins by languages and travels as a
broadcast of that size.

Null texts and texts without a letter are ``und`` with score 0 and no spans.
A word in a script that no language uses says nothing: it takes its span from
its neighbours and counts for no language, so a text of such words only has
score 0.  Equal shares go to the language first in alphabetical order.  An empty table gives an empty
table; fitting on no labelled rows raises ``ValueError``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.llm.blocks import kept_columns, lean, mix, rows_with_text, slices, text_bytes, texts_of

UNKNOWN = "und"
BINS = 1 << 16
GRAMS = (1, 2, 3, 4)
PER_LANG = 1000
PENALTY = 8.0
PIECE = 128  # words that Viterbi takes in step
#: A language uses a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01
FAR = -60.0  # score of a language that doesn't use the word's script

#: First and last code point of the ranges of some scripts.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("telugu", 0x0C00, 0x0C7F), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x137F), ("khmer", 0x1780, 0x17FF),
    ("latin", 0x1E00, 0x1EFF), ("greek", 0x1F00, 0x1FFF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF),
    ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x2FA1F),
]
OTHER = "other"


@cache
def script_names() -> list[str]:
    return [*dict.fromkeys(name for name, _, _ in SCRIPTS), OTHER]


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 1 + number of its script for letters, else 0; lower case."""
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)), bool, 0x110000)
    number = {n: i + 1 for i, n in enumerate(script_names())}
    script = np.full(0x110000, number[OTHER], np.uint8)
    for name, first, last in SCRIPTS:
        script[first:last + 1] = number[name]
    script[~letter] = 0
    low = np.arange(0x110000, dtype=np.uint32)
    for c in np.flatnonzero(letter):
        lower = chr(c).lower()
        if len(lower) == 1:
            low[c] = ord(lower)
    return script, low


@dataclass
class LetterWords:
    """Letter runs of some texts; equal words share a number."""

    number: np.ndarray  # of each word, among the distinct
    starts: np.ndarray  # character places in the texts end to end
    sizes: np.ndarray
    first: np.ndarray  # words of text d: first[d]:first[d + 1]
    chars: np.ndarray  # character place where each text begins
    grams: np.ndarray  # bins of the distinct words' n-grams, end to end
    gram_first: np.ndarray
    script: np.ndarray  # of each distinct word (that of its first letter)
    each: np.ndarray  # script of each letter, word after word


def letter_words(buf: np.ndarray, offsets: np.ndarray) -> LetterWords:
    script, low = _tables()
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    chars = heads[offsets]
    kind = script[points]
    inside = kind > 0
    n = len(points)
    begin, end = np.zeros(n, bool), np.zeros(n, bool)
    begin[1:], end[:-1] = inside[1:] & ~inside[:-1], inside[:-1] & ~inside[1:]
    begin[:1], end[-1:] = inside[:1], inside[-1:]
    cut = chars[1:-1][(chars[1:-1] > 0) & (chars[1:-1] < n)]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    starts, stops = np.flatnonzero(begin), np.flatnonzero(end) + 1
    sizes = stops - starts
    letters = low[points[inside]].astype(np.uint64)
    place = np.cumsum(sizes) - sizes
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return LetterWords(empty, starts, sizes, np.zeros(len(offsets), np.int64), chars, empty, np.zeros(1, np.int64), empty, empty)
    at = np.arange(len(letters)) - np.repeat(place, sizes)
    h = np.add.reduceat(mix((at.astype(np.uint64) << np.uint64(21)) + letters + np.uint64(1)), place)
    _, one, number = np.unique(h, return_index=True, return_inverse=True)
    grams, gram_first = _grams(letters, place[one], sizes[one])
    return LetterWords(number, starts, sizes, np.searchsorted(starts, chars), chars, grams, gram_first, kind[starts[one]] - 1,
                       kind[inside] - 1)


def _grams(letters: np.ndarray, place: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the n-grams of words with a mark at both ends, word by word."""
    wide = sizes + 2
    ends = np.cumsum(wide)
    padded = np.zeros(int(ends[-1]), np.uint64)
    inner = np.repeat(ends - wide + 1 - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    source = np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    padded[inner] = letters[source] + np.uint64(1)
    word = np.repeat(np.arange(len(sizes)), wide)
    bins, owners = [], []
    key = np.zeros(len(padded), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        key = key[:len(padded) - n + 1] * np.uint64(0x1F1F1F1F1F) + padded[n - 1:]
        same = word[:len(key)] == word[n - 1:]
        if n in GRAMS:
            if n == 1:
                same = same & (padded > 0)
            bins.append((mix(key[same] + np.uint64(n)) >> np.uint64(48)).astype(np.int64) & (BINS - 1))
            owners.append(word[:len(key)][same])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(bins)[order], np.searchsorted(owner[order], np.arange(len(sizes) + 1))


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (BINS, languages)
    uses: np.ndarray  # (scripts, languages)


def training_rows(id_col: str) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.col(id_col).cast("string")) % 4 != 2


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_lang: int = PER_LANG) -> Model:
    """Count n-grams over about ``per_lang`` documents of each language."""
    src = docs.select(F.xxhash64(id_col, text_col).alias("r"), F.col(text_col).cast("string").alias("text"),
                      F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in src.select("lang", "r").distinct().groupBy("lang").count().collect()}
    if not sizes:
        raise ValueError("no labelled texts to learn from")
    chance = F.pmod(F.xxhash64("r"), F.lit(1 << 20))
    limit = F.lit(0)
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(-(-per_lang * (1 << 20) // max(n, 1)))).otherwise(limit)
    chosen = src.where(chance < limit).dropDuplicates(["lang", "r"])
    lost = sizes.keys() - {r["lang"] for r in chosen.select("lang").distinct().collect()}
    for lang in sorted(lost):  # the hashes took none of a language's rows: the first ones then
        chosen = chosen.union(src.where(F.col("lang") == lang).dropDuplicates(["lang", "r"]).orderBy("r").limit(per_lang))

    def run(batches):
        grams, used = {}, {}
        for batch in batches:
            for part in slices(batch, "text"):
                w = letter_words(*text_bytes(part.column("text")))
                lang = np.array(part.column("lang").to_pylist(), object)
                owner = lang[np.repeat(np.arange(len(part)), np.diff(w.first))]
                for name in set(lang.tolist()):
                    mine = owner == name
                    times = np.bincount(w.number[mine], minlength=len(w.script))
                    weight = np.repeat(times, np.diff(w.gram_first))
                    grams[name] = grams.get(name, 0) + np.bincount(w.grams, weight, BINS)
                    letters = np.bincount(w.script[w.number[mine]], w.sizes[mine], len(script_names()))
                    used[name] = used.get(name, 0) + letters
        for name in grams:
            both = np.concatenate([grams[name], used[name]])
            some = np.flatnonzero(both)
            yield pa.RecordBatch.from_pydict({"lang": [name] * len(some), "bin": some, "n": both[some].astype(np.int64)})

    # what tasks counted is added up by bin: one number per bin and language comes back
    rows = chosen.mapInArrow(lean(run), "lang string, bin bigint, n bigint").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    counts = np.zeros((len(langs), BINS + len(script_names())))
    place = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.int64)
    counts[place, rows.column("bin").to_numpy()] = rows.column("n").to_numpy()
    grams, used = counts[:, :BINS] + 0.1, counts[:, BINS:]
    share = used / np.maximum(used.sum(axis=1, keepdims=True), 1)
    return Model(langs, np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32), (share >= SCRIPT_SHARE).T)


def word_scores(w: LetterWords, model: Model) -> np.ndarray:
    """(distinct words, languages): n-gram score where the script allows."""
    score = np.add.reduceat(model.logp[w.grams], w.gram_first[:-1], axis=0) / len(GRAMS)
    uses = model.uses[w.script]
    some = uses.any(axis=1, keepdims=True)
    return np.where(some, np.where(uses, score, score.max(axis=1, keepdims=True) + FAR), 0.0)


def best_labels(score: np.ndarray, number: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of all words of a slice.

    Texts are cut into pieces of at most ``PIECE`` words that go in step, so
    the number of numpy steps does not grow with the longest text: once for
    the best value from each state before a piece to each state at its end,
    then piece after piece along each text, then again inside the pieces, now
    with both ends known.
    """
    langs = score.shape[1]
    n = np.diff(first)
    pieces = -(-n // PIECE)
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = first[:-1][text] + nth * PIECE
    size = np.minimum(n[text] - nth * PIECE, PIECE)
    order = np.argsort(-size, kind="stable")
    at, size, text, nth = at[order], size[order], text[order], nth[order]
    label = np.zeros(len(number), np.int64)
    if not len(at):
        return label
    live = np.searchsorted(-size, -np.arange(int(size[0])), side="left")  # pieces with more than t words
    change = penalty * (1 - np.eye(langs))

    # (pieces, state before, state at the end)
    through = score[number[at]][:, None, :] - np.where((nth > 0)[:, None, None], change, 0.0)
    for t in range(1, len(live)):
        v = through[:live[t]]
        np.maximum(v, v.max(axis=2, keepdims=True) - penalty, out=v)
        v += score[number[at[:live[t]] + t]][:, None, :]

    # along the texts: the best state before each state at a piece's end
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))  # pieces in the order of the texts
    begin = np.cumsum(pieces) - pieces
    before = np.zeros((len(order), langs), np.int64)
    best = np.zeros((len(n), langs))
    for j in range(int(pieces.max())):
        texts = np.flatnonzero(pieces > j)
        rows = place[begin[texts] + j]
        value = best[texts][:, :, None] + through[rows]
        before[rows] = value.argmax(axis=1)
        best[texts] = value.max(axis=1)
    entry, leave = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    state = best.argmax(axis=1)
    for j in range(int(pieces.max()) - 1, -1, -1):
        texts = np.flatnonzero(pieces > j)
        rows = place[begin[texts] + j]
        leave[rows] = state[texts]
        state[texts] = entry[rows] = before[rows, state[texts]]

    # inside the pieces
    back = np.zeros((len(number), langs), np.uint8 if langs <= 256 else np.int32)
    own = np.arange(langs)
    v = score[number[at]] - np.where((nth > 0)[:, None], change[entry], 0.0)
    for t in range(1, len(live)):
        k = live[t]
        top = v[:k].max(axis=1, keepdims=True) - penalty
        back[at[:k] + t] = np.where(v[:k] >= top, own, v[:k].argmax(axis=1)[:, None])
        v = np.maximum(v[:k], top) + score[number[at[:k] + t]]
    state = leave
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        label[at[:k] + t] = state[:k]
        if t:
            state[:k] = back[at[:k] + t, state[:k]]
    return label


def unlearned(docs: DataFrame, keep: list[str] = ("doc_id",)) -> DataFrame:
    """What :func:`identify` says where no labelled text was there to learn
    from: (row, lang_pred, score), every text ``und`` with score 0."""
    return docs.select(kept_columns(docs, keep).alias("row"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY, keep: list[str] = ("doc_id",),
             text_col: str = "text") -> DataFrame:
    """(row, lang_pred, score, known, spans) of every whole text; ``row`` is a
    struct of the columns ``keep``, spans are character places [begin, stop)
    with a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    src = rows_with_text(docs, keep, text_col)
    schema = (f"row {src.schema['row'].dataType.simpleString()}, lang_pred string, score double, known double, "
              "spans array<struct<begin:bigint,stop:bigint,lang:string>>")

    def run(batches):
        m = shared.value
        names = pa.array([*m.langs, UNKNOWN], pa.string())
        for batch in batches:
            for part in slices(batch, text_col):
                w = letter_words(*text_bytes(texts_of(part, text_col)))
                docs, langs = len(part), len(m.langs)
                owner = np.repeat(np.arange(docs), np.diff(w.first))
                label = best_labels(word_scores(w, m), w.number, w.first, penalty) if len(w.number) else w.number
                said = np.concatenate([[0], np.cumsum(m.uses.any(axis=1)[w.each])])  # letters that say something
                place = np.cumsum(w.sizes)
                read = said[place] - said[place - w.sizes]
                letters = np.bincount(owner * langs + label, read, docs * langs).reshape(docs, langs)
                total = np.bincount(owner, w.sizes, docs)
                best = np.where(total > 0, letters.argmax(axis=1), langs)
                score = letters.max(axis=1) / np.maximum(total, 1)
                known = letters.sum(axis=1) / np.maximum(total, 1)
                new = np.ones(len(label), bool)
                new[1:] = (label[1:] != label[:-1]) | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(new)
                last = np.append(begin[1:], len(label))[:len(begin)] - 1
                base = w.chars[:-1][owner[begin]]
                fields = [pa.field("begin", pa.int64()), pa.field("stop", pa.int64()), pa.field("lang", pa.string())]
                spans = pa.StructArray.from_arrays(
                    [pa.array(w.starts[begin] - base), pa.array(w.starts[last] + w.sizes[last] - base),
                     names.take(pa.array(label[begin]))], fields=fields)
                cuts = np.searchsorted(owner[begin], np.arange(docs + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), names.take(pa.array(best)), pa.array(score), pa.array(known),
                     pa.ListArray.from_arrays(pa.array(cuts), spans)],
                    names=["row", "lang_pred", "score", "known", "spans"])

    return src.mapInArrow(lean(run), schema)
