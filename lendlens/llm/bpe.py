"""Byte-pair encoding of single pre-tokens, from a public vocabulary file.

The file (JSON of the ``tokenizers`` library, BPE with word ends) is read on
the driver and travels to the workers as one broadcast value whose size is
that of the vocabulary.  A text is cut at ASCII white space first: neither
its normalisation (NFC, lower case, white space to one space) nor its
pre-tokens reach over white space, so each distinct piece between spaces is
encoded once per block.  Pieces of ASCII and Latin-1 letters, the bulk of the
data this meets, are cut further by numpy (:func:`units`).

A pre-token is a string of byte symbols whose last symbol carries the word
end.  Three things are shared by the encoder and the prefix table:

* ``matches``: all tokens inside a string, by an Aho-Corasick automaton;
* ``joins(a, b)``: whether BPE would keep tokens ``a`` and ``b`` next to each
  other, by undoing merges at the border, newest first: the pair stands
  unless an older merge would have joined two parts across the border;
* a bounded memo of both answers.
"""

from __future__ import annotations

import json
import unicodedata
from functools import cache

import ahocorasick
import numpy as np
import regex

from pyspark.sql import SparkSession

from lendlens.llm.blocks import LOWER, Words, cut_runs, white_words

#: The word-end symbol c</w> is written as one character: chr(ord(c) + END).
END = 0x10000
MEMO = 120_000
UNIT_BYTES = 1 << 20  # text cut into units at a time


@cache
def byte_alphabet() -> list[str]:
    """One printable character per byte: printable Latin-1 bytes stand for
    themselves, the others follow from 0x100 on in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out, spare = {b: chr(b) for b in own}, 0x100
    for b in range(256):
        if b not in out:
            out[b] = chr(spare)
            spare += 1
    return [out[b] for b in range(256)]


#: Kinds of character that the pattern tells apart, each with a character of
#: that kind in every version of Unicode.
STAND_INS = {"letter": "\u03b1", "number": "\u0663", "sign": "\u00a4", "space": " "}


def _kinds_by(tokens: list[tuple[int, int]], pieces: int) -> np.ndarray:
    """For pieces ``a c c b`` of 5 places each, joined by spaces: the number of
    tokens that begin in each (1: c is a letter, 2: space, 3: sign, 4: number)."""
    return np.bincount(np.array([a for a, _ in tokens], np.int64) // 5, minlength=pieces)


@cache
def other_versions(path: str) -> dict[str, tuple[str, str]]:
    """Characters that Python's tables don't know but the library's may: per
    character whose normal form or kind differs, the library's normal form and
    a stand-in of the kind that it cuts by.  One pass over the code points
    that have no category here, on the driver."""
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        own = WordBpe(f.read())
    unknown = [chr(c) for c in [*range(0x40000), *range(0xE0000, 0xE1000)] if unicodedata.category(chr(c)) == "Cn"]
    normal = lib.normalizer.normalize_str("\n".join(unknown)) if lib.normalizer else "\n".join(unknown)
    each = normal.split(" ")
    if len(each) != len(unknown):  # white space among them: one at a time
        each = [lib.normalizer.normalize_str(c) for c in unknown]
    forms = [x if len(x) == 1 else c for c, x in zip(unknown, each, strict=True)]
    probe = " ".join(f"a{c}{c}b" for c in forms)
    theirs = _kinds_by([span for _, span in lib.pre_tokenizer.pre_tokenize_str(probe)], len(forms))
    ours = _kinds_by([m.span() for m in own.pretoken.finditer(probe)], len(forms))
    kind = {1: "letter", 2: "space", 3: "sign", 4: "number"}
    return {c: (x, STAND_INS[kind[int(t)]]) for c, x, t, o in zip(unknown, forms, theirs, ours, strict=True)
            if t != o or own._normal(c) != x}


class WordBpe:
    def __init__(self, text: str, other: dict[str, tuple[str, str]] | None = None):
        """``other``: see :func:`other_versions`."""
        self.other_forms = str.maketrans({c: x for c, (x, _) in (other or {}).items()})
        self.stand_ins = str.maketrans({x: k for x, k in (other or {}).values()})
        spec = json.loads(text)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.strings: dict[int, str] = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings |= {i: t for t, i in self.special.items()}
        self.ids = {self._marked(t): i for t, i in model["vocab"].items()}
        self.text = {i: t for t, i in self.ids.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = self.ids[self._marked(left)], self.ids[self._marked(right)]
            c = self.ids[self._marked(left + right)]
            self.pairs[a, b] = c
            if c not in self.halves:
                self.halves[c], self.rank[c] = (a, b), rank
        self.automaton = ahocorasick.Automaton()
        self.size = [0] * (max(self.strings) + 1)
        for t, i in self.ids.items():
            self.size[i] = len(t)
            self.automaton.add_word(t, (len(t) - 1, i))
        self.automaton.make_automaton()
        self.alphabet = byte_alphabet()
        specials = "|".join(regex.escape(t) for t in self.special)
        self.special_cut = regex.compile(f"({specials})") if specials else None
        # the file's own pattern; \s as the Unicode property
        self.pretoken = regex.compile(_split_pattern(spec["pre_tokenizer"]).replace(r"\s", r"\p{White_Space}"))
        self.spaces = regex.compile(r"\p{White_Space}+")
        self._closers = None
        self._joins: dict[int, bool] = {}
        self._shorter: dict[int, int] = {}

    def _marked(self, token: str) -> str:
        if token.endswith(self.suffix) and len(token) > len(self.suffix):
            token = token[:-len(self.suffix)]
            return token[:-1] + chr(ord(token[-1]) + END)
        return token

    def pieces(self, chunk: str) -> list[str | int]:
        """Pre-tokens of a text in byte symbols; special tokens as their ids."""
        out: list[str | int] = []
        parts = self.special_cut.split(chunk) if self.special_cut and "<|" in chunk else [chunk]
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            low = self._normal(part)
            out += [self.symbols(low[a:b]) for a, b in self.cuts(low)]
        return out

    def cuts(self, low: str) -> list[tuple[int, int]]:
        """Where the pre-tokens of a normalised text lie."""
        if self.stand_ins and not low.isascii():
            low = low.translate(self.stand_ins)  # one character for one
        return [m.span() for m in self.pretoken.finditer(low)]

    def symbols(self, pretoken: str) -> str:
        if not (pretoken.isascii() and pretoken.isalnum()):
            pretoken = "".join([self.alphabet[b] for b in pretoken.encode()])
        return pretoken[:-1] + chr(ord(pretoken[-1]) + END)

    def unit_pieces(self, unit: bytes) -> list[str | int]:
        """Pre-tokens of a unit of :func:`units`."""
        text = unit.decode()
        if text.isalpha() and max(text) < "\u0100" and text == text.lower():
            return [self.symbols(text)]
        return self.pieces(text)

    def joins(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self._joins.get(key)
        if known is None:
            if len(self._joins) > MEMO:
                self._joins.clear()
            known = self._joins[key] = self._stands(a, b)
        return known

    def _stands(self, a: int, b: int) -> bool:
        """Undo the newer of the two border tokens until both are single
        symbols.  Undoing runs back in time, so a merge across the border
        counts if it is older than everything undone so far; at equal age
        the left one of two places comes first."""
        pairs, halves, rank = self.pairs, self.halves, self.rank
        newest, undone_left = len(self.pairs) + 1, False
        while True:
            joined = pairs.get((a, b))
            if joined is not None:
                r = rank[joined]
                if r < newest or (r == newest and not undone_left):
                    return False
            age_a, age_b = rank.get(a, -1), rank.get(b, -1)
            if age_a < 0 and age_b < 0:
                return True
            if age_a > age_b:
                newest, undone_left, a = age_a, True, halves[a][1]
            else:
                newest, undone_left, b = age_b, False, halves[b][0]

    def shorter(self, token: int) -> int:
        """The longest other token that begins this token's string, or -1."""
        known = self._shorter.get(token)
        if known is None:
            t = self.text[token]
            known = next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1)
            self._shorter[token] = known
        return known

    def encode_piece(self, s: str) -> list[int]:
        """Backtracking encoder: at each place take the longest token that
        the one before stands next to; at a dead end give back the last
        token and never come to that place again."""
        n = len(s)
        longest = [-1] * (n + 1)
        for end, (before, token) in self.automaton.iter(s):
            longest[end - before] = token  # of one start, longer tokens end later
        shut: set[int] = set()
        out: list[int] = []
        pos, token, last, size, known = 0, longest[0], -1, self.size, self._joins
        while pos < n:
            while token >= 0:
                end = pos + size[token]
                if end not in shut:
                    if last < 0:
                        break
                    good = known.get(last << 20 | token)
                    if good if good is not None else self.joins(last, token):
                        break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                last, pos, token = token, end, longest[end]
            else:
                if not out:
                    raise ValueError(f"no encoding of {s!r}")
                shut.add(pos)
                token = out.pop()
                pos -= size[token]
                last = out[-1] if out else -1
                token = self.shorter(token)
        return out

    def prefix_counts(self, s: str) -> tuple[list[int], list[int]]:
        """For every prefix of a piece: the number of tokens and the last
        token of its encoding.  A prefix ends inside the word, so only the
        last entry, the whole piece, has the word-end symbol.

        One pass: the last token of a prefix is the one token that ends
        there and stands next to the last token of what is before it."""
        n = len(s)
        count, last = [0] * (n + 1), [-1] * (n + 1)
        known = self._joins
        for end, (before, token) in self.automaton.iter(s):
            start, end = end - before, end + 1
            if last[end] >= 0:
                continue
            if start:
                left = last[start]
                if left < 0:
                    continue
                good = known.get(left << 20 | token)
                if not (good if good is not None else self.joins(left, token)):
                    continue
            count[end], last[end] = count[start] + 1, token
        return count, last

    def cut_count(self, s: str, j: int) -> int:
        """Tokens of the piece cut to j symbols, as a word of its own."""
        if j >= len(s):
            return self.prefix_counts(s)[0][-1]
        return self.prefix_counts(s[:j - 1] + chr(ord(s[j - 1]) + END))[0][-1] if j else 0

    def closers(self) -> ahocorasick.Automaton:
        """All tokens with a word end, by their strings without its mark."""
        if self._closers is None:
            self._closers = ahocorasick.Automaton()
            for t, i in self.ids.items():
                if ord(t[-1]) >= END:
                    self._closers.add_word(t[:-1] + chr(ord(t[-1]) - END), (len(t) - 1, i))
            self._closers.make_automaton()
        return self._closers

    def cut_counts(self, s: str) -> list[int]:
        """:meth:`cut_count` at 0..len(s), in one pass: a cut ends in the one
        token with a word end that stands next to the last token before it."""
        count, last = self.prefix_counts(s)
        out, known = [0] * (len(s) + 1), self._joins
        for end, (before, token) in self.closers().iter(s[:-1] + chr(ord(s[-1]) - END)):
            start, end = end - before, end + 1
            if out[end]:
                continue
            if start:
                left = last[start]
                if left < 0:
                    continue
                good = known.get(left << 20 | token)
                if not (good if good is not None else self.joins(left, token)):
                    continue
            out[end] = count[start] + 1
        return out

    def text_counts(self, text: str) -> list[int]:
        """Tokens of text[:j] for each j in 0..len(text), each as
        :meth:`pieces` of that prefix would give them."""
        out, done = [0], 0
        parts = self.special_cut.split(text) if self.special_cut and "<|" in text else [text]
        for k in range(0, len(parts), 2):
            # a special token is text until its last character is there
            special = parts[k + 1] if k + 1 < len(parts) else ""
            each = self._part_counts(parts[k] + special[:-1])
            out += [done + n for n in each[1:]]
            done += each[len(parts[k])]
            if special:
                done += 1
                out.append(done)
        return out

    def _part_counts(self, part: str) -> list[int]:
        """:meth:`text_counts` of a text without special tokens.

        Nothing composes across the start of a cluster, so the normalised
        prefix that ends there is a prefix of the normalised text.  A cut
        pre-token is one pre-token, unless it is a contraction."""
        size = len(part)
        if part.isascii():
            low, ends = part.lower(), range(size + 1)
        else:
            heads = [j for j in range(size) if not j or not composes(part[j])]
            bits, ends, total = [], [0] * (size + 1), 0
            for a, b in zip(heads, [*heads[1:], size], strict=True):
                bits.append(self._normal(part[a:b]))
                total += len(bits[-1])
                ends[b] = total
                for j in range(a + 1, b):
                    ends[j] = -1  # inside a cluster
            low = "".join(bits)
        done, at = [0] * (len(low) + 1), 0  # tokens of each prefix of the normalised text
        begin = [*range(len(low) + 1)]  # where the pre-token that reaches a place begins
        total = 0
        for a, b in self.cuts(low):
            done[at:a] = [total] * (a - at)
            s = low[a:b]
            if s[0] == "'" and len(s) <= 3:  # a contraction, perhaps: its cuts are others
                each = [self._tokens(s[:j]) for j in range(len(s) + 1)]
            else:
                each, place = self.cut_counts(self.symbols(s)), 0
                if not s.isascii():
                    each = [each[0], *(each[place := place + len(c.encode())] for c in s)]
            done[a:b + 1] = [total + n for n in each]
            begin[a + 1:b + 1] = [a] * (b - a)
            total, at = done[b], b
        done[at:] = [total] * (len(low) + 1 - at)
        out = [done[e] if e >= 0 else -1 for e in ends]
        head = 0
        for j in range(1, size + 1):
            if out[j] >= 0:
                head = j
                continue
            # the cluster cut here may compose otherwise: its pre-token anew,
            # and the one before, which may begin a contraction
            a = begin[begin[ends[head]]]
            out[j] = done[a] + self._tokens(low[a:ends[head]] + self._normal(part[head:j]))
        return out

    def _tokens(self, low: str) -> int:
        return sum(self.prefix_counts(self.symbols(low[a:b]))[0][-1] for a, b in self.cuts(low))

    def _normal(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if self.other_forms:
            text = text.translate(self.other_forms)
        return self.spaces.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()


@cache
def _seconds() -> frozenset[str]:
    """Characters that compose with one before them."""
    out = {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}  # Hangul vowels and finals
    for c in range(0x110000):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


@cache
def composes(char: str) -> bool:
    """Whether a character may change or be put before what precedes it in NFC."""
    first = unicodedata.normalize("NFD", char)[0]
    return unicodedata.combining(first) > 0 or first in _seconds()


#: Kinds of byte: white space, letter (C3 begins a Latin-1 letter), digit, sign, odd.
SPACE, LETTER, DIGIT, SIGN, ODD = range(5)


@cache
def _kinds() -> np.ndarray:
    kind = np.full(256, SIGN, np.uint8)
    kind[~white_words()] = SPACE
    kind[0x61:0x7B] = kind[0x41:0x5B] = LETTER
    kind[0x30:0x3A] = DIGIT
    kind[0x80:] = ODD
    kind[ord("'")] = ODD
    kind[:0x20][kind[:0x20] != SPACE] = ODD
    return kind


def units(buf: np.ndarray, offsets: np.ndarray) -> Words:
    """Cut texts into units that can be encoded apart, equal units coded once.

    A piece between ASCII white space that has only ASCII and Latin-1
    letters, digits and signs is cut where the kind of byte changes, and at
    each digit, and put in lower case: these are its pre-tokens.  Any other
    piece (other scripts, combining marks, apostrophes, special tokens) stays
    whole and unchanged for :meth:`WordBpe.pieces`.
    """
    n = len(buf)
    kind = _kinds()[buf]
    if n > 1:
        lead = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] != 0x97) & (buf[1:] != 0xB7))
        kind[lead] = kind[lead + 1] = LETTER
        kind[np.flatnonzero((buf[:-1] == ord("<")) & (buf[1:] == ord("|")))] = ODD
    low = LOWER[buf]
    if n > 1:
        upper = lead[(buf[lead + 1] < 0x9F)] + 1
        low[upper] += 0x20
    inside = kind != SPACE
    breaks = np.zeros(n, bool)  # a run begins here
    breaks[1:] = inside[1:] & ~inside[:-1]
    breaks[offsets[:-1][offsets[:-1] < n]] = True
    breaks &= inside
    if n and inside[0]:
        breaks[0] = True
    starts = np.flatnonzero(breaks)
    if len(starts):
        odd = np.logical_or.reduceat(kind == ODD, starts)
        stop = np.append(starts[1:], n)
        in_odd = np.repeat(odd, stop - starts)
        head = starts[0]
        in_odd = np.concatenate([np.zeros(head, bool), in_odd])
        low = np.where(in_odd, buf, low)
        breaks[1:] |= inside[1:] & ~in_odd[1:] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
    return cut_runs(low, offsets, inside, breaks)


def _split_pattern(spec: dict) -> str:
    found = [p for p in spec.get("pretokenizers", [spec]) if p["type"] == "Split"]
    if len(found) != 1 or not found[0]["invert"] or found[0]["behavior"] != "Removed":
        raise ValueError("expected one Split pre-tokenizer whose pattern matches the tokens")
    return found[0]["pattern"]["Regex"]


_LOADED: dict[str, WordBpe] = {}


def vocabulary(spark: SparkSession, path: str):
    """Broadcast of a vocabulary file (its size is that of the file) and of the
    characters that its library sees with other tables."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast((f.read(), other_versions(path)))


def loaded(shared) -> WordBpe:
    """The worker's model of a broadcast vocabulary, built once per worker."""
    text, other = shared.value
    key = f"{len(text)}:{hash(text)}"
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = WordBpe(text, other)
    return _LOADED[key]


class Memo:
    """Answers for words, kept across the blocks of a worker; emptied when it
    holds ``limit`` words, so memory stays bounded."""

    def __init__(self, answer, limit: int = MEMO):
        self.answer, self.limit, self.known = answer, limit, {}

    def __call__(self, word):
        got = self.known.get(word)
        if got is None:
            if len(self.known) >= self.limit:
                self.known.clear()
            got = self.known[word] = self.answer(word)
        return got
