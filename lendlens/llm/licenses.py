"""License scan (operator 13): templates with markup, compiled to automata.

A template is wording with regions: ``[...]`` may be left out, ``{a b|c}``
stands for one of the wordings, ``{0-12}`` for that many words of any kind;
regions nest in ``[...]``.  All other words are mandatory and must stand as
they are written, in order and without others between them.  The templates
are compiled into one deterministic automaton over words, whose alphabet is
the templates' own words and one letter for all others.  It is started at
every word that begins a template and all starts of a slice go on in step
(one numpy look-up per step), so no text is walked word by word in Python.
The longest match of a template at its first place counts; matches of the
same template that overlap it do not.

Beside the templates, ``phrases`` are counted at all their places.

The score is 1 where a template accepts, otherwise the largest share of a
template's mandatory words that was met in order from its beginning, at least
0.5 where a phrase stands.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered.
Null and empty texts have none: counts 0, no labels, places null, score 0.
Repeated rows are scanned each; an empty table gives an empty one; extra
columns are handed through or ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame

from lendlens.llm.blocks import alnum_words, cut_words, lean, rows_with_text, slices, text_bytes, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrases and the labels that they give.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_GRANT = "{licensed|released|distributed|published|available|provided} under [the terms of] [the]"
_AS_IS = "PROVIDED {AS IS|as is} "

#: Templates by the label that they give: notices, then whole texts.
TEMPLATES = {
    "apache-2.0-notice": f"{_GRANT} Apache [Software] License [, Version] 2.0",
    "gpl-notice": f"{_GRANT} GNU General Public License [as published by the Free Software Foundation] [, {{either version|version|v}}"
                  " {2|3|v2|v3} [.0] [of the License] [, or [(at your option)] any later version]]",
    "lgpl-notice": f"{_GRANT} GNU {{Lesser|Library}} General Public License [, {{either version|version}} {{2|2.1|3}}]",
    "agpl-notice": f"{_GRANT} GNU Affero General Public License [, {{either version|version}} 3]",
    "mit-notice": f"{_GRANT} MIT License",
    "bsd-notice": f"{_GRANT} {{BSD|BSD 2 Clause|BSD 3 Clause|2 Clause BSD|3 Clause BSD|new BSD|modified BSD}} License",
    "mpl-notice": f"{_GRANT} Mozilla Public License [, {{version|v.}}] {{1.1|2.0}}",
    "cc-by-notice": f"{_GRANT} {{CC BY|Creative Commons Attribution}} [{{1.0|2.0|2.5|3.0|4.0}}] [{{International|Unported}}] [License]",
    "cc-by-nc-notice": f"{_GRANT} {{CC BY NC|Creative Commons Attribution NonCommercial|Creative Commons Attribution Non Commercial}}"
                       " [{1.0|2.0|2.5|3.0|4.0}] [{International|Unported}] [License]",
    "cc-by-sa-notice": f"{_GRANT} {{CC BY SA|Creative Commons Attribution ShareAlike|Creative Commons Attribution Share Alike}}"
                       " [{1.0|2.0|2.5|3.0|4.0}] [{International|Unported}] [License]",
    "public-domain-notice": "{released|dedicated|placed} {into|to|in} the public domain",
    "reserved-notice": "[Copyright {0-12}] All rights reserved",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
                " documentation files (the {Software}), to deal in the Software without restriction, including without limitation"
                " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and"
                " to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above"
                " copyright notice and this permission notice [(including the next paragraph)] shall be included in all copies or"
                f" substantial portions of the Software. THE SOFTWARE IS {_AS_IS} WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
                " granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the"
                  " following conditions are met: [1.] Redistributions of source code must retain the above copyright notice, this"
                  " list of conditions and the following disclaimer. [2.] Redistributions in binary form must reproduce the above"
                  " copyright notice, this list of conditions and the following disclaimer in the documentation and/or other"
                  " materials provided with the distribution.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the {License}); you may not use this file except in compliance"
                         " with the License. You may obtain a copy of the License at {0-12} Unless required by applicable law or agreed"
                         f" to in writing, software distributed under the License is distributed on an {{AS IS}} BASIS",
}


def words_of(text: str) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


@dataclass
class _Nodes:
    """A nondeterministic automaton: per node the words that lead on (None is
    any word) and the nodes that are as good as it."""

    steps: list[dict] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    share: list[float] = field(default_factory=list)  # of the mandatory words, so far

    def new(self, share: float) -> int:
        self.steps.append({})
        self.free.append([])
        self.share.append(share)
        return len(self.steps) - 1

    def word(self, at: int, word: str | None, share: float) -> int:
        to = self.new(share)
        self.steps[at].setdefault(word, []).append(to)
        return to

    def closure(self, nodes) -> frozenset[int]:
        seen, todo = set(nodes), list(nodes)
        while todo:
            for n in self.free[todo.pop()]:
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        return frozenset(seen)


def parse(template: str) -> list:
    """Nested regions: a word, ("any", least, most), ("one", wordings) or ("may", regions)."""
    stack: list[list] = [[]]
    for token in re.findall(r"\[|\]|\{[^{}]*\}|[^\[\]{}]+", template):
        if token == "[":
            stack.append([])
        elif token == "]":
            if len(stack) == 1:
                raise ValueError(f"] without [ in {template!r}")
            inner = stack.pop()
            stack[-1].append(("may", inner))
        elif token[0] == "{":
            count = re.fullmatch(r"\{(\d+)-(\d+)\}", token)
            stack[-1].append(("any", int(count[1]), int(count[2])) if count else
                             ("one", [words_of(w) for w in token[1:-1].split("|")]))
        else:
            stack[-1] += words_of(token)
    if len(stack) > 1:
        raise ValueError(f"[ without ] in {template!r}")
    return stack[0]


def _compile(nodes: _Nodes, at: int, regions: list, total: int) -> int:
    """Appends regions behind node ``at``; ``total`` counts the mandatory ones,
    0 inside an optional region."""
    for region in regions:
        share = nodes.share[at]
        after = min(1.0, share + 1 / total) if total else share
        if isinstance(region, str):
            at = nodes.word(at, region, after)
        elif region[0] == "may":
            end = _compile(nodes, at, region[1], 0)
            out = nodes.new(share)
            nodes.free[end].append(out)
            nodes.free[at].append(out)
            at = out
        elif region[0] == "any":
            out = nodes.new(share)
            for k in range(region[2]):
                if k >= region[1]:
                    nodes.free[at].append(out)
                at = nodes.word(at, None, share)
            nodes.free[at].append(out)
            at = out
        else:
            out = nodes.new(after)
            for wording in region[1]:
                end = at
                for w in wording:
                    end = nodes.word(end, w, share)
                nodes.free[end].append(out)
            at = out
    return at


@dataclass
class Automaton:
    labels: list[str]
    words: list[str]  # word i is letter i + 1, all others are letter 0
    step: np.ndarray  # (states, letters), state 0 is dead, 1 the start
    accepts: list[list[int]]  # per state: templates that end there
    share: np.ndarray  # per state

    @classmethod
    def of(cls, templates: Mapping[str, str], words: set[str] = frozenset()) -> Automaton:
        """Compiles templates; ``words`` are further letters."""
        nodes = _Nodes()
        first = nodes.new(0.0)
        ends: dict[int, int] = {}
        for number, (label, template) in enumerate(templates.items()):
            regions = parse(template)
            total = sum(isinstance(r, str) or r[0] == "one" for r in regions)
            start = nodes.new(0.0)
            nodes.free[first].append(start)
            end = _compile(nodes, start, regions, total)
            opening = nodes.closure([start])
            if not total or end in opening or any(None in nodes.steps[n] for n in opening):
                raise ValueError(f"template {label} must begin with a word and have a mandatory one")
            nodes.share[end] = 1.0
            ends[end] = number
        letters = sorted({w for s in nodes.steps for w in s if w is not None} | set(words))
        states = {frozenset(): 0, nodes.closure([first]): 1}
        todo, rows = [*states], []
        while len(rows) < len(todo):
            own = todo[len(rows)]
            anyway = [n for s in own for n in nodes.steps[s].get(None, ())]
            by_word: dict[str, list[int]] = {}
            for s in own:
                for w, to in nodes.steps[s].items():
                    if w is not None:
                        by_word.setdefault(w, []).extend(to)
            row = np.full(len(letters) + 1, -1, np.int32)
            for letter, target in [(0, anyway), *((letters.index(w) + 1, to + anyway) for w, to in by_word.items())]:
                state = nodes.closure(target)
                if state not in states:
                    states[state] = len(states)
                    todo.append(state)
                row[letter] = states[state]
            row[row < 0] = row[0]
            rows.append(row)
        accepts = [sorted(ends[n] for n in s if n in ends) for s in todo]
        share = np.array([max((nodes.share[n] for n in s), default=0.0) for s in todo])
        share[[not a for a in accepts]] = np.minimum(share, 0.999)[[not a for a in accepts]]
        return cls(list(templates), letters, np.array(rows), accepts, share)

    def letters_of(self, dictionary: pa.Array) -> np.ndarray:
        own = pa.array([w.encode() for w in self.words], pa.large_binary())
        return pc.fill_null(pc.index_in(dictionary.cast(pa.large_binary()), own), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1

    def run(self, letter: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matches (begin, end, template), longest first of overlapping ones of
        a template, and each word's share if a template is begun there;
        ``stop`` is the end of the text that a word is in."""
        share = np.zeros(len(letter))
        begin = np.flatnonzero(self.step[1, letter] > 0)
        state, at = self.step[1, letter[begin]], begin
        some = np.array([bool(a) for a in self.accepts])
        found: dict[tuple[int, int], int] = {}
        while len(begin):
            share[begin] = np.maximum(share[begin], self.share[state])
            at = at + 1
            for i in np.flatnonzero(some[state]):
                for t in self.accepts[state[i]]:
                    found[t, int(begin[i])] = int(at[i])
            live = at < stop[begin]
            begin, state, at = begin[live], state[live], at[live]
            state = self.step[state, letter[at]]
            live = state > 0
            begin, state, at = begin[live], state[live], at[live]
        kept, last = [], {}
        for (t, b), e in sorted(found.items()):
            if b >= last.get(t, 0):
                last[t] = e
                kept.append((b, e, t))
        return np.array(sorted(kept), np.int64).reshape(-1, 3).T, share


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
         keep: list[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """(row, n_words, n_base, first_word, last_word, base_labels, labels, score,
    spans) of every whole text; ``row`` is a struct of the columns ``keep``,
    spans are word places [begin, stop) of a template's matches."""
    runs = [(words_of(p), label) for p, label in phrases.items()]
    shared = docs.sparkSession.sparkContext.broadcast(Automaton.of(templates, {w for p, _ in runs for w in p}))
    src = rows_with_text(docs, keep, text_col)
    schema = (f"row {src.schema['row'].dataType.simpleString()}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, "
              "base_labels array<string>, labels array<string>, score double, spans array<struct<begin:bigint,stop:bigint,label:string>>")

    def run(batches):
        machine = shared.value
        number = {w: i + 1 for i, w in enumerate(machine.words)}
        table = alnum_words()
        for batch in batches:
            for part in slices(batch, text_col):
                n = len(part)
                w = cut_words(*text_bytes(texts_of(part, text_col)), table, lower=True)
                letter = machine.letters_of(w.dictionary)[w.codes] if len(w.codes) else np.zeros(0, np.int64)
                owner = w.owner()
                stop = w.first[1:][owner]
                base, labels = [set() for _ in range(n)], [set() for _ in range(n)]
                count, low, high = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
                for words, label in runs:
                    size = len(words)
                    here = np.arange(max(0, len(letter) - size + 1))
                    fits = stop[here] >= here + size
                    for k, word in enumerate(words):
                        fits &= letter[k:k + len(here)] == number[word]
                    here = here[fits]
                    count += np.bincount(owner[here], minlength=n)
                    place = here - w.first[:-1][owner[here]]
                    np.minimum.at(low, owner[here], place)
                    np.maximum.at(high, owner[here], place)
                    for d in np.unique(owner[here]):
                        base[d].add(label)
                (begin, end, which), share = machine.run(letter, stop)
                score = np.zeros(n)
                np.maximum.at(score, owner, share)
                score[count > 0] = np.maximum(score[count > 0], 0.5)
                spans = [[] for _ in range(n)]
                for b, e, t in zip(begin.tolist(), end.tolist(), which.tolist(), strict=True):
                    d, head = owner[b], int(w.first[owner[b]])
                    labels[d].add(machine.labels[t])
                    spans[d].append({"begin": b - head, "stop": e - head, "label": machine.labels[t]})
                none = pa.array(count == 0)
                null = pa.scalar(None, pa.int64())
                lists = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(w.counts), pa.array(count), pc.if_else(none, null, pa.array(low)),
                     pc.if_else(none, null, pa.array(high)), pa.array([sorted(x) for x in base], lists),
                     pa.array([sorted(x | y) for x, y in zip(base, labels, strict=True)], lists), pa.array(score),
                     pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("stop", pa.int64()), ("label", pa.string())])))],
                    names=["row", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return src.mapInArrow(lean(run), schema)
