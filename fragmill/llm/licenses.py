"""License scans by template matching.

A template is wording with markup: <<optional>>...<<end>> may be missing, <<var N>> stands for any 0 to N
words. It is compiled to an automaton over words. A text matches where, from some word on, the automaton
reaches its end: all mandatory wording is there exactly, in order, and nothing else between but what markup allows.
Words are compared in lower case, so line breaks, punctuation and layout don't matter.

Three phrases are always counted besides (the base). Cases: a null text is empty: no words, no
places, no labels, score 0. Repeated rows are scored each. A null doc_id is kept. An empty table gives no
rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Phrases of the base and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Templates by label: public license texts and notices, as fixed values.
_WARRANTY = """this software is provided <<optional>>by <<var 12>><<end>> as is and any express or implied warranties
 including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed
 in no event shall <<var 12>> be liable for any direct indirect incidental special exemplary or consequential damages"""
TEMPLATES = [
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and
 associated documentation files the software to deal in the software without restriction including without limitation the
 rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
 whom the software is furnished to do so subject to the following conditions the above copyright notice and this
 permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of
 the software"""),
    ("mit", "<<optional>>released <<end>>under the <<optional>>terms of the <<end>>mit license"),
    ("isc", """permission to use copy modify and <<optional>>or <<end>>distribute this software for any purpose with or without fee is
 hereby granted provided that the above copyright notice and this permission notice appear in all copies"""),
    ("bsd-2-clause", f"""redistribution and use in source and binary forms with or without modification are permitted provided that
 the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list
 of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright
 notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
 the distribution {_WARRANTY}"""),
    ("bsd-3-clause", f"""redistribution and use in source and binary forms with or without modification are permitted provided that
 the following conditions are met <<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list
 of conditions and the following disclaimer <<optional>>2<<end>> redistributions in binary form must reproduce the above copyright
 notice this list of conditions and the following disclaimer in the documentation and or other materials provided with
 the distribution <<optional>>3<<end>> neither the name of <<var 12>> nor the names of <<optional>>its <<end>><<var 3>>contributors may be used to endorse or
 promote products derived from this software without specific prior written permission {_WARRANTY}"""),
    ("apache-2", """licensed under the apache license version 2 0 <<optional>>the license<<end>> <<optional>>you may not use this file except in
 compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0<<end>>"""),
    ("gpl", """<<optional>><<var 6>>licensed <<end>>under the <<optional>>terms of the <<end>>gnu general public license <<optional>>as published by the free software foundation
 <<end>><<optional>>either <<end>>version <<var 1>>"""),
    ("lgpl", "under the <<optional>>terms of the <<end>>gnu lesser general public license <<optional>>as published by the free software foundation <<end>><<optional>>either <<end>>version <<var 1>>"),
    ("agpl", "under the <<optional>>terms of the <<end>>gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "<<optional>>licensed under <<end>><<optional>>a <<end>>creative commons attribution noncommercial <<optional>>4 0 <<end>><<optional>>international <<end>>license"),
    ("cc-by-nc", "cc by nc <<optional>>sa <<end>><<optional>>nd <<end>><<optional>>4 0<<end>>"),
    ("cc-by", "licensed under <<optional>>a <<end>><<optional>>the <<end>>creative commons attribution <<optional>>4 0 <<end>><<optional>>international <<end>>license"),
    ("cc0", "<<optional>>dedicated to the <<end>>public domain under <<optional>>the <<end>>cc0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("proprietary", "all rights reserved <<optional>>no part of <<var 4>><<end>>unauthorized <<optional>>copying <<end>><<optional>>or <<end>><<optional>>distribution <<end>>is <<optional>>strictly <<end>>prohibited"),
]

# Every byte that doesn't belong to a word becomes a space; A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


class Automaton:
    """A template: states with edges by word, by any word, and without a word."""

    def __init__(self, template: str):
        self.word_edges: list[dict[bytes, int]] = [{}]
        self.any_edge: list[int | None] = [None]
        self.free_edges: list[list[int]] = [[]]
        state, opened, self.mandatory, run, runs = 0, [], 0, [], []
        for part in re.findall(r"<<[^>]*>>|[^<]+", template):
            if part.startswith("<<"):
                runs.append(run)
                run = []
            if part == "<<optional>>":
                opened.append(state)
                state = self._free(state)
                opened[-1] = (opened[-1], state)
            elif part == "<<end>>":
                before, _ = opened.pop()
                state = self._free(state)
                self.free_edges[before].append(state)
            elif part.startswith("<<var"):
                ends = [state]
                for _ in range(int(part[5:-2])):
                    nxt = self._state()
                    self.any_edge[ends[-1]] = nxt
                    ends.append(nxt)
                state = self._state()
                for s in ends:
                    self.free_edges[s].append(state)
            else:
                for w in part.encode().translate(_FOLD).split():
                    nxt = self._state()
                    self.word_edges[state][w] = nxt
                    state = nxt
                    if not opened:
                        self.mandatory += 1
                        run.append(w)
        self.end = state
        #: The longest mandatory wording in one piece: a text without it can't match.
        self.anchor = b" " + b" ".join(max([*runs, run], key=len)) + b" "
        self.start = self._close({0})
        self.first = {w for s in self.start for w in self.word_edges[s]}
        self.any_first = any(self.any_edge[s] is not None for s in self.start)

    def _state(self) -> int:
        self.word_edges.append({})
        self.any_edge.append(None)
        self.free_edges.append([])
        return len(self.any_edge) - 1

    def _free(self, state: int) -> int:
        nxt = self._state()
        self.free_edges[state].append(nxt)
        return nxt

    def _close(self, states: set[int]) -> frozenset[int]:
        found, todo = set(states), list(states)
        while todo:
            for s in self.free_edges[todo.pop()]:
                if s not in found:
                    found.add(s)
                    todo.append(s)
        return frozenset(found)

    def accepts(self, w: list[bytes], at: int) -> bool:
        """Whether a match starts at word `at`."""
        states = self.start
        while True:
            if self.end in states:
                return True
            if at >= len(w):
                return False
            nxt = set()
            for s in states:
                if (to := self.word_edges[s].get(w[at])) is not None:
                    nxt.add(to)
                if (to := self.any_edge[s]) is not None:
                    nxt.add(to)
            if not nxt:
                return False
            states = self._close(nxt)
            at += 1

    def matches(self, w: list[bytes], joined: bytes) -> bool:
        return self.anchor in joined and any((self.any_first or x in self.first) and self.accepts(w, k) for k, x in enumerate(w))


@lru_cache(maxsize=4)
def automata(templates: tuple[tuple[str, str], ...]) -> list[tuple[str, Automaton]]:
    return [(label, Automaton(t)) for label, t in templates]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def scan_text(text: bytes | None, phrases: list[tuple[bytes, str]], compiled: list[tuple[str, Automaton]]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    w = words(text)
    joined = b" %b " % b" ".join(w)
    places, base = [], set()
    for phrase, label in phrases:
        at, counted, word = joined.find(phrase), 0, 0
        while at >= 0:
            word += joined.count(b" ", counted, at)
            counted = at
            places.append(word)
            base.add(label)
            at = joined.find(phrase, at + 1)
    labels, longest = set(base), 3 if base else 0
    for label, automaton in compiled:
        if automaton.matches(w, joined):
            labels.add(label)
            longest = max(longest, automaton.mandatory)
    first, last = (min(places), max(places)) if places else (None, None)
    return len(w), len(places), first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - 0.5 ** (longest / 3)


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """One row per document (doc_id, text): the places of the phrases, the labels, a score in 0..1.

    n_base counts every place of every phrase, first_word and last_word are the least and largest word
    at which one starts. labels are the base's and the matched templates'. The score
    grows with the mandatory words of the longest wording found.
    """
    chosen = tuple(templates if templates is not None else TEMPLATES)
    looked_for = [(b" %b " % k.encode().translate(_FOLD).strip(), v) for k, v in (phrases or PHRASES).items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = automata(chosen)
        for batch in batches:
            got = [scan_text(t, looked_for, compiled) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), *(pa.array([x[k] for x in got], t) for k, t in enumerate(_OUT.types[1:]))]
            yield pa.RecordBatch.from_arrays(columns, schema=_OUT)

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op3_license_scan(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))
