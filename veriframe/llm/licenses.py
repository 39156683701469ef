"""License scans by template markup.

A template is the wording of a license or notice in which regions may be optional or replaceable. It is compiled into a
deterministic automaton over words; a place in a text is accepted if the mandatory wording stands there exactly, with
nothing between but what the template allows. Case, punctuation and layout do not count, as words are compared.

Markup: ``[[...]]`` may be left out (nesting allowed), ``<<n>>`` stands for up to n words of any kind.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import slices
from .shipping import Shared, by_value

#: Phrases whose places are counted, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

#: Wording of common licenses and notices.
TEMPLATES = [
    ("mit", """permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "software"), to deal in the software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit
        persons to whom the software is furnished to do so, subject to the following conditions: the above copyright notice
        and this permission notice [[(including the next paragraph)]] shall be included in all copies or substantial
        portions of the software"""),
    ("mit", "[[this <<4>> is]] [[released|]] licensed under the [[terms of the]] mit license"),
    ("apache-2", "licensed under the apache license[[,]] version 2[[.0]] [[(the license)]]"),
    ("apache-2", "spdx license identifier: apache 2.0"),
    ("bsd-3-clause", """redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1]] redistributions of source code must retain the [[above]] copyright notice,
        this list of conditions and the following disclaimer. [[2]] redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. [[3]] neither the name of <<8>> nor the names of <<4>> contributors may be used to
        endorse or promote products derived from this software without specific prior written permission"""),
    ("bsd-2-clause", """redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: [[1]] redistributions of source code must retain the [[above]] copyright notice,
        this list of conditions and the following disclaimer. [[2]] redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
        provided with the distribution. this software is provided"""),
    ("isc", """permission to use, copy, modify, and[[/or]] distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("gpl", """this [[program|]] <<3>> is free software[[:]] you can redistribute it and/or modify it under the terms of the gnu
        [[lesser]] general public license as published by the free software foundation"""),
    ("gpl", "[[this work is]] licensed under the gnu [[lesser]] general public license[[, version <<1>>]]"),
    ("cc-by-nc", "[[this work is]] licensed under a creative commons attribution noncommercial <<3>> license"),
    ("cc-by-nc", "[[licensed under]] [[the]] cc by nc <<1>> [[4.0]] license"),
    ("proprietary", "[[copyright <<8>>]] all rights reserved"),
]

SLICE_CHARS = 4_000_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class Words(NamedTuple):
    """``n`` of 0: exactly this word; else up to n words of any kind."""
    word: str
    n: int = 0


def parse(template: str) -> list:
    """A template as a list of ``Words`` and, for optional regions, nested lists."""
    stack: list[list] = [[]]
    for mark in re.findall(rf"\[\[|\]\]|<<\d+>>|{WORD}", template):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            region = stack.pop()
            if region:
                stack[-1].append(region)
        elif mark.startswith("<<"):
            stack[-1].append(Words("", int(mark[2:-2])))
        else:
            stack[-1].append(Words(mark))
    if len(stack) != 1:
        raise ValueError(f"unclosed region in {template!r}")
    return stack[0]


def as_pattern(parsed: list) -> str:
    """The same template as a regular expression over words that are each followed by one space."""
    out = ""
    for item in parsed:
        if isinstance(item, Words):
            out += f"(?:[^ ]+ ){{0,{item.n}}}" if item.n else re.escape(item.word) + " "
        else:
            out += f"(?:{as_pattern(item)})?"
    return out


class Automaton:
    """Deterministic automaton of one template. Column 0 of ``table`` is for words that no template names."""

    def __init__(self, parsed: list, code: dict[str, int]):
        edges: list[list[tuple[int | None, int]]] = [[]]  # (word code or None for any, to)
        free: list[set[int]] = [set()]

        def state() -> int:
            edges.append([])
            free.append(set())
            return len(edges) - 1

        def build(items: list, at: int) -> int:
            for item in items:
                if isinstance(item, Words) and not item.n:
                    to = state()
                    edges[at].append((code[item.word], to))
                    at = to
                elif isinstance(item, Words):
                    steps = [at]
                    for _ in range(item.n):
                        to = state()
                        edges[steps[-1]].append((None, to))
                        steps.append(to)
                    out = state()
                    for s in steps:
                        free[s].add(out)
                    at = out
                else:
                    end, out = build(item, at), state()
                    free[at].add(out)
                    free[end].add(out)
                    at = out
            return at

        last = build(parsed, 0)

        def closed(states) -> frozenset[int]:
            seen, todo = set(states), list(states)
            while todo:
                for s in free[todo.pop()] - seen:
                    seen.add(s)
                    todo.append(s)
            return frozenset(seen)

        sets = {closed([0]): 1}  # state 0 is the dead one
        todo, rows = list(sets), [np.zeros(len(code) + 1, np.int32)]
        accepting = [False, last in todo[0]]
        while todo:
            now, row = todo.pop(0), np.zeros(len(code) + 1, np.int32)
            anything = {to for s in now for word, to in edges[s] if word is None}
            named = {word for s in now for word, to in edges[s] if word is not None}
            for symbol in range(len(code) + 1):
                if symbol in named or anything:
                    reach = closed(anything | {to for s in now for word, to in edges[s] if word == symbol})
                    if reach not in sets:
                        sets[reach] = len(sets) + 1
                        todo.append(reach)
                        accepting.append(last in reach)
                    row[symbol] = sets[reach]
            rows.append(row)
        self.table, self.accepting = np.stack(rows), np.array(accepting)

    def starts(self, codes: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Places in ``codes`` at which an accepted wording begins; a wording does not cross to another owner."""
        state = self.table[1][codes]
        place = np.flatnonzero(state)
        state, found, ahead = state[place], [], 0
        while len(place):
            done = self.accepting[state]
            found.append(place[done])
            place, state = place[~done], state[~done]
            ahead += 1
            inside = place + ahead < len(codes)
            place, state = place[inside], state[inside]
            same = owner[place] == owner[place + ahead]
            place, state = place[same], state[same]
            state = self.table[state, codes[place + ahead]]
            place, state = place[state > 0], state[state > 0]
        return np.sort(np.concatenate(found)) if found else place


def compile_rules(base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> dict:
    parsed = [(label, parse(t)) for label, t in templates]
    phrases = [(label, parse(p)) for p, label in base]
    words: dict[str, int] = {}

    def name(items):
        for item in items:
            if isinstance(item, list):
                name(item)
            elif not item.n:
                words.setdefault(item.word, len(words) + 1)

    for _, p in [*phrases, *parsed]:
        name(p)
    return {"words": list(words), "base": [(label, Automaton(p, words)) for label, p in phrases],
            "templates": [(label, Automaton(p, words)) for label, p in parsed]}


def word_codes(texts: list[str], words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: code in ``words`` (0: not there), owner text, and the number of words of each text."""
    import pyarrow as pa
    import pyarrow.compute as pc

    data = "\n".join(texts).encode()
    values = np.frombuffer(data, np.uint8)
    kind = np.arange(256)
    inside = (kind >= 0x80) | (kind >= 0x30) & (kind <= 0x39) | (kind >= 0x61) & (kind <= 0x7A) | (kind >= 0x41) & (kind <= 0x5A)
    lower = np.where((kind >= 0x41) & (kind <= 0x5A), kind + 32, kind).astype(np.uint8)[values]
    part = inside[values]
    edge = np.flatnonzero(np.diff(part, prepend=False, append=False)).astype(np.int32)  # start, end, start, end, ...
    if len(edge):
        spans = pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge), pa.py_buffer(lower)])
        found = pc.fill_null(pc.index_in(spans, value_set=words), -1).to_numpy()[::2] + 1
    else:
        found = np.zeros(0, np.int32)
    begins = np.concatenate([np.zeros(1, np.int64), np.cumsum([len(t) if t.isascii() else len(t.encode()) for t in texts], dtype=np.int64)])
    begins[1:] += np.arange(1, len(texts) + 1)
    bounds = np.searchsorted(edge[::2], begins)
    n = np.diff(bounds)
    return found, np.repeat(np.arange(len(texts)), n), n


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """License evidence of every whole text.

    ``key, n_words, n_base`` (places of base phrases), ``first_word, last_word`` (the smallest and largest word number at
    which one begins, from 0; else null), ``base_labels, labels`` (distinct, sorted, comma-joined; ``labels`` adds those of
    the accepted templates), ``template_labels`` (the accepted templates alone), ``score`` (1 if a template is accepted,
    0.5 for base phrases alone, else 0).

    A null text counts as empty: no words, no labels, score 0. Repeated rows give repeated rows, a null key stays null, an
    empty table gives an empty result; other columns play no part, whatever their names.
    """
    import pyarrow as pa

    shared = Shared(docs.sparkSession, {"base": list(base), "templates": list(templates)})

    def build(value):
        rules = compile_rules(value["base"], value["templates"])
        return rules, pa.array([w.encode() for w in rules["words"]], pa.binary())

    def judge(texts, rules, words):
        codes, owner, n = word_codes(texts, words)
        first_of = np.cumsum(n) - n
        counts = np.zeros(len(texts), np.int64)
        first, last = np.full(len(texts), -1, np.int64), np.full(len(texts), -1, np.int64)
        by_base: list[set[str]] = [set() for _ in texts]
        by_template: list[set[str]] = [set() for _ in texts]
        for label, automaton in rules["base"]:
            at = automaton.starts(codes, owner)
            np.add.at(counts, owner[at], 1)
            for o, w in zip(owner[at].tolist(), (at - first_of[owner[at]]).tolist(), strict=True):
                by_base[o].add(label)
                first[o] = w if first[o] < 0 else min(first[o], w)
                last[o] = max(last[o], w)
        for label, automaton in rules["templates"]:
            for o in np.unique(owner[automaton.starts(codes, owner)]).tolist():
                by_template[o].add(label)
        for i in range(len(texts)):
            yield (int(n[i]), int(counts[i]), int(first[i]) if counts[i] else None, int(last[i]) if counts[i] else None,
                   ",".join(sorted(by_base[i])), ",".join(sorted(by_base[i] | by_template[i])), ",".join(sorted(by_template[i])),
                   1.0 if by_template[i] else 0.5 if by_base[i] else 0.0)

    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    columns = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
               ("base_labels", T.StringType()), ("labels", T.StringType()), ("template_labels", T.StringType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField("k", rows.schema["k"].dataType), *(T.StructField(c, t) for c, t in columns)])

    def run(batches):
        rules, words = shared.derived(build)
        types = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out = [row for a, b in slices(texts, SLICE_CHARS) for row in judge(texts[a:b], rules, words)]
            cells = zip(*out, strict=True) if out else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), t) for c, t in zip(cells, types, strict=True))],
                                             names=["k", *(c for c, _ in columns)])

    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def scan_sql(base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> str:
    """The result of ``scan`` over ``documents`` in SQL: phrases by word position, templates as regular expressions."""
    places = []
    for phrase, label in base:
        words = phrase.split()
        test = " AND ".join(f"w[i + {j + 1}] = '{x}'" for j, x in enumerate(words))
        places.append(f"list_transform(list_filter(range(greatest(len(w) - {len(words) - 1}, 0)), lambda i: {test}), lambda i: {{'l': '{label}', 'p': i}})")
    labels = [f"CASE WHEN regexp_matches(j, ' {as_pattern(parse(t))}') THEN '{label}' END" for label, t in templates]
    return rf"""
        WITH a AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
        b AS (SELECT doc_id, len(w) AS n_words, {" || ".join(places)} AS p, ' ' || array_to_string(w, ' ') || ' ' AS j FROM a),
        c AS (SELECT doc_id, n_words, p, list_filter([{", ".join(labels)}], lambda x: x IS NOT NULL) AS t FROM b)
        SELECT doc_id, n_words::BIGINT AS n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x.p))::BIGINT AS first_word,
            list_max(list_transform(p, lambda x: x.p))::BIGINT AS last_word,
            coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ','), '') AS base_labels,
            coalesce(array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l) || t)), ','), '') AS labels,
            coalesce(array_to_string(list_sort(list_distinct(t)), ','), '') AS template_labels,
            CASE WHEN len(t) > 0 THEN 1.0 WHEN len(p) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
        FROM c"""


by_value(__name__)
