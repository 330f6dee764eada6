"""Licence scan: one word automaton finds identifier tags and notice phrases, and a
shunting-yard parser evaluates licence expressions. Each tag of a line counts.

Words are those of ``arrow.words``. Labels come from three places: base phrases, further
notice phrases, and ``SPDX-License-Identifier:`` tags, whose expressions (``and``, ``or``,
``with``, brackets) are parsed. ``score`` says how freely the text may be used: of the
permissions of all notices the least, where ``and`` takes the least of its sides, ``or``
the greatest, and ``with`` (an exception) moves its licence a quarter of the way to 1.
A text without a notice has 0.5. Null and empty texts have no words and no labels.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.arrow import map_texts, words
from tidewell.llm.matching import WordAutomaton
from tidewell.session import ship

#: Fixed by the query's contract.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further names of licences and the label of each; with "licence" for "license" too.
NAMES = {
    "apache license": "apache", "mit license": "mit", "bsd license": "bsd", "mozilla public license": "mpl", "lesser general public license": "lgpl", "library general public license": "lgpl",
    "affero general public license": "agpl", "eclipse public license": "epl", "isc license": "isc", "boost software license": "boost", "zlib license": "zlib", "artistic license": "artistic", "academic free license": "afl",
    "open software license": "osl", "european union public license": "eupl", "common development and distribution license": "cddl", "python software foundation license": "psf", "free documentation license": "gfdl",
    "open database license": "odbl", "open font license": "ofl", "cc by sa": "cc-by-sa", "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc0": "cc0", "public domain": "public-domain", "creative commons": "creative-commons",
    "creative commons zero": "cc0", "creative commons attribution": "cc-by", "creative commons attribution sharealike": "cc-by-sa", "creative commons attribution share alike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc", "creative commons attribution non commercial": "cc-by-nc", "creative commons attribution noderivatives": "cc-by-nd", "creative commons attribution no derivatives": "cc-by-nd",
    "unlicense": "unlicense", "wtfpl": "wtfpl", "proprietary and confidential": "proprietary",
}
#: Fixed: sentences of the licences' own notices.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis": "apache",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "boost",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable": "zlib",
    "everyone is permitted to copy and distribute verbatim copies of this license document": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license": "agpl",
    "you may not use this work except in compliance with the licence": "eupl",
}
#: Short names of one family, alone with GNU before it or with a version; not with a version in two words, as identifier tags have.
SHORT = {f: n for n in ("gpl", "lgpl", "agpl") for f in (f"gnu {n}", f"{n}v2", f"{n}v3", f"{n} v2", f"{n} v3", f"{n} version 2", f"{n} version 3")}
PHRASES = NAMES | {p.replace("license", "licence"): v for p, v in NAMES.items()} | NOTICES | SHORT
#: How freely a text under a label may be used, 0 to 1.
PERMISSION = {
    "cc0": 1.0, "public-domain": 1.0, "unlicense": 1.0, "wtfpl": 1.0, "mit": 0.95, "bsd": 0.95, "isc": 0.95, "boost": 0.95, "zlib": 0.95, "apache": 0.9, "psf": 0.9, "cc-by": 0.85, "artistic": 0.8, "afl": 0.8, "ofl": 0.8,
    "creative-commons": 0.6, "mpl": 0.7, "cddl": 0.65, "epl": 0.65, "lgpl": 0.6, "eupl": 0.55, "osl": 0.5, "gpl": 0.5, "gfdl": 0.5, "odbl": 0.5, "cc-by-sa": 0.6, "agpl": 0.4, "cc-by-nc": 0.3, "cc-by-nd": 0.3,
    "proprietary": 0.0, "reserved": 0.0,
}
UNKNOWN = 0.5
#: The words that a tag is looked for by. What stands before "SPDX" may belong to its word, such as a byte-order mark.
TAG = (b"license", b"identifier")
_TAG = re.compile(rb"spdx-license-identifier:[ \t]*([^\r\n]*)", re.I)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9][A-Za-z0-9.+:-]*")
_RANK = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of an SPDX identifier: the longest label that it begins with, else itself in lower case."""
    name = identifier.lower()
    fits = [x for x in PERMISSION if name == x or name.startswith((f"{x}-", f"{x}+"))]
    return max(fits, key=len) if fits else name


def to_postfix(expression: str) -> list[str]:
    """The longest well-formed expression that the text begins with, operators after their sides."""
    out: list[str] = []
    stack: list[str] = []
    best: list[str] = []
    operand = True
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if operand:
            if token == "(":
                stack.append(token)
            elif token == ")" or low in _RANK:
                break
            else:
                out.append(token)
                operand = False
        elif low in _RANK:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[low]:
                out.append(stack.pop())
            stack.append(low)
            operand = True
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                break
            stack.pop()
        else:
            break
        if not operand and "(" not in stack:
            best = out + stack[::-1]
    return best


def evaluate(expression: str) -> tuple[float | None, list[str]]:
    """(permission, labels) of a licence expression; None if it has no licence."""
    values: list[float] = []
    labels: list[str] = []
    names: list[str | None] = []
    for token in to_postfix(expression):
        if token in _RANK and len(values) > 1:
            b, a = values.pop(), values.pop()
            exception, name = names.pop(), names.pop()
            if token == "with":
                if exception in labels:
                    labels.remove(exception)
                values.append(a + (1 - a) / 4)
            else:
                values.append(min(a, b) if token == "and" else max(a, b))
            names.append(name)
        else:
            label = label_of(token)
            labels.append(label)
            names.append(label)
            values.append(PERMISSION.get(label, UNKNOWN))
    return (values[-1] if values else None), sorted(set(labels))


_machine: list[WordAutomaton] = []


def machine() -> WordAutomaton:
    if not _machine:
        base = [(tuple(words(p.encode())), (True, v)) for p, v in BASE.items()]
        _machine.append(WordAutomaton(base + [(tuple(words(p.encode())), (False, v)) for p, v in PHRASES.items()] + [(TAG, (False, None))]))
    return _machine[0]


def outermost(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans that don't lie in a longer one.

    A notice inside a longer one ("general public license" in "lesser general public license") doesn't decide the score.
    """
    out, reach, last = [], -1, None
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if s[:2] == last or s[1] > reach:
            out.append(s)
            reach, last = s[1], s[:2]
    return out


def tagged(text: bytes, at: list[int]) -> list[str]:
    """What follows each identifier tag in its line; ``at``: the numbers of words that TAG begins at."""
    if not at:
        return []
    places = [m.start() for m in _WORD.finditer(text)]
    found = [_TAG.match(text, max(0, places[i] - len(b"spdx-"))) for i in at]
    return [m[1].decode("utf-8", "replace") for m in found if m]


def judge(text: bytes | None) -> tuple[int, list[int], list[str], list[str], float]:
    """(words, starts of base phrases, base labels, all labels, score) of one text."""
    w = words(text)
    found = machine().find(w)
    starts, base, spans, tags = [], set(), [], []
    for i, n, values in found:
        for is_base, label in values:
            if label is None:
                tags.append(i)
                continue
            spans.append((i, i + n, label))
            if is_base:
                starts.append(i)
                base.add(label)
    labels, score = base | {s[2] for s in spans}, [PERMISSION[s[2]] for s in outermost(spans)]
    for expression in tagged(text, tags):
        value, more = evaluate(expression)
        if value is not None:
            labels.update(more)
            score.append(value)
    return len(w), starts, sorted(base), sorted(labels), float(min(score)) if score else UNKNOWN


def _scan(keys, texts):
    got = [judge(t) for t in texts]
    return [
        keys[0], [g[0] for g in got], [len(g[1]) for g in got], [min(g[1], default=None) for g in got], [max(g[1], default=None) for g in got],
        [",".join(g[2]) for g in got], [",".join(g[3]) for g in got], [g[4] for g in got],
    ]


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    out = map_texts(docs, [key], text, _scan, f"k {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    return out.withColumnRenamed("k", key)


def contract(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.col("n_words"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
