"""License scans through a positional rare-token index.

Licence templates are indexed by their rarest words, judged by document
frequency over the whole table.  A file's words of the index vote for
templates and for the place where they would start; votes that agree on the
relative position make a candidate, which stands if the template's mandatory
phrases are really there.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER_TO_LOWER = {i: i + 32 for i in range(65, 91)}

#: Fixed phrases whose every place counts, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Fixed notices: label, wording, and the phrases that must be there.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("terms of the gnu general public license", "free software foundation")),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("cc by nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc by nc", "creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc by sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright under cc0 1 0 universal", ("cc0 1 0",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    base: bool = False


def templates() -> list[Template]:
    base = [Template(label, tuple(p.split()), (tuple(p.split()),), True) for p, label in BASE_PHRASES.items()]
    return base + [Template(label, tuple(w.split()), tuple(tuple(p.split()) for p in ps)) for label, w, ps in NOTICES]


@dataclass
class Index:
    """Postings of each template's rarest words: word -> (template, position)."""

    templates: list[Template]
    idf: dict[str, float]
    rare: int = 4
    slack: int = 3
    postings: dict[str, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    needed: list[int] = field(default_factory=list)

    def __post_init__(self):
        for t, x in enumerate(self.templates):
            # of a phrase that counts wherever it stands, the rarest word finds every place
            chosen = sorted(set(x.words), key=lambda w: (-self.idf.get(w, 0.0), w))[: 1 if x.base else self.rare]
            for p, w in enumerate(x.words):
                if w in chosen:
                    self.postings[w].append((t, p))
            self.needed.append(1 if x.base else min(2, len(chosen)))

    def scan(self, words: list[str]) -> list[tuple[str, bool, int, int, float]]:
        """Places by (start, end, label): label, base, first word, end, share of the template's words that are in place."""
        votes: dict[int, dict[int, set[str]]] = defaultdict(lambda: defaultdict(set))
        postings = self.postings
        for i, w in [(i, w) for i, w in enumerate(words) if w in postings]:
            for t, p in postings[w]:
                votes[t][i - p].add(w)
        found = set()
        for t, by_start in votes.items():
            x = self.templates[t]
            n = len(x.words)
            if x.base:
                found |= {(x.label, True, s, s + n, 1.0) for s in by_start if s >= 0 and tuple(words[s : s + n]) == x.words}
                continue
            last = None
            for s in sorted(by_start):
                if last is not None and s - last <= self.slack:
                    continue
                near = set().union(*(by_start[o] for o in range(s, s + self.slack + 1) if o in by_start))
                if len(near) < self.needed[t]:
                    continue
                a, b = max(0, s - self.slack), max(0, s) + n + 2 * self.slack
                here = words[a:b]
                if all(_find(here, p) for p in x.phrases):
                    last = s
                    inside = Counter(here) & Counter(x.words)
                    found.add((x.label, False, max(0, s), min(len(words), s + n), round(sum(inside.values()) / n, 6)))
        return sorted(found, key=lambda f: (f[2], f[3], f[0], f[1]))


def _find(words: list[str], phrase: tuple[str, ...]) -> bool:
    n = len(phrase)
    return any(tuple(words[i : i + n]) == phrase for i, w in enumerate(words) if w == phrase[0])


def split_words(text: str | None) -> list[str]:
    """Words of the text with A-Z lower-cased; none of a null text."""
    if not text:
        return []
    return WORDS.findall(text.lower() if text.isascii() else text.translate(UPPER_TO_LOWER))


def document_frequencies(df: DataFrame, vocabulary: set[str], text: str = "text") -> DataFrame:
    """word, df over all rows; a row a word of the vocabulary that occurs, and the number of rows under the word ''."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                n[""] += 1
                n.update(vocabulary.intersection(split_words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

    return df.select(F.col(f"`{text}`")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))


def build_index(df: DataFrame, text: str = "text", known: list[Template] | None = None) -> Index:
    """Index over the templates with IDF from every row of df.  The driver gathers a count a template word."""
    known = templates() if known is None else known
    vocabulary = {w for t in known for w in t.words}
    counts = {r[0]: r[1] for r in document_frequencies(df, vocabulary, text).collect()}
    n = counts.pop("", 0)
    return Index(known, {w: math.log((n + 1) / (counts.get(w, 0) + 1)) for w in vocabulary})


PLACE = pa.struct([("label", pa.string()), ("base", pa.bool_()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
RESULT = pa.struct([("n_words", pa.int64()), ("places", pa.list_(PLACE))])


def scan_licenses(df: DataFrame, text: str = "text", index: Index | None = None) -> DataFrame:
    """Rows of df as column record (struct of all columns) with n_words and places.

    places lists label, base (a base phrase stood there word by word), start
    and end in words, and share, the part of the template's words found in
    place.  A null or empty text has no words and no places.  Repeated rows
    are scanned one by one.
    """
    known = index or build_index(df, text)
    idx = Index(known.templates, known.idf, known.rare, known.slack)

    @arrow_udf("struct<n_words:long,places:array<struct<label:string,base:boolean,start:long,end:long,share:double>>>")
    def scan(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = PLACE.names if hasattr(PLACE, "names") else [f.name for f in PLACE]
        for column in columns:
            out = []
            for t in column:
                words = split_words(t.as_py())
                out.append({"n_words": len(words), "places": [dict(zip(names, p, strict=True)) for p in idx.scan(words)] if words else []})
            yield pa.array(out, RESULT)

    scanned = df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("record"), scan(df[text]).alias("scan"))
    return scanned.select("record", "scan.n_words", "scan.places")
