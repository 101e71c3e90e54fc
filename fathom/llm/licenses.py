"""License scans with a positional rare-token index.

Templates are licence phrases and short passages of licence texts. The index holds, for every template,
the positions of its words with the highest inverse document frequency (IDF) in the corpus scanned. A
file looks up the licence words it contains; each place of a template's rarest word proposes an
alignment, the postings of the template's other rare words are intersected by relative position, and
the mandatory key phrases of the template are verified word by word where the alignment puts them.

How it scales. Two passes over the texts and no shuffle but the document frequencies of the licence
vocabulary, whose size the templates fix. The index is as large as the templates.

Defined cases. A null text counts as empty: no words, no labels, null places, score 0. Every place of
a phrase is found, overlapping ones too. Equal rows give equal results. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of words stay (A-Z in lower case), all others become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, ASCII letters and all characters beyond ASCII, with A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    """``keys``: (place in the template, phrase) of the phrases that must stand word for word; none: the whole text."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False


#: Base phrases and their labels.
BASE = (Template("mit", "mit license", base=True), Template("apache", "apache license", base=True), Template("gpl", "general public license", base=True))
#: Passages of well-known licence texts; the keys must be present in full.
MORE = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "associated documentation files")),
    Template("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ("except in compliance with the license", "obtain a copy of the license")),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ("redistribute it and or modify it under the terms",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    Template("bsd", "bsd license"),
    Template("mpl", "mozilla public license"),
    Template("lgpl", "lesser general public license"),
    Template("agpl", "affero general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc", "licensed under a creative commons attribution", ("creative commons attribution",)),
)
TEMPLATES = BASE + MORE


def _places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    n = len(phrase)
    return [i for i in range(len(words) - n + 1) if words[i : i + n] == phrase]


@dataclass
class Index:
    """postings: rare word to (template, place in it); anchors: each template's rarest word with its places."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float]
    rare: int = 4
    postings: dict[bytes, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    words: list[list[bytes]] = field(default_factory=list)
    keys: list[list[tuple[int, list[bytes]]]] = field(default_factory=list)
    anchors: list[tuple[bytes, list[int]]] = field(default_factory=list)
    weights: list[list[float]] = field(default_factory=list)

    def __post_init__(self) -> None:
        for k, t in enumerate(self.templates):
            w = words_of(t.text)
            ranked = sorted(set(w), key=lambda x: (-self.idf.get(x, 0.0), x))[: self.rare]
            for x in ranked:
                self.postings[x] += [(k, i) for i, y in enumerate(w) if y == x]
            self.words.append(w)
            self.weights.append([self.idf.get(x, 0.0) + 1e-9 for x in w])
            self.anchors.append((ranked[0], [i for i, y in enumerate(w) if y == ranked[0]]))
            self.keys.append([(i, words_of(p)) for p in t.keys for i in _places(w, words_of(p))[:1]] or [(0, w)])
        self.lookup = frozenset(self.postings)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float]:
        """Starts of the base phrases, base labels, all labels, and the best share of a template's IDF that stands in place."""
        present = self.lookup.intersection(words)
        if not present:
            return [], set(), set(), 0.0
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                at[w].append(i)
        starts, base, labels, best = [], set(), set(), 0.0
        sets = {w: set(p) for w, p in at.items()}
        for k, t in enumerate(self.templates):
            anchor, own = self.anchors[k]
            if anchor not in present:
                continue
            need = [(w, i) for w in present for x, i in self.postings[w] if x == k]
            for s in sorted({p - i for p in at[anchor] for i in own}):
                if t.base and not all(s + i in sets[w] for w, i in need):
                    continue  # a rare word of the phrase stands elsewhere
                if all(s + i >= 0 and words[s + i : s + i + len(p)] == p for i, p in self.keys[k]):
                    labels.add(t.label)
                    if t.base:
                        starts.append(s)
                        base.add(t.label)
                    best = 1.0
                elif best < 1.0:
                    weights = self.weights[k]
                    best = max(best, sum(v for i, (v, w) in enumerate(zip(weights, self.words[k], strict=True)) if 0 <= s + i < len(words) and words[s + i] == w) / sum(weights) * 0.99)
        return starts, base, labels, best


def _vocabulary(templates: tuple[Template, ...]) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words_of(t.text))


def licence_idf(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[bytes, float]:
    """IDF of the templates' words over all documents; as many rows as the vocabulary reach the driver."""
    vocabulary = _vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = defaultdict(int)
        for b in batches:
            for t in b.column(0):
                n[b""] += 1
                for w in vocabulary.intersection(words_of(t.as_py())):
                    n[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["word", "n"])

    got = {bytes(r.word): r.n for r in docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = got.get(b"", 0)
    return {w: math.log((total + 1) / (got.get(w, 0) + 1)) for w in vocabulary}


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, rare: int = 4) -> DataFrame:
    """One row per document: words, base places, labels and score. ``rare``: words indexed per template; the base phrases are shorter and indexed whole."""
    idf = licence_idf(docs, templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf, rare)
        for b in batches:
            rows = []
            for t in b.column("text"):
                words = words_of(t.as_py())
                starts, base, labels, score = index.scan(words)
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op1_licenses(spark, sf_dir):
    from .common import table

    return license_scan(table(spark, sf_dir, "documents"))
