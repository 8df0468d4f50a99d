"""License scans: an exact set-similarity join of text blocks with license templates.

A template is the set of its words, ordered by their frequency in all documents, rarest first.
Texts are cut into overlapping blocks of 2*S words at every S words, S at least the template's
length, so that every span of a template's length lies in a block. A block meets a template if
it holds at least the share `threshold` of the template's words. Candidates share a word of both
prefixes (prefix filter), hold enough words (length filter) and can still reach the overlap after
the words before the shared one (positional filter); then the overlap is counted.

A phrase is a template that needs all its words; a block that meets it is searched for the places
where they stand consecutively, each found in the block whose first half it starts in.

Words are runs of ASCII letters and digits and of characters from U+0080 on, A-Z in lower case.
Nulls and odd inputs: a null or empty text has no words and no matches. A null doc_id is passed
through, repeated rows are each scanned, other columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_view, map_batches, sliced, texts_of

#: Share of a template's words that a block must hold.
THRESHOLD = 0.8

#: Words of all templates together, at most: the templates go to every task.
MOST_WORDS = 1_000_000

#: Phrases looked for as they are.
PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}

#: Notices of common licenses, by label.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("no-copies", "No part of this publication may be reproduced, stored or transmitted without the prior written permission of the publisher"),
)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(data: bytes) -> list[bytes]:
    return data.translate(_WORD).split()


@dataclass
class Template:
    label: str
    words: list[bytes]
    phrase: bool
    need: int = 0
    stride: int = 0
    ranks: tuple[int, ...] = ()

    def prepare(self, rank: dict[bytes, int], threshold: float) -> None:
        self.ranks = tuple(sorted({rank[w] for w in self.words}))
        size = len(self.ranks)
        self.need = size if self.phrase else max(1, -(-round(threshold * size * 1e6) // 10**6))
        self.stride = 8
        while self.stride < len(self.words):
            self.stride *= 2


class Join:
    """The templates' inverted prefix index, by block length."""

    def __init__(self, templates: list[Template], counts: dict[bytes, int], threshold: float):
        vocabulary = {w for t in templates for w in t.words}
        order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(order)}
        self.index: dict[int, dict[bytes, list[tuple[Template, int]]]] = {}
        for t in templates:
            t.prepare(self.rank, threshold)
            for position, r in enumerate(t.ranks[: len(t.ranks) - t.need + 1]):
                self.index.setdefault(t.stride, {}).setdefault(order[r], []).append((t, position))
        self.starters = frozenset(w for own in self.index.values() for w in own)

    def matches(self, words: list[bytes]) -> list[tuple[str, bool, int, int, float]]:
        """(label, phrase, first word, last word, share of the template) of all that meet, each once."""
        if self.starters.isdisjoint(words):
            return []
        starters = self.starters
        hits = [k for k, w in enumerate(words) if w in starters]
        found: dict[tuple[str, bool, int, int], float] = {}
        for stride, index in self.index.items():
            blocks: dict[int, set[bytes]] = {}
            for k in hits:
                if words[k] in index:
                    for b in (k // stride, k // stride - 1):
                        if b >= 0:
                            blocks.setdefault(b, set()).add(words[k])
            for b, shared in blocks.items():
                at = b * stride
                block = words[at : at + 2 * stride]
                own = sorted({r for w in block if (r := self.rank.get(w)) is not None})
                place = {r: q for q, r in enumerate(own)}
                tried = set()
                for w in shared:
                    q = place[self.rank[w]]
                    for t, p in index[w]:
                        if id(t) in tried or len(own) < t.need or q > len(own) - t.need:
                            continue  # too few words, or not in the block's prefix
                        if 1 + min(len(t.ranks) - p - 1, len(own) - q - 1) + min(p, q) < t.need:
                            continue
                        tried.add(id(t))
                        overlap = sum(r in place for r in t.ranks)
                        if overlap < t.need:
                            continue
                        if t.phrase:
                            n = len(t.words)
                            for k in range(min(stride, len(block) - n + 1)):
                                if block[k : k + n] == t.words:
                                    found[t.label, True, at + k, at + k + n - 1] = 1.0
                        else:
                            inside = [k for k, x in enumerate(block) if self.rank.get(x) in t.ranks]
                            key = (t.label, False, at + inside[0], at + inside[-1])
                            found[key] = max(found.get(key, 0.0), overlap / len(t.ranks))
        return sorted((*k, v) for k, v in found.items())


def license_matches(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words and the matches (label, phrase, first, last, share) of every row of docs."""
    every = [Template(k, words_of(v.encode()), False) for k, v in templates] + [Template(k, words_of(v.encode()), True) for k, v in phrases.items()]
    every = [t for t in every if t.words]
    vocabulary = frozenset(w for t in every for w in t.words)
    if sum(len(t.words) for t in every) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words")
    view = doc_view(docs, "doc_id", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for piece in sliced(batch):
                for text in texts_of(piece["text"]):
                    total.update(w for w in words_of(text) if w in vocabulary)
        yield pa.record_batch({"word": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = view.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # of the templates' words
    join = Join(every, {bytes(r["word"]): r["n"] for r in rows}, threshold)
    kind = pa.list_(pa.struct([("label", pa.string()), ("phrase", pa.bool_()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [words_of(t) for t in texts_of(batch["text"])]
        found = [[dict(zip(("label", "phrase", "first", "last", "share"), m, strict=True)) for m in join.matches(w)] for w in words]
        return pa.record_batch({"doc_id": batch["doc_id"], "n_words": pa.array([len(w) for w in words], pa.int64()), "matches": pa.array(found, kind)})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(view, run, f"doc_id {id_type}, n_words long, matches array<struct<label:string,phrase:boolean,first:long,last:long,share:double>>")


def oracle_sql(templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the digest of a whole table: every block is compared with every template."""
    rows, places = [], []
    for k, (label, text) in enumerate(templates):
        t = Template(label, words_of(text.encode()), False)
        t.prepare({w: n for n, w in enumerate(sorted(set(t.words)))}, threshold)
        rows += [f"({k}, '{label}', '{w.decode()}', {t.stride}, {t.need}, {len(t.ranks)})" for w in sorted(set(t.words))]
    for label, text in phrases.items():
        words = text.split()
        follow = " AND ".join(f"lead(w, {n}) OVER o = '{w}'" if n else f"w = '{w}'" for n, w in enumerate(words))
        places.append(f"SELECT doc_id, pos, '{label}' AS label FROM (SELECT doc_id, pos, {follow} AS here FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY pos)) WHERE here")
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""WITH split AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM split),
notices(t, label, w, stride, need, size) AS (VALUES {', '.join(rows)}),
hits AS (SELECT doc_id, t, label, w, need, size, pos // stride - b AS block FROM words JOIN notices USING (w), (VALUES (0), (1)) bs(b) WHERE pos // stride - b >= 0),
met AS (SELECT doc_id, label, count(DISTINCT w) / CAST(any_value(size) AS DOUBLE) AS share FROM hits GROUP BY doc_id, t, label, block HAVING count(DISTINCT w) >= any_value(need)),
places AS ({' UNION ALL '.join(places)}),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY 1),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, share FROM met UNION ALL SELECT doc_id, label, CAST(1 AS DOUBLE) FROM places) GROUP BY 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""
