"""License statements and notices in texts, by exact set-similarity join (operator 11).

Base rules find the places where a phrase's words stand one after another. The
join finds every text block that holds at least ``threshold`` of a template's
distinct words (containment). Blocks are windows of 2 L words that start every L
words, with L the power of two that holds the template's words; so every stretch
as long as the template lies within a block, however the lines are broken.

The tokens of the templates are put in one global order, rare ones first, by the
number of documents that hold them (counted over all documents). With a the
least overlap that meets the threshold, a block meets a template only if

* it has at least a tokens of the templates' vocabulary (length filter);
* one of its first |block| - a + 1 tokens is among the template's first
  |template| - a + 1 (prefix filter; tokens are looked up in an inverted index
  of the templates' prefixes, and a block's prefix is that of its window size's
  least a);
* the prefix tokens in common, and the tokens left in either set after the last
  of them, can reach a (positional filter).

What is left is counted on the full sets. The filters lose nothing, so the order
only decides how much is counted. Tasks join their own documents with the index,
whose size is that of the template list; no text is shuffled.

Defined cases: null and empty texts have no words, labels or blocks and score 0;
rows that repeat an id are scanned one by one; null ids are kept; an empty table
gives an empty result; without templates only the base rules label. Extra
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks

THRESHOLD = 0.9

# Base phrases (fixed values of the contract): words in lower case, and the label.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Templates (fixed values: the usual public statements and notices): name, label, text.
TEMPLATES = [
    ("mit-statement", "mit", "Released under the MIT License."),
    ("apache-statement", "apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl-statement", "gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-statement", "cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-notice", "cc-by-nc",
     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-notice", "cc-by-sa",
     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc0-notice", "cc0",
     "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this "
     "work."),
    ("mit-notice", "mit",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
     "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
     "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
     "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
     "Software."),
    ("isc-notice", "isc",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-notice", "bsd",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution."),
    ("apache-notice", "apache",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
     "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
     "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
     "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("gpl-notice", "gpl",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
     "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
     "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("mpl-notice", "mpl",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense-notice", "unlicense",
     "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
     "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
     "purpose, commercial or non-commercial, and by any means."),
]

# Bytes that are no part of a word become blanks; A-Z are lower-cased.
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased (A-Z), in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def least_overlap(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def window_step(n_words: int) -> int:
    """The smallest power of two that is no less than the number of words."""
    return 1 << max(0, n_words - 1).bit_length()


# ------------------------------------------------------------ the index

class Index:
    """Templates as sorted token ranks, with an inverted index of their prefixes
    for each window size."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], counts: dict[bytes, int], threshold: float):
        sets = [set(words_of(text)) for _, _, text in templates]
        order = sorted(set().union(*sets), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(order)}
        self.holds = np.zeros((len(templates), len(order)), bool)
        self.size = np.array([len(s) for s in sets], np.int64)
        self.least = np.array([least_overlap(len(s), threshold) for s in sets], np.int64)
        self.names = [(name, label) for name, label, _ in templates]
        by_step: dict[int, list[tuple[int, int, int]]] = {}
        for t, s in enumerate(sets):
            ranks = sorted(self.rank[w] for w in s)
            self.holds[t, ranks] = True
            for i, r in enumerate(ranks[:len(ranks) - int(self.least[t]) + 1]):
                by_step.setdefault(window_step(len(words_of(templates[t][2]))), []).append((r, t, i))
        #: window step -> (least overlap of its templates, postings by rank: bounds, template, place)
        self.steps = {}
        for step, postings in sorted(by_step.items()):
            r, t, i = np.array(sorted(postings), np.int64).T
            self.steps[step] = (int(self.least[t].min()), np.searchsorted(r, np.arange(len(order) + 1)), t, i)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (n of them) for each pair, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def matching_blocks(doc: np.ndarray, pos: np.ndarray, rank: np.ndarray, n_words: np.ndarray,
                    index: Index) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, template, first word, words, overlap) of all blocks that meet a
    template, from the places of template tokens."""
    n_ranks = max(1, len(index.rank))
    for step, (least, bounds, templates, places) in index.steps.items():
        base = np.cumsum(n_words // step + 1) - (n_words // step + 1)
        window = base[doc] + pos // step
        back = pos >= step
        keys = np.unique(np.concatenate([window * n_ranks + rank, (window[back] - 1) * n_ranks + rank[back]]))
        window, token = keys // n_ranks, keys % n_ranks
        first = np.flatnonzero(np.diff(window, prepend=-1))
        size = np.diff(np.append(first, len(window)))
        own = np.repeat(np.arange(len(first)), size)            # each token's block
        j = np.arange(len(window)) - first[own]                 # and its place there
        hit = np.flatnonzero((size[own] >= least) & (j <= size[own] - least))
        n = bounds[token[hit] + 1] - bounds[token[hit]]
        posting = _ranges(bounds[token[hit]], n)
        entry = np.repeat(hit, n)
        t, i = templates[posting], places[posting]
        fits = size[own[entry]] >= index.least[t]
        entry, t, i = entry[fits], t[fits], i[fits]
        # the shared prefix tokens of each (block, template), in rank order
        pair = own[entry] * len(index.names) + t
        order = np.argsort(pair, kind="stable")
        entry, t, i, pair = entry[order], t[order], i[order], pair[order]
        last = np.flatnonzero(np.diff(pair, append=-1))
        shared = np.diff(last, prepend=-1)
        block, t = own[entry[last]], t[last]
        rest = np.minimum(index.size[t] - i[last] - 1, size[block] - j[entry[last]] - 1)
        fits = shared + rest >= index.least[t]
        block, t = block[fits], t[fits]
        # full sets
        n = size[block]
        at = np.repeat(np.arange(len(block)), n)
        overlap = np.bincount(at[index.holds[t[at], token[_ranges(first[block], n)]]], minlength=len(block))
        for b, x, o in zip(*(v[overlap >= index.least[t]].tolist() for v in (block, t, overlap)), strict=True):
            w = int(window[first[b]])
            d = int(np.searchsorted(base, w, "right")) - 1
            start = (w - int(base[d])) * step
            yield d, x, start, min(2 * step, int(n_words[d]) - start), o


# ------------------------------------------------------------ Spark jobs

def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def token_documents(docs: DataFrame, tokens: set[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the tokens. Tasks count their own part;
    one row per token comes back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = dict.fromkeys(tokens, 0)
        for _, texts in chunks(batches):
            for text in texts:
                for w in tokens.intersection(words_of(text)):
                    seen[w] += 1
        yield pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = _texts(docs).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r["token"]): r["n"] for r in counted.collect()}   # as many rows as the templates have tokens


SCAN = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("phrases", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("blocks", pa.list_(pa.struct([("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()),
                                   ("n_words", pa.int64()), ("overlap", pa.int64()), ("containment", pa.float64())])))])


def scan(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD,
         phrases: Sequence[tuple[str, str]] = PHRASES) -> DataFrame:
    """(doc_id, n_words, phrases, blocks): places of the base phrases, and all
    blocks that meet a template, one row per document."""
    index = Index(templates, token_documents(docs, {w for _, _, t in templates for w in words_of(t)}), threshold)
    sought = [(words_of(p), label) for p, label in phrases]
    code = dict(index.rank)
    for w in sorted({w for p, _ in sought for w in p}.difference(code)):
        code[w] = len(code)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            codes = []
            for text in texts:
                words = words_of(text)
                codes.append(np.fromiter(map(code.get, words, repeat(-1)), np.int64, len(words)))
            n = np.array([len(c) for c in codes], np.int64)
            flat = np.concatenate([*codes, np.empty(0, np.int64)])
            at = np.cumsum(n) - n
            doc = np.repeat(np.arange(len(n)), n)
            found: list[list[dict]] = [[] for _ in codes]
            blocks: list[list[dict]] = [[] for _ in codes]
            for p, label in sought:
                here = np.flatnonzero(flat == code[p[0]])
                for k, w in enumerate(p[1:], 1):
                    here = here[here + k < len(flat)]
                    here = here[(flat[here + k] == code[w]) & (doc[here + k] == doc[here])]
                for i in here.tolist():
                    found[doc[i]].append({"label": label, "word": i - int(at[doc[i]])})
            held = np.flatnonzero((flat >= 0) & (flat < len(index.rank)))
            for d, t, first, size, overlap in matching_blocks(doc[held], held - at[doc[held]], flat[held], n, index):
                name, label = index.names[t]
                blocks[d].append({"template": name, "label": label, "first_word": first, "n_words": size,
                                  "overlap": overlap, "containment": overlap / int(index.size[t])})
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n), pa.array(found, SCAN.field("phrases").type),
                 pa.array(blocks, SCAN.field("blocks").type)], schema=SCAN)

    return _texts(docs).mapInArrow(
        run, "doc_id long, n_words long, phrases array<struct<label string, word long>>, blocks array<struct<template "
             "string, label string, first_word long, n_words long, overlap long, containment double>>")


def labelled(docs: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES,
             threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: n_words, the base places and labels, all labels,
    and the highest containment (0 without a block)."""
    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    base = F.transform("phrases", lambda p: p["label"])
    return scan(docs, templates, threshold).select(
        "doc_id", "n_words", F.size("phrases").cast("long").alias("n_base"),
        F.array_min(F.transform("phrases", lambda p: p["word"])).alias("first_word"),
        F.array_max(F.transform("phrases", lambda p: p["word"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform("blocks", lambda b: b["label"]))).alias("labels"),
        F.coalesce(F.array_max(F.transform("blocks", lambda b: b["containment"])), F.lit(0.0)).alias("score"))


def oracle(templates: Sequence[tuple[str, str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """``labelled`` in DuckDB SQL, counting all blocks with all templates."""
    rows, heads = [], []
    for t, (_, label, text) in enumerate(templates):
        distinct = sorted(set(words_of(text)))
        heads.append(f"({t}, '{label}', {window_step(len(words_of(text)))}, {len(distinct)}, "
                     f"{least_overlap(len(distinct), threshold)})")
        rows += [f"({t}, '{w.decode()}')" for w in distinct]
    phrase = " UNION ALL ".join(
        f"SELECT id, i - 1 AS word, '{label}' AS label FROM w, unnest(range(1, len(ws) + 1)) u(i) WHERE "
        + " AND ".join(f"ws[i + {k}] = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
head(t, label, step, size, least) AS (VALUES {', '.join(heads)}),
tok(t, x) AS (VALUES {', '.join(rows)}),
occ AS (SELECT id, unnest(ws) AS x, unnest(range(len(ws))) AS pos FROM w),
hit AS (SELECT id, t, x, pos // step AS k FROM occ JOIN tok USING (x) JOIN head USING (t)
  UNION ALL SELECT id, t, x, pos // step - 1 FROM occ JOIN tok USING (x) JOIN head USING (t) WHERE pos >= step),
block AS (SELECT id, t, k, count(DISTINCT x) AS overlap FROM hit GROUP BY id, t, k),
met AS (SELECT id, label, overlap / size::DOUBLE AS c FROM block JOIN head USING (t) WHERE overlap >= least),
base AS ({phrase}),
lab AS (SELECT id, label FROM base UNION SELECT id, label FROM met)
SELECT doc_id, len(ws)::BIGINT AS n_words,
  (SELECT count(*) FROM base b WHERE b.id = w.id)::BIGINT AS n_base,
  (SELECT min(word) FROM base b WHERE b.id = w.id)::BIGINT AS first_word,
  (SELECT max(word) FROM base b WHERE b.id = w.id)::BIGINT AS last_word,
  coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base b WHERE b.id = w.id), '') AS base_labels,
  coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM lab l WHERE l.id = w.id), '') AS labels,
  coalesce((SELECT max(c) FROM met m WHERE m.id = w.id), 0.0)::DOUBLE AS score
FROM w
"""
