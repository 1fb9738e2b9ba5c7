"""License scans (operator 3) with a positional rare-token index.

Templates of licence notices are indexed by word: each word's postings are
(template, position). Word rarity is measured on the whole corpus (one pass
counts in how many documents each template word occurs; the result is as
large as the template vocabulary). A file's rarest licence words are looked
up; postings are intersected by relative position, that is, occurrences that
agree on where the template would start vote for that start. A candidate start
counts only if the template's mandatory key phrases really stand there (within
``SLACK`` words for notices, exactly for bare phrases). Each template's anchor,
the rarest word of its key phrases, is always looked up, so that no key phrase
is missed whatever else the file holds.

Every word of every text is read, in blocks, so long texts need bounded memory
beside their hits. Null and empty texts have no word and no hit (score 0).
Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bare phrases that every scan reports, with their labels.
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]

# Fixed values: (label, notice, mandatory key phrases).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files the software to deal in the software without restriction",
     ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
                   "license at http www apache org licenses license 2 0", ["www apache org licenses license 2 0"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3",
     ["gnu general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2",
     ["gnu general public license version 2"]),
    ("gpl-or-later", "either version 3 of the license or at your option any later version",
     ["or at your option any later version"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3.0", "under the terms of the gnu affero general public license", ["gnu affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met",
     ["redistribution and use in source and binary forms", "with or without modification"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted", ["permission to use copy modify and or distribute this software"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license",
     ["creative commons attribution"]),
]

#: Words of a file looked up besides anchors; how far key phrases may be displaced.
LOOKUPS, SLACK = 8, 8
#: Words in more than this share of all documents are looked up as anchors only.
COMMON = 0.02
BLOCK = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text (A-Z lowered), in blocks cut between words."""
    raw, at = (text or "").encode("utf-8", "replace").lower(), 0
    while at < len(raw):
        gap = _GAP.search(raw, min(at + BLOCK, len(raw)))
        end = gap.start() if gap else len(raw)
        yield _WORD.findall(raw, at, end)
        at = max(end, at + 1)


class Index:
    """Positional postings of the templates, with the corpus' word rarity."""

    def __init__(self, documents: int, frequency: dict[bytes, int]):
        rows = [(label, p, [p], 0, True) for label, p in BASE] + [(*t, SLACK, False) for t in TEMPLATES]
        split = lambda s: s.encode().split()
        self.idf = {w: math.log((documents + 1) / (frequency.get(w, 0) + 1)) for w in vocabulary()}
        rare = {w for w in self.idf if frequency.get(w, 0) <= COMMON * documents}
        self.templates, self.postings, self.anchors = [], defaultdict(list), set()
        for k, (label, text, phrases, slack, base) in enumerate(rows):
            words, keys = split(text), []
            for p in map(split, phrases):
                keys.append((next(i for i in range(len(words)) if words[i:i + len(p)] == p), p))
            self.templates.append((label, words, keys, slack, base))
            anchor = max((w for _, p in keys for w in p), key=lambda w: (self.idf[w], w))
            self.anchors.add(anchor)
            for i, w in enumerate(words):
                if w in rare or w == anchor:
                    self.postings[w].append((k, i))

    def scan(self, text: str | None) -> tuple[int, list[tuple[str, int, int, float, bool]]]:
        """(number of words, hits); a hit is (label, first word, words, score, base)."""
        at, n, idf = {}, 0, self.idf
        for block in word_blocks(text):
            at.update((n + i, w) for i, w in enumerate(block) if w in idf)
            n += len(block)
        held = {w for w in at.values() if w in self.postings}
        if not held:
            return n, []
        look = set(sorted(held, key=lambda w: (-idf[w], w))[:LOOKUPS]) | (held & self.anchors)
        votes: dict[tuple[int, int], int] = defaultdict(int)
        for p, w in at.items():
            if w in look:
                for k, i in self.postings[w]:
                    votes[k, p - i] += 1
        hits = []
        for (k, start), _ in sorted(votes.items(), key=lambda v: (v[0][0], -v[1], v[0][1])):
            label, words, keys, slack, base = self.templates[k]
            if all(self._stands(at, start + i, p, slack) for i, p in keys):
                score = sum(at.get(start + i) == w for i, w in enumerate(words)) / len(words)
                hits.append((label, start, len(words), score, base))
        return n, hits

    @staticmethod
    def _stands(at: dict[int, bytes], where: int, phrase: list[bytes], slack: int) -> bool:
        return any(all(at.get(s + j) == w for j, w in enumerate(phrase)) for s in range(where - slack, where + slack + 1))


def vocabulary() -> set[bytes]:
    return {w for text in [p for _, p in BASE] + [t[1] for t in TEMPLATES] for w in text.encode().split()}


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, n, df = vocabulary(), 0, defaultdict(int)
    for b in batches:
        for text in b["text"]:
            n += 1
            for w in {w for block in word_blocks(text) for w in known.intersection(block)}:
                df[w] += 1
    yield pd.DataFrame([(None, n), *((w.decode(), c) for w, c in df.items())], columns=["word", "n"])


def build_index(docs: DataFrame) -> Index:
    """The template index with document frequencies counted over all of ``docs``."""
    rows = (docs.select("text").mapInPandas(_count, "word string, n long").groupBy("word")
            .agg(F.sum("n").alias("n")).collect())
    counts = {r["word"]: r["n"] for r in rows}
    return Index(counts.pop(None, 0), {w.encode(): c for w, c in counts.items()})


_HITS = ("n_words long, hits array<struct<label:string,first_word:long,n_words:long,score:double,base:boolean>>")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, hits) of every row of ``docs(doc_id, text)``; a hit may
    lie before word 0 or end past the text where a notice is cut off."""
    index = build_index(docs)

    @F.pandas_udf(_HITS)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in texts:
            found = [index.scan(t) for t in s]
            yield pd.DataFrame({"n_words": [n for n, _ in found],
                                "hits": [[dict(zip(("label", "first_word", "n_words", "score", "base"), h))
                                          for h in hits] for _, hits in found]})

    return docs.select("doc_id", scan("text").alias("r")).select("doc_id", "r.n_words", "r.hits")


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: words, base phrases and where they start, labels, score."""
    hits = scan_licenses(docs)
    base = F.filter("hits", lambda h: h["base"])
    join = lambda c: F.array_join(F.sort_array(F.array_distinct(c)), ",")
    return hits.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first_word"]).alias("first_word"), F.array_max(base["first_word"]).alias("last_word"),
        join(base["label"]).alias("base_labels"), join(F.col("hits.label")).alias("labels"),
        F.coalesce(F.array_max("hits.score"), F.lit(0.0)).alias("score"))
