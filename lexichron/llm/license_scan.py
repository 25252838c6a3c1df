"""Text blocks that contain a licence template, by an exact set-similarity join.

A block is a line of a text; its and a template's token sets are compared by containment, the share of the template's tokens that the block
has. Tokens are ordered by how many blocks of the whole corpus have them, rarest first. A block can only meet the
threshold if it has one of a template's prefix tokens (prefix filter), enough template tokens at all (length filter), and enough of
them at or after the place where the two first meet (positional filter); what is left is counted in full. Tokens
that are in no template can't add to an overlap and are dropped from the blocks beforehand.

A template wrapped over lines is found in a second look at texts that meet it as a whole: a run of lines is a block too if a stretch of its
words, no longer than the template's by more than the threshold allows, meets the template where none of its lines does."""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec

THRESHOLD = 0.8
TEMPLATES = {
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "all-rights-reserved": "Copyright. All rights reserved.",
}
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in "0123456789abcdefghijklmnopqrstuvwxyz"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def tokens(text: str) -> list[str]:
    """Distinct runs of ASCII letters and digits, in lower case, in order of first appearance."""
    return list(dict.fromkeys(re.findall(r"[0-9a-z]+", text.translate({i: i + 32 for i in range(65, 91)}))))


class Vocabulary:
    def __init__(self, templates: dict[str, str]):
        self.words = sorted({t for x in templates.values() for t in tokens(x)})
        self.lookup = vec.Lookup(vec.hash_words(self.words), 16)

    def occurrences(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(block, word, at): each template token wherever it occurs, and which word of all it is; and each block's text, first and last byte + 1."""
        b, off = vec.raw(texts)
        lower = _LOWER[b]
        s, e, _ = vec.words(lower, off, _TOKEN)
        at, word = self.lookup.find(vec.span_hash(vec.prefix(lower), s, e))
        # a block begins with each text and after each line break
        line = np.flatnonzero(b == 10) + 1
        begin = np.unique(np.concatenate([off[:-1], line[line < len(b)]]))
        block = np.searchsorted(begin, s[at], "right") - 1
        text = np.searchsorted(off, begin, "right") - 1
        end = np.append(begin[1:], len(b))
        return block, word, at, text, begin, end

    def once(self, block: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(block, word): each token of each block once."""
        pairs = np.unique(block * len(self.words) + word)
        return pairs // len(self.words), pairs % len(self.words)


def frequencies(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How many blocks of all texts have each template token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                n += np.bincount(vocabulary.once(*vocabulary.occurrences(part.column(0))[:2])[1], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], names=["word", "n"])

    out = np.zeros(len(vocabulary.words), np.int64)
    for r in docs.select("text").where("text is not null").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out


class Join:
    """The templates in the global token order, and the inverted lists of their prefixes."""

    def __init__(self, templates: dict[str, str], vocabulary: Vocabulary, frequency: np.ndarray, threshold: float):
        order = sorted(range(len(vocabulary.words)), key=lambda w: (frequency[w], vocabulary.words[w]))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.names = [n for n, t in templates.items() if tokens(t)]
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.sets = [np.sort(self.rank[[number[w] for w in tokens(templates[n])]]) for n in self.names]
        self.need = np.array([max(1, ceil(threshold * len(x) - 1e-9)) for x in self.sets], np.int64)
        self.length = [len(re.findall("[0-9a-z]+", templates[n].lower())) for n in self.names]
        self.most = [int(n / threshold + 1e-9) if threshold > 0 else n for n in self.length]
        self.prefix = [[] for _ in order]
        for t, x in enumerate(self.sets):
            for place in range(len(x) - int(self.need[t]) + 1):
                self.prefix[x[place]].append((t, place))
        self.has = np.array([bool(x) for x in self.prefix], bool)
        self.least = int(self.need.min()) if len(self.need) else 1

    def match(self, block: np.ndarray, word: np.ndarray) -> list[tuple[int, int, int]]:
        """(block, template, overlap) of all that meet the threshold."""
        rank = self.rank[word]
        order = np.lexsort((rank, block))
        block, rank = block[order], rank[order]
        first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(block) else np.zeros(0, int)
        size = np.diff(np.append(first, len(block)))
        place = np.arange(len(block)) - np.repeat(first, size)
        size = np.repeat(size, size)
        out, seen = [], set()
        # length filter: even the least demanding template needs so many tokens
        for i in np.flatnonzero(self.has[rank] & (size - place >= self.least)).tolist():
            rest = int(size[i] - place[i])
            for t, p in self.prefix[rank[i]]:
                # the first common token is here: positional filter over what comes after it on either side
                if (int(block[i]), t) in seen or size[i] < self.need[t] or min(rest, len(self.sets[t]) - p) < self.need[t]:
                    continue
                seen.add((int(block[i]), t))
                own = rank[i - place[i] : i - place[i] + size[i]]
                n = len(np.intersect1d(own, self.sets[t], assume_unique=True))
                if n >= self.need[t]:
                    out.append((int(block[i]), t, n))
        return out

    def wrapped(self, block: np.ndarray, word: np.ndarray, at: np.ndarray, text: np.ndarray, met: list[tuple[int, int, int]], once) -> list[tuple[int, int, int, int]]:
        """(first block, last block, template, overlap) of the runs of blocks that meet a template where no block of them does; `met` are the blocks that do."""
        own = text[block]
        alone: dict[tuple[int, int], list[int]] = {}
        for b, t, _ in met:
            alone.setdefault((int(text[b]), t), []).append(b)
        out = []
        # a run can only meet what its whole text meets
        for d, t, _ in self.match(*once(own, word)):
            i = np.arange(*np.searchsorted(own, [d, d + 1]))
            i = i[np.isin(self.rank[word[i]], self.sets[t])]
            bars = np.array(sorted(alone.get((d, t), [])), np.int64)
            i = i[~np.isin(block[i], bars)]
            # runs end at a block that meets the template by itself
            piece = np.searchsorted(bars, block[i])
            for own_piece in np.split(i, np.flatnonzero(np.diff(piece)) + 1):
                for x, y in stretches(at[own_piece].tolist(), word[own_piece].tolist(), self.length[t], self.most[t], int(self.need[t])):
                    a, z = int(block[own_piece[x]]), int(block[own_piece[y]])
                    lo, hi = np.searchsorted(block, a), np.searchsorted(block, z, "right")
                    out.append((a, z, t, len(np.intersect1d(self.rank[word[lo:hi]], self.sets[t]))))
        return out


def stretches(at: list[int], word: list[int], own: int, most: int, need: int) -> list[tuple[int, int]]:
    """(first, last) of stretches that don't overlap, each of at most `most` places and with `need` different words: from the left, the fullest
    of those that overlap the next one; on a tie the first, drawn out to `own` places."""
    out = []
    count: dict[int, int] = {}
    left, y, best, until = 0, 0, None, -1
    while True:
        if best is not None and (y == len(at) or left > until):
            out.append(best[1:])
            left = y = best[2] + 1
            count, best = {}, None
        if y == len(at):
            return out
        count[word[y]] = count.get(word[y], 0) + 1
        # what a word later in the stretch repeats adds nothing at its beginning
        while at[y] - at[left] >= most or count[word[left]] > 1:
            count[word[left]] -= 1
            if not count[word[left]]:
                del count[word[left]]
            left += 1
        if len(count) >= need and (best is None or left <= until):
            if best is None:
                until = y
            if best is None or len(count) > best[0] or len(count) == best[0] and left == best[1] and at[y] - at[left] < own:
                best = (len(count), left, y)
        y += 1


def license_blocks(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, wrapped: bool = False) -> DataFrame:
    """(doc_id, block, template, overlap, containment, text): every line of a text with at least `threshold` of a template's tokens; if `wrapped`, also
    every run of lines that holds a template wrapped over them, under the number of its first line.

    block counts the lines of a text from 0; every template that a line meets gives a row. Null and empty texts and lines without a token
    match nothing; templates without a token are ignored; a null doc_id is kept as null; repeated rows match again; an empty
    table gives an empty result; other columns are not read."""
    vocabulary = Vocabulary(templates)
    join = Join(templates, vocabulary, frequencies(docs, vocabulary), threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in vec.slices(batch, "text"):
                block, word, at, text, begin, end = vocabulary.occurrences(part.column(1))
                met = join.match(*vocabulary.once(block, word))
                found = [(b, b, t, n) for b, t, n in met]
                if wrapped:
                    found += join.wrapped(block, word, at, text, met, vocabulary.once)
                k, z, t, n = (np.array(x, np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
                raw = vec.raw(part.column(1))[0].tobytes() if found else b""
                lines = [raw[begin[i] : end[j]].decode("utf8").removesuffix("\n") for i, j in zip(k.tolist(), z.tolist())]
                number = k - np.searchsorted(text, text[k])
                share = [x / len(join.sets[y]) for x, y in zip(n.tolist(), t.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text[k])), pa.array(number.astype(np.int64)), pa.array([join.names[i] for i in t.tolist()], pa.string()), pa.array(n), pa.array(share, pa.float64()), pa.array(lines, pa.string())],
                    names=["doc_id", "block", "template", "overlap", "containment", "text"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, block long, template string, overlap long, containment double, text string")


def sql(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    values = ", ".join("('{}', '{}')".format(k, " ".join(tokens(v))) for k, v in templates.items())
    return f"""
WITH t(template, words) AS (VALUES {values}),
tw AS (SELECT template, unnest(string_split(words, ' ')) AS w, len(string_split(words, ' ')) AS n FROM t),
l AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
b AS (SELECT r, doc_id, unnest(range(0, len(ls))) AS block, unnest(ls) AS text FROM l),
bw AS (SELECT r, block, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+'))) AS w FROM b),
m AS (SELECT r, block, template, count(*) AS overlap, any_value(n) AS n FROM bw JOIN tw USING (w) GROUP BY r, block, template HAVING count(*) >= greatest(1, ceil({threshold} * any_value(n) - 1e-9)))
SELECT doc_id, CAST(block AS BIGINT) AS block, template, CAST(overlap AS BIGINT) AS overlap, overlap / n AS containment, text FROM m JOIN b USING (r, block)"""
