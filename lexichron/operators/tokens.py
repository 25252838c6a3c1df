"""Tokens: words of the plain kind, dictionary segmentation, or any tokenizer as a plug-in; then filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.readers import read_terms


def longest_match(text: str, words: frozenset[str], longest: int) -> list[str]:
    """Dictionary words from left to right, the longest first; what lies between stays whole runs of letters and digits, or single characters."""
    out, at, run = [], 0, ""
    while at < len(text):
        for n in range(min(longest, len(text) - at), 0, -1):
            if text[at : at + n] in words:
                if run:
                    out.append(run)
                    run = ""
                out.append(text[at : at + n])
                at += n
                break
        else:
            c = text[at]
            if c.isalnum() and ord(c) < 0x2E80 or c == "_":
                run += c
            else:
                if run:
                    out.append(run)
                    run = ""
                if not c.isspace():
                    out.append(c)
            at += 1
    return [*out, run] if run else out


def combine(tokens: list[str], joined: frozenset[str], longest: int) -> list[str]:
    """Neighbouring tokens whose concatenation is in the dictionary become one, the longest first."""
    out, i = [], 0
    while i < len(tokens):
        word, best, j = tokens[i], 1, 1
        while i + j < len(tokens) and len(word) < longest:
            word += tokens[i + j]
            j += 1
            if word in joined:
                best = j
        out.append("".join(tokens[i : i + best]))
        i += best
    return out


#: Terms of a list that goes to every task.
MOST_TERMS = 1_000_000
#: Texts whose tokens are held in Python at a time.
TEXTS = 128


@dataclass(frozen=True)
class Tokenizer:
    """How texts become tokens. `load` gives a function text -> tokens, called once in each Python worker; without it and without dictionaries, words
    are found by expression alone and no Python runs. Dictionaries and stop words are of a size to go to every task."""

    load: Callable[[], Callable[[str], list[str]]] | None = None
    force: frozenset[str] = frozenset()
    combined: frozenset[str] = frozenset()
    stop: frozenset[str] = frozenset()
    shortest: int = 2
    normalize: Callable[[Column], Column] | None = None

    @classmethod
    def from_files(cls, spark: SparkSession, stop: str | None = None, force: str | None = None, combined: str | None = None, use_stopwords: bool = True, use_dictionaries: bool = True, **settings) -> Tokenizer:
        """A tokenizer with the terms of these files, one a line. A file that is absent, or whose kind isn't to be used, counts as empty; a list of more than
        MOST_TERMS terms is an error (without_stop_words() takes longer ones)."""

        def terms(path: str | None, used: bool) -> frozenset[str]:
            rows = read_terms(spark, path if used else None).limit(MOST_TERMS + 1).collect()
            if len(rows) > MOST_TERMS:
                raise ValueError(f"{path} has more than {MOST_TERMS} terms")
            return frozenset(r.term for r in rows)

        return cls(stop=terms(stop, use_stopwords), force=terms(force, use_dictionaries), combined=terms(combined, use_dictionaries), **settings)

    def tokens(self, c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        c = F.coalesce(self.normalize(c) if self.normalize else c, F.lit(""))
        if self.load is None and not self.force and not self.combined:
            return self.kept(T.words(c))
        load, force, joined = self.load, self.force, self.combined
        most, most_joined = max(map(len, force), default=1), max(map(len, joined), default=1)

        @F.pandas_udf("array<string>")
        def segment(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            cut = load() if load else lambda s: longest_match(s, frozenset(), 1)

            def one(s: str) -> list[str]:
                # dictionary words stand as they are; the tokenizer sees what lies between
                parts = longest_match_spans(s, force, most) if force else [s]
                out = [t for p in parts for t in ([p] if p in force else cut(p))]
                return combine(out, joined, most_joined) if joined else out

            for batch in batches:
                for at in range(0, len(batch), TEXTS):
                    yield batch.iloc[at : at + TEXTS].map(one)

        return self.kept(segment(c))

    def kept(self, tokens: Column) -> Column:
        keep = lambda t: F.length(t) >= self.shortest
        if self.stop:
            stop = sorted(self.stop)
            return F.filter(tokens, lambda t: keep(t) & ~t.isin(stop))
        return F.filter(tokens, keep)


def longest_match_spans(text: str, words: frozenset[str], longest: int) -> list[str]:
    """The text cut at dictionary words, the longest first; nothing is lost."""
    out, at, begin = [], 0, 0
    while at < len(text):
        n = next((n for n in range(min(longest, len(text) - at), 0, -1) if text[at : at + n] in words), 0)
        if n:
            if begin < at:
                out.append(text[begin:at])
            out.append(text[at : at + n])
            at = begin = at + n
        else:
            at += 1
    return [*out, text[begin:]] if begin < len(text) else out


def explode_tokens(docs: DataFrame, text: str, tokenizer: Tokenizer = Tokenizer(), keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., term): a row for each token."""
    return docs.select(*keep, F.explode(tokenizer.tokens(text)).alias("term"))


def without_stop_words(tokens: DataFrame, stop: DataFrame, column: str = "term") -> DataFrame:
    """For stop lists too long for an expression: an anti-join that Spark broadcasts or shuffles by their size."""
    return tokens.join(stop.select(F.col("term").alias(column)).distinct(), column, "left_anti")


def retokenized(tokens: Column | str) -> Column:
    """Given tokens joined by spaces and cut into lower-cased words of two characters or more again."""
    return T.words(F.array_join(tokens, " "))
