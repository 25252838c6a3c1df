"""Secrets in texts, found through a trigram index.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must contain (Cox 2012). The index is
partitioned by document: each task holds the postings of the rules' trigrams for the documents it reads, intersects them,
and runs a rule only on the texts its query leaves. A rule without mandatory trigrams runs on every text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from re import _constants as K
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import vec

#: Rule name and expression, in the syntax that Python (with re.ASCII) and RE2 share; the SQL uses these.
SHARED = {
    "aws_access_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,72}",
    "stripe_key": r"\bsk_(?:live|test)_[0-9A-Za-z]{24,64}",
    "google_api_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "json_web_token": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "assignment": r"(?i:\b(?:token|secret|password|passwd|api_?key)[ \t]?[=:][ \t]?[\"']?[0-9a-z+/_-]{16,}[\"']?)",
    "hex_digest": r"\b(?:[0-9a-f]{40}|[0-9A-F]{40})\b",
}
_KEY = r"(?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"
#: What Python looks for: a key up to its END line or, if that is missing, the end of its base64 lines; names that end in one of the words after "_" or
#: "-", and quoted names.
RULES = SHARED | {
    "private_key": rf"-----BEGIN {_KEY}(?:[^-]*+(?:-{{1,4}}+[^-]++)*+-----END {_KEY}|(?:\s+(?:Proc-Type|DEK-Info):[^\n]*)*(?:(?:\s|\\[rn])+[0-9A-Za-z+/]{{16,}}={{0,2}})*(?:(?:\s|\\[rn])+[0-9A-Za-z+/]{{2,}}={{1,2}})?)",
    "assignment": r"(?i:(?<![0-9a-z])(?:token|secret|password|passwd|api_?key)[\"']?[ \t]?[=:][ \t]?[\"']?[0-9a-z+/_-]{16,}[\"']?)",
}
#: Strings that one part of an expression may stand for, before it counts as anything.
MOST_STRINGS, MOST_CLASS = 64, 8
ALL = ("all",)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[128:] = 0


def both(op: str, parts: list[tuple]) -> tuple:
    rest = [p for p in parts if p != ALL]
    if op == "or" and len(rest) < len(parts) or not rest:
        return ALL
    return rest[0] if len(rest) == 1 else (op, *dict.fromkeys(rest))


def grams(strings: set[str]) -> tuple:
    """Any of the strings occurs."""
    return both("or", [both("and", [("gram", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def node(op, arg) -> tuple[set[str] | None, tuple]:
    """The strings a part of an expression stands for, in lower case (None: too many), and what any match of it must contain."""
    if op is K.LITERAL:
        return {chr(arg).lower()}, ALL
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return {""}, ALL
    if op is K.IN:
        out: set[str] = set()
        for o, a in arg:
            if o is K.LITERAL:
                out.add(chr(a).lower())
            elif o is K.RANGE and a[1] - a[0] <= MOST_CLASS:
                out |= {chr(x).lower() for x in range(a[0], a[1] + 1)}
            else:
                return None, ALL
        return (out, ALL) if len(out) <= MOST_CLASS else (None, ALL)
    if op is K.SUBPATTERN:
        return sequence(arg[-1])
    if op is K.BRANCH:
        ways = [sequence(x) for x in arg[1]]
        if all(e is not None for e, _ in ways) and sum(len(e) for e, _ in ways) <= MOST_STRINGS:
            return set().union(*(e for e, _ in ways)), ALL
        return None, both("or", [q if e is None else grams(e) for e, q in ways])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT):
        low, high, sub = arg
        exact, q = sequence(sub)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, ALL
        if low == 0:
            return None, ALL
        if exact is None:
            return None, q
        if len(exact) == 1 and low <= 32:
            s = {next(iter(exact)) * low}
            return (s, ALL) if low == high else (None, grams(s))
        return None, grams(exact)
    return None, ALL


def sequence(parts) -> tuple[set[str] | None, tuple]:
    run, q, broken = {""}, [], False
    for op, arg in parts:
        exact, inner = node(op, arg)
        if exact is not None and len(exact) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in exact}
            continue
        q += [grams(run), inner]
        run, broken = (exact if exact is not None else {""}), True
    return (None, both("and", [*q, grams(run)])) if broken else (run, ALL)


def trigram_query(pattern: str) -> tuple:
    """("all",), ("gram", "abc"), ("and", ...) or ("or", ...) over trigrams of the lower-cased text, true of every text with a match."""
    exact, q = sequence(_parser.parse(pattern, re.ASCII))
    return grams(exact) if exact is not None else q


class Index:
    """The trigrams of a set of rules, and their postings in a batch."""

    def __init__(self, rules: dict[str, str]):
        self.rules = {k: re.compile(p, re.ASCII) for k, p in rules.items()}
        self.queries = {k: trigram_query(p) for k, p in rules.items()}
        names = sorted({g for q in self.queries.values() for g in self._grams(q)})
        self.number = {g: i for i, g in enumerate(names)}
        self.table = np.zeros(1 << 21, np.int16)
        for g, i in self.number.items():
            a, b, c = g.encode("ascii")
            self.table[a << 14 | b << 7 | c] = i + 1

    def _grams(self, q: tuple) -> set[str]:
        if q[0] == "gram":
            if not q[1].isascii():
                raise ValueError(f"only ASCII expressions: {q[1]!r}")
            return {q[1]}
        return set().union(*(self._grams(x) for x in q[1:] if isinstance(x, tuple)))

    def postings(self, b: np.ndarray, off: np.ndarray) -> np.ndarray:
        """[trigram, text]: which texts have it."""
        n = len(off) - 1
        out = np.zeros((len(self.number), n), bool)
        if len(b) > 2:
            x = _LOWER[b].astype(np.int32)
            t = self.table[x[:-2] << 14 | x[1:-1] << 7 | x[2:]]
            at = np.flatnonzero(t)
            doc = np.searchsorted(off, at, "right") - 1
            ok = at + 3 <= off[doc + 1]
            out[t[at[ok]] - 1, doc[ok]] = True
        return out

    def select(self, q: tuple, postings: np.ndarray) -> np.ndarray:
        if q == ALL:
            return np.ones(postings.shape[1], bool)
        if q[0] == "gram":
            return postings[self.number[q[1]]]
        parts = [self.select(x, postings) for x in q[1:]]
        return np.logical_and.reduce(parts) if q[0] == "and" else np.logical_or.reduce(parts)

    def scan(self, texts: pa.Array) -> list[tuple[int, str, int, int, str]]:
        """(text, rule, start, end, match) in order of text, rule and place."""
        b, off = vec.raw(texts)
        post = self.postings(b, off)
        cache: dict[int, str] = {}
        raw = b.tobytes()
        out = []
        for rule, rx in self.rules.items():
            for i in np.flatnonzero(self.select(self.queries[rule], post)).tolist():
                if i not in cache:
                    cache[i] = raw[off[i] : off[i + 1]].decode()
                out += [(i, rule, m.start(), m.end(), m[0]) for m in rx.finditer(cache[i])]
        return sorted(out)


def find_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """(doc_id, rule, start_char, end_char, secret): every match of every rule, leftmost first and not overlapping within a rule.

    Whole texts are searched; null and empty texts have no matches; a null doc_id is kept as null; a repeated row gives its
    matches again; other columns are not read; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                hits = index.scan(part.column(1))
                rows, rule, s, e, m = zip(*hits) if hits else ((),) * 5
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(rule, pa.string()), pa.array(s, pa.int64()), pa.array(e, pa.int64()), pa.array(m, pa.string())], names=["doc_id", "rule", "start_char", "end_char", "secret"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, rule string, start_char long, end_char long, secret string")


def redact_secrets(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The rows of docs with every match replaced by [SECRET:rule] (of overlapping ones, the first rule of those that begin
    first) and n_chars, if there is one, brought up to date. Nothing is shuffled; rows without a match stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(rules)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                t = part.schema.get_field_index("text")
                hits: dict[int, list[tuple[int, int, str]]] = {}
                for i, rule, s, e, _ in index.scan(part.column(t)):
                    hits.setdefault(i, []).append((s, e, rule))
                if hits:
                    texts = part.column(t).to_pylist()
                    for i, spans in hits.items():
                        texts[i] = cover(texts[i], spans)
                    part = part.set_column(t, part.schema.field(t), pa.array(texts, part.schema.field(t).type))
                    n = part.schema.get_field_index("n_chars")
                    if n >= 0:
                        counts = part.column(n).to_pylist()
                        for i in hits:
                            counts[i] = len(texts[i])
                        part = part.set_column(n, part.schema.field(n), pa.array(counts, part.schema.field(n).type))
                yield part

    return docs.mapInArrow(run, docs.schema)


def cover(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    merged: list[list] = []
    for s, e, rule in sorted(spans, key=lambda x: x[:2]):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e, rule])
    for s, e, rule in merged:
        out += [text[at:s], f"[SECRET:{rule}]"]
        at = e
    return "".join([*out, text[at:]])


def sql(rules: dict[str, str] = SHARED) -> str:
    values = ", ".join("('{}', '{}')".format(k, p.replace("'", "''")) for k, p in rules.items())
    return f"""
WITH r(rule, rx) AS (VALUES {values}),
m AS (SELECT doc_id, rule, regexp_extract_all(text, rx) AS ms, regexp_split_to_array(text, rx) AS ps FROM documents, r),
u AS (SELECT doc_id, rule, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
x AS (SELECT doc_id, rule, ms[i] AS secret, CAST(list_sum(list_transform(ps[1:i], lambda p: length(p))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda p: length(p))), 0) AS BIGINT) AS start_char FROM u)
SELECT doc_id, rule, start_char, CAST(start_char + length(secret) AS BIGINT) AS end_char, secret FROM x"""
