"""Toxic documents, also behind leetspeak, spacing and repetition.

Suspicious spans (letters mixed with digits or symbols, a letter three times or more in a row, single letters set apart) become
lattices of the characters they may stand for. A Viterbi search under a character trigram model of the whole corpus finds
the likeliest reading. Plain and restored words and word beginnings are then scored by a logistic model, or by the most telling of them
alone, both fitted to a bounded number of labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vec
from .common import cut

#: At most so many labelled documents are used for fitting (those whose doc_id has the least hash).
LABELLED_ROWS = 50_000
#: A feature is used if in so many toxic documents, so many times likelier there than in others, and surely telling to this degree: what is toxic
#: by chance only would add up over a long text.
LEAST_DOCS, LEAST_RATIO, LEAST_SURE = 4, 4.0, 0.4
THRESHOLD = 0.5
#: A feature can decide alone only if it is at least so sure.
ALONE = 0.9
#: Word beginnings of these lengths in bytes are features besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8)

_SYMBOLS = 28
_CONT, _OTHER = 255, 27
_LM = np.zeros(256, np.uint8)
_LM[97:123] = np.arange(1, 27)
_LM[128:192] = _CONT
_LM[192:] = _OTHER
#: What each character may stand for, with the channel's log probability; "" is noise.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t",
}
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in LEET]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[ord(c) for c in "@$!|+"]] = True
_MONEY = np.zeros(256, bool)
_MONEY[[ord(c) for c in "@$"]] = True
_ALNUM = vec.WORD.copy()
_ALNUM[ord("_")] = False
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_GAP = np.zeros(256, bool)
_GAP[[ord(c) for c in " .-_*/,\t"]] = True


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else _OTHER if ord(c) > 127 else 0


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(code, n): the character trigrams of all texts, lower-cased; anything but letters is a boundary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            for part in vec.slices(batch, "text"):
                b, off = vec.raw(pc.utf8_lower(part.column(0)))
                s = _LM[b]
                s = np.insert(s, off[1:], 0) if len(b) else s
                s = s[s != _CONT]
                keep = np.ones(len(s), bool)
                keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
                s = np.concatenate([np.zeros(2, np.uint8), s[keep]]).astype(np.int32)
                if len(s) > 2:
                    total += np.bincount(s[:-2] * (_SYMBOLS * _SYMBOLS) + s[1:-1] * _SYMBOLS + s[2:], minlength=_SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["code", "n"])

    return docs.select("text").where("text is not null").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language_model(docs: DataFrame) -> np.ndarray:
    """log P(c | a, b) by interpolation, as an array [a, b, c]; at most 28^3 counts come to the driver."""
    c3 = np.zeros(_SYMBOLS**3)
    for code, n in count_trigrams(docs).collect():
        c3[code] = n
    c3 = c3.reshape((_SYMBOLS,) * 3)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + _SYMBOLS)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5))


def lattice(span: str) -> list[list[tuple[str, float]]]:
    """For each character, what it may stand for. From a run of one character at most two are kept; a separator is a boundary or noise."""
    out: list[list[tuple[str, float]]] = []
    for c, group in groupby(span):
        run = len(list(group))
        if c in LEET:
            ways = [(x, log(0.9 / len(LEET[c]))) for x in LEET[c]] + [("", log(1e-4))]
        elif c.isalpha():
            ways = [(c, log(0.98))]
        else:
            out += [[("", log(0.6)), (" ", log(0.4))]] * min(run, 2)
            continue
        out.append(ways)
        if run > 1:
            keep = 0.98 if run == 2 else 0.5
            out.append([(x, p + log(keep)) for x, p in ways if x] + [("", log(1 - keep))])
    return out


def restore(span: str, lm: np.ndarray) -> tuple[str, float]:
    """The likeliest reading of the span and its log probability; ties go to the first in alphabetical order."""
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for ways in lattice(span):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (p, path) in states.items():
            for c, q in ways:
                if c == "":
                    key, r, to = (a, b), p + q, path
                elif c == " " and b == 0:
                    continue
                else:
                    s = symbol(c)
                    key, r, to = (b, s), p + q + lm[a, b, s], (c, path)
                old = new.get(key)
                if old is None or r > old[0] or (r == old[0] and to < old[1]):
                    new[key] = (r, to)
        states = new or states
    best, path = max(((p + (lm[a, b, 0] if b else 0.0), path) for (a, b), (p, path) in states.items()), key=lambda x: x[0])
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out)), float(best)


def suspicious(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the spans to restore, in lower-cased bytes."""
    if not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(len(b) + 1, bool)
    edge[off] = True
    alnum = _ALNUM[b]
    # whole runs of signs before a letter or digit, and of those that seldom are punctuation also after one
    kept = np.zeros(len(b) + 1, np.int32)
    for table, side in ((_SIGN, 1), (_MONEY, 0)):
        s, e, _ = vec.words(b, off, table)
        touch = alnum[np.minimum(e, len(b) - 1)] & ~edge[e] if side else alnum[s - 1] & ~edge[s]
        kept[s[touch]] += 1
        kept[e[touch]] -= 1
    w = alnum | (np.cumsum(kept[:-1]) > 0)
    # words() takes a table over byte values; give it the mask as bytes
    s, e, _ = vec.words(w.view(np.uint8), off, np.array([False] + [True] * 255))
    cum = lambda m: np.concatenate([[0], np.cumsum(m)])
    leet, letter = cum(_LEET[b]), cum(_LETTER[b])
    triple = np.zeros(len(b), bool)
    triple[2:] = (b[2:] == b[1:-1]) & (b[1:-1] == b[:-2]) & _LETTER[b[2:]]
    triple = cum(triple)
    inside = lambda c: c[e] - c[s]
    hit = ((inside(leet) > 0) & (inside(letter) > 0)) | ((inside(triple) > 0) & (inside(letter) > 2))
    # single letters or digits with nothing but separators between them
    one = (e - s == 1) & (_LETTER[b[s]] | _LEET[b[s]])
    joined = np.zeros(len(s), bool)
    if len(s) > 1:
        gap, border = cum(_GAP[b]), cum(edge)
        joined[1:] = one[1:] & one[:-1] & (s[1:] > e[:-1]) & (gap[s[1:]] - gap[e[:-1]] == s[1:] - e[:-1]) & (border[s[1:] + 1] == border[e[:-1]])
    first = np.flatnonzero(one & ~joined)
    ends = np.append(np.flatnonzero(~joined)[1:], len(s))
    last = ends[np.searchsorted(np.flatnonzero(~joined), first)] - 1
    long = last - first >= 2
    ss, ee = np.concatenate([s[hit & ~one], s[first[long]]]), np.concatenate([e[hit & ~one], e[last[long]]])
    order = np.argsort(ss, kind="stable")
    return ss[order], ee[order]


def features(b: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, word) of every feature: whole words and their beginnings; and each word's start and end."""
    s, e, _ = vec.words(b, off, _ALNUM)
    p = vec.prefix(b)
    n = np.arange(len(s))
    hs, ws = [vec.span_hash(p, s, e)], [n]
    for k in BEGINNINGS:
        long = np.flatnonzero(e - s > k)
        hs.append(vec.mix(vec.span_hash(p, s[long], s[long] + k), k))
        ws.append(long)
    return np.concatenate(hs), np.concatenate(ws), s, e


def restored(b: np.ndarray, off: np.ndarray, lm: np.ndarray, memo: dict[bytes, str]) -> tuple[list[str], np.ndarray]:
    """The readings of all suspicious spans, and the text each is in."""
    s, e = suspicious(b, off)
    raw = b.tobytes()
    out = []
    for x, y in zip(s.tolist(), e.tolist()):
        span = raw[x:y]
        if span not in memo:
            if len(memo) > 200_000:
                memo.clear()
            memo[span] = restore(span.decode("utf8", "replace"), lm)[0]
        out.append(memo[span])
    return out, np.searchsorted(off, s, "right") - 1


@dataclass
class Model:
    lm: np.ndarray
    keys: np.ndarray
    weights: np.ndarray
    bias: float
    #: How sure a feature by itself makes a document toxic.
    alone: np.ndarray


def lower_bound(pos: np.ndarray, neg: np.ndarray, z: float = 3.0) -> np.ndarray:
    """Wilson's lower bound of the share of toxic documents among those that have a feature."""
    n = np.maximum(pos + neg, 1)
    p = pos / n
    return (p + z * z / (2 * n) - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def found(texts: pa.Array, lm: np.ndarray, lookup: vec.Lookup | None, memo: dict) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """For each feature of a plain or restored word that is in lookup (all, if None): text, feature (or its hash), word; and how many spans each text had restored."""
    b, off = vec.raw(pc.utf8_lower(texts))
    again, where = restored(b, off, lm, memo)
    n = np.bincount(where, minlength=len(texts))
    docs, feats, names = [], [], []
    for kind, (bb, oo, owner) in enumerate(((b, off, None), (*vec.raw(pa.array(again, pa.string())), where))):
        h, w, s, e = features(bb, oo)
        if lookup is None:
            f = h
        else:
            at, f = lookup.find(h)
            w = w[at]
        d = np.searchsorted(oo, s[w], "right") - 1
        docs.append(d if owner is None else owner[d])
        feats.append(f)
        if lookup is not None:
            raw = bb.tobytes()
            names += [raw[x:y].decode("utf8", "replace") for x, y in zip(s[w].tolist(), e[w].tolist())]
    return np.concatenate(docs), np.concatenate(feats), names, n


def fit(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS) -> Model:
    """Counts the language model over all of docs; fits the weights to at most `rows` labelled documents (all, if there are no more).

    Labels with a null doc_id or toxic are ignored, of several for one doc_id the greatest counts; of several rows of a labelled doc_id the first text
    does. Without a toxic example nothing is toxic. What comes to the driver is bounded by the sample and by the alphabet, never by docs. The sample is
    written once and read for each step, docs are read once for the language model and once for the sample."""
    lm = language_model(docs)
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # the labels are bounded, so each task gets them all and the texts stay where they are
    pairs = sorted((r.doc_id, int(r.toxic)) for r in known.collect())
    ids, toxic = np.array([x for x, _ in pairs], np.int64), np.array([x for _, x in pairs], np.int32)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy()
            j = np.minimum(np.searchsorted(ids, doc), len(ids) - 1)
            at = np.flatnonzero(ids[j] == doc) if len(ids) else np.zeros(0, np.int64)
            chosen = batch.take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(toxic[j[at]] if len(ids) else toxic)], names=["doc_id", "text", "toxic"])

    sample = docs.select("doc_id", "text").where("text is not null and doc_id is not null").mapInArrow(pick, "doc_id long, text string, toxic int")
    # however often a labelled document is repeated
    sample = cut(sample.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")))
    total = sample.agg(F.sum(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("pos"), F.count("*").alias("n")).first()
    if not total.pos:
        return Model(lm, np.zeros(0, np.uint64), np.zeros(0), -10.0, np.zeros(0))

    def count(batches: Iterator[pa.RecordBatch], only: vec.Lookup | None = None, keys: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in vec.slices(batch, "text"):
                d, f, _, _ = found(part.column(1), lm, only, memo)
                f = f if only is None else keys[f]
                order = np.lexsort((d, f))
                d, f = d[order], f[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
                u, n = np.unique(f[new], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int64))], names=["f", "n"])

    # features of the toxic sample first, then how many of the other documents have these; both bounded by the sample
    pos = sample.where("toxic > 0").mapInArrow(count, "f long, n long").groupBy("f").agg(F.sum("n").alias("pos")).where(F.col("pos") >= LEAST_DOCS)
    pos = {r.f: r.pos for r in pos.collect()}
    keys = np.array(sorted(pos), np.int64).view(np.uint64)
    only = vec.Lookup(keys, 20)
    neg = sample.where("toxic = 0").mapInArrow(lambda x: count(x, only, keys), "f long, n long").groupBy("f").agg(F.sum("n").alias("neg"))
    neg = {r.f: r.neg for r in neg.collect()}
    sure = {f: float(lower_bound(np.array([n]), np.array([neg.get(f, 0)]))[0]) for f, n in pos.items()}
    least = max(LEAST_SURE, min(0.85, 1.5 * total.pos / total.n))
    ratio = {f: (n / total.pos) / ((neg.get(f, 0) + 0.5) / (total.n - total.pos + 1)) for f, n in pos.items()}
    best = sorted((f for f in pos if ratio[f] >= LEAST_RATIO and sure[f] >= least), key=lambda f: (-pos[f], f))
    keys = np.array(best, np.int64).view(np.uint64)
    lookup = vec.Lookup(keys, 16)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for batch in batches:
            for part in vec.slices(batch, "text"):
                d, f, _, _ = found(part.column(1), lm, lookup, memo)
                u = np.unique(d * (len(keys) + 1) + f)
                at = np.searchsorted(u // (len(keys) + 1), np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(at.astype(np.int32), pa.array((u % (len(keys) + 1)).astype(np.int32))), part.column(2)], names=["f", "toxic"])

    x, y = [], []
    # at most `rows` short lists
    for r in sample.mapInArrow(present, "f array<int>, toxic int").collect():
        x.append(r.f)
        y.append(r.toxic)
    w, bias = logistic(x, np.array(y, float), len(keys))
    return Model(lm, keys, w, bias, lower_bound(np.array([pos[f] for f in best], float), np.array([neg.get(f, 0) for f in best], float)))


def logistic(rows: list[list[int]], y: np.ndarray, width: int, l2: float = 0.1, steps: int = 1000) -> tuple[np.ndarray, float]:
    """Weights >= 0 and bias of a logistic model on binary features, by accelerated projected gradients."""
    r = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    c = np.fromiter((j for x in rows for j in x), np.int64, len(r))
    most = 1.0 + (np.bincount(r).max() if len(r) else 0)
    rate = 1 / (0.25 * most * np.append(np.bincount(c, minlength=width), len(y)) + l2 + 1e-9)
    w = np.append(np.zeros(width), log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    v, t = w, 1.0
    for _ in range(steps):
        z = v[-1] + np.bincount(r, weights=v[c], minlength=len(rows))
        g = y - 1 / (1 + np.exp(-z))
        new = v + rate * (np.append(np.bincount(c, weights=g[r], minlength=width) - l2 * v[:-1], g.sum()))
        new[:-1] = np.maximum(0, new[:-1])
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    return w[:-1], float(w[-1])


def judge(texts: pa.Array, model: Model, lookup: vec.Lookup, memo: dict) -> tuple[np.ndarray, np.ndarray, list[list[str]]]:
    """Score of each text (the logistic model's, or that of its most telling feature if higher), number of spans restored, and the words that spoke for toxicity."""
    d, f, names, n = found(texts, model.lm, lookup, memo)
    u, first = np.unique(d * (len(model.keys) + 1) + f, return_index=True)
    ud, uf = u // (len(model.keys) + 1), u % (len(model.keys) + 1)
    z = model.bias + (np.bincount(ud, weights=model.weights[uf], minlength=len(texts)) if len(u) else np.zeros(len(texts)))
    sure = np.zeros(len(texts))
    np.maximum.at(sure, ud, np.where(model.alone[uf] >= ALONE, model.alone[uf], 0.0))
    terms: list[set[str]] = [set() for _ in range(len(texts))]
    for x, i, j in zip(ud.tolist(), uf.tolist(), first.tolist()):
        if model.weights[i] > 0 or model.alone[i] >= ALONE:
            terms[x].add(names[j])
    return np.maximum(1 / (1 + np.exp(-z)), sure), n, [sorted(t) for t in terms]


def toxic_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, n_restored, terms) of each row whose toxicity is at least the threshold.

    Every row is judged for itself on its whole text, repeated rows alike; a null or empty text has no features and is not
    toxic unless the threshold is below the bias; a null doc_id is kept as null; other columns are not read; an empty table
    gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, memo = vec.Lookup(model.keys, 16), {}
        for batch in batches:
            for part in vec.slices(batch, "text"):
                score, n, terms = judge(part.column(1), model, lookup, memo)
                at = np.flatnonzero(score >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at)), pa.array(score[at]), pa.array(n[at].astype(np.int64)), pa.array([terms[i] for i in at], pa.list_(pa.string()))], names=["doc_id", "score", "n_restored", "terms"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, n_restored long, terms array<string>")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that toxic_documents does not list; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, memo = vec.Lookup(model.keys, 16), {}
        for batch in batches:
            for part in vec.slices(batch, "text"):
                score, _, _ = judge(part.column(part.schema.get_field_index("text")), model, lookup, memo)
                yield part.filter(pa.array(score < threshold))

    return docs.mapInArrow(run, docs.schema)
