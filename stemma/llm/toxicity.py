"""Toxicity by a lexicon whose misspellings Levenshtein automata catch, and windows of context.

Words are runs of letters and digits, in lower case. The lexicon is learned: words, and beginnings of
words, whose share of toxic documents is far above chance, the TERMS clearest at most. Its trie is
intersected with the Levenshtein automaton of one edit (words of FUZZY letters or more, the first letter
kept) into one deterministic automaton, which reads all words of a slice side by side. Words one edit from
a term that clean sampled documents use are exceptions.

A hit is a quotation where its window of context opens a quotation before it and closes one after it, within
WINDOW words. A document's features are the weights of its hits, their number and density, by whole words
and by beginnings, and the weights of its quoted hits apart; a logistic model in numpy weighs them. So that
it can tell quotation from abuse, it also learns from QUOTED sampled toxic texts whose hits were put into
quotation marks, as clean ones.

Learning sees at most SAMPLE labelled rows of either class, the least by a hash of doc_id, of those whose
crc32(doc_id) mod 5 is not 0, and SAMPLE_BYTES of their texts: in that order, a text that doesn't fit into
what its class has left is passed over. labels, lang, source and doc_id are never inputs of a score.

Scale: the automaton and the model are broadcast; texts are read once more for scoring, without a shuffle,
in slices. Learning is one task, which holds the sampled texts and an integer for each of their words.

Edge cases: a null or empty text has no hits and gets the score of that; an empty table gives an empty
result; without labels of both classes every score is 0; several labels of a document count as toxic if
any does; of several texts of a doc_id the one with the least digest is learned; rows are independent;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import bounded_batches, read
from .language_id import held_out
from .token_count import classes

SAMPLE = 2000
SAMPLE_BYTES = 32 << 20
TERMS = 1000
QUOTED = 300
FUZZY = 5
WINDOW = 6
BEGINNINGS = range(4, 10)
#: Standard deviations above chance, least documents and least share of the toxic ones, for a term.
LEAST_Z, LEAST_DOCS, LEAST_SHARE = 6.0, 4, 0.01
#: Marks that open and that close a quotation, and pairs of them.
_OPEN = np.array([0x22, 0x60, 0xAB, 0xBB, 0x2018, 0x201A, 0x201C, 0x201D, 0x201E], np.uint32)
_CLOSE = np.array([0x22, 0x60, 0xAB, 0xBB, 0x2018, 0x2019, 0x201C, 0x201D], np.uint32)
_PAIRS = ('""', "\u201c\u201d", "\u2018\u2019", "\u00ab\u00bb", "\u201e\u201c")


@lru_cache(1)
def lower_table() -> np.ndarray:
    """The lower case of each code point, where that is one code point."""
    out = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        if not 0xD800 <= c < 0xE000 and len(low := chr(c).lower()) == 1:
            out[c] = ord(low)
    return out


def words(data: bytes, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code points in lower case, start and end of each word, text of each word, start of each text and the end)."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    edges = np.searchsorted(np.concatenate([[0], np.cumsum(width)]), cut)
    inside = classes()[points] <= 1
    n = len(points)
    edge = np.zeros(n + 1, bool)
    edge[edges] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end[:-1] &= ~inside[1:] | edge[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return lower_table()[points], s, e, np.searchsorted(edges, s, side="right") - 1, edges


class Automaton:
    """A deterministic automaton over a trie of whole words (also with one edit) and beginnings of words."""

    def __init__(self, whole: list[str], beginnings: list[str], exceptions: frozenset[str] = frozenset()):
        self.whole, self.beginnings, self.exceptions = whole, beginnings, exceptions
        child: list[dict[str, int]] = [{}]
        ends, opens, deep = {}, {}, {}

        def add(text: str) -> list[int]:
            path = [0]
            for c in text:
                if c not in child[path[-1]]:
                    child[path[-1]][c] = len(child)
                    child.append({})
                path.append(child[path[-1]][c])
            return path

        for i, t in enumerate(whole):
            path = add(t)
            ends[path[-1]] = i
            if len(t) >= FUZZY:
                for x in path[1:]:
                    deep[x] = True  # on the way to a word that may have an edit
        for i, t in enumerate(beginnings):
            opens[add(t)[-1]] = i
        letters = sorted({c for t in whole + beginnings for c in t})
        self.column = np.zeros(0x110000, np.uint8 if len(letters) < 255 else np.int32)
        for i, c in enumerate(letters):
            self.column[ord(c)] = i + 1

        def close(states: set[tuple[int, int]]) -> frozenset:
            exact = {n for n, e in states if not e}
            for n, e in list(states):
                if not e and n and n in deep:
                    states |= {(c, 1) for c in child[n].values() if c in deep}
            return frozenset((n, e) for n, e in states if not (e and n in exact))

        first = (frozenset({(0, 0)}), -1)
        ids, todo = {(frozenset(), -1): 0, first: 1}, [first]
        rows: dict[int, list[int]] = {0: [0] * (len(letters) + 1)}
        while todo:
            state = todo.pop()
            here, opened = state
            row = []
            for c in [None, *letters]:
                new: set[tuple[int, int]] = set()
                for n, e in here:
                    if c is not None and c in child[n] and (not e or child[n][c] in deep):
                        new.add((child[n][c], e))
                    if not e and n and n in deep:
                        new.add((n, 1))
                        new |= {(x, 1) for x in child[n].values() if x in deep}
                now = opened
                for n, e in new:
                    if not e and n in opens and now < 0:
                        now = opens[n]
                key = (close(new), now)
                if key not in ids:
                    ids[key] = len(ids)
                    todo.append(key)
                row.append(ids[key])
            rows[ids[state]] = row
        self.start = 1
        self.table = np.array([rows[i] for i in range(len(ids))], np.int32)
        hit = lambda here, e: next((ends[n] for n, x in here if x == e and n in ends and (not e or len(whole[ends[n]]) >= FUZZY)), -1)
        keys = sorted(ids, key=ids.get)
        self.exact = np.array([hit(k[0], 0) for k in keys], np.int32)
        self.near = np.array([hit(k[0], 1) for k in keys], np.int32)
        self.opened = np.array([k[1] for k in keys], np.int32)

    def run(self, points: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word, term, kind) of each hit; kind 0: a whole word, 1: with an edit, 2: a beginning."""
        at = np.flatnonzero(end > start)
        state = np.full(len(at), self.start, np.int32)
        words_, terms, kinds = [], [], []
        p = 0
        while len(at):
            state = self.table[state, self.column[points[start[at] + p]]]
            p += 1
            done = end[at] - start[at] == p
            if done.any():
                s, w = state[done], at[done]
                for kind, found in ((0, self.exact[s]), (1, np.where(self.exact[s] < 0, self.near[s], -1)), (2, np.where((self.exact[s] < 0) & (self.near[s] < 0), self.opened[s], -1))):
                    ok = found >= 0
                    words_.append(w[ok])
                    terms.append(found[ok])
                    kinds.append(np.full(ok.sum(), kind))
            go = ~done & (state > 0)
            at, state = at[go], state[go]
        if not words_:
            return (np.zeros(0, np.int64),) * 3
        w, t, k = np.concatenate(words_), np.concatenate(terms), np.concatenate(kinds)
        if self.exceptions and len(w):
            spelled = lambda i: "".join(map(chr, points[start[i] : end[i]]))
            ok = np.array([k_ != 1 or spelled(i) not in self.exceptions for i, k_ in zip(w, k, strict=True)], bool)
            w, t, k = w[ok], t[ok], k[ok]
        order = np.argsort(w, kind="stable")
        return w[order], t[order], k[order]


class Bags:
    """The words of sampled texts as numbers, one after another, with the text of each."""

    def __init__(self, texts: list[str]):
        number: dict[str, int] = {}
        parts = []
        for t in texts:
            data = t.encode(errors="replace")
            points, s, e, *_ = words(data, np.array([0, len(data)])) if data else (np.zeros(0, np.uint32),) * 5
            joined = points.astype("<u4").tobytes().decode("utf-32-le")
            parts.append(np.fromiter((number.setdefault(joined[i:j], len(number)) for i, j in zip(s.tolist(), e.tolist(), strict=True)), np.int32, len(s)))
        self.words = list(number)
        self.at = np.concatenate([*parts, np.zeros(0, np.int32)])
        self.text = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])

    def shares(self, of: np.ndarray, n: int, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(clean, toxic) texts of each of n terms, where of has the term of each word, or -1."""
        term = of[self.at]
        pair = np.unique(self.text[term >= 0].astype(np.int64) * n + term[term >= 0])
        own = toxic[pair // n] > 0
        return np.bincount(pair[~own] % n, minlength=n), np.bincount(pair[own] % n, minlength=n)

    def beginnings(self, length: int) -> tuple[np.ndarray, list[str]]:
        """(the beginning of each longer word, or -1; their spellings)."""
        number: dict[str, int] = {}
        of = np.fromiter((number.setdefault(w[:length], len(number)) if len(w) > length else -1 for w in self.words), np.int32, len(self.words))
        return of, list(number)


def learn_terms(bags: Bags, toxic: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """(whole words, beginnings) with their weights: log ratios of the shares of toxic and clean documents.

    A term needs LEAST_DOCS toxic documents, or LEAST_SHARE of them, and as many different neighbours, so that words of one text
    that was copied often don't count; a beginning needs as many different words.
    """
    total = np.bincount(toxic, minlength=2)
    least = max(LEAST_DOCS, LEAST_SHARE * total[1])
    far = lambda tox, clean: (tox - (e := total[1] * (clean + 1) / (total[0] + 2))) / np.sqrt(np.maximum(e, 0.05))
    rate = lambda n, k: (n + 0.5) / (total[k] + 1)
    v = len(bags.words)
    first = np.concatenate([[True], bags.text[1:] != bags.text[:-1]]) if len(bags.at) else np.zeros(0, bool)
    before, after = np.roll(bags.at, 1).astype(np.int64), np.roll(bags.at, -1).astype(np.int64)
    before[first], after[np.roll(first, -1)] = v, v
    context = before * (v + 1) + after
    own = toxic[bags.text] > 0
    found: list[tuple[float, str, bool, float]] = []
    for length in (0, *BEGINNINGS):
        of, spelled = bags.beginnings(length) if length else (np.arange(v, dtype=np.int32), bags.words)
        if not spelled:
            continue
        clean, tox = bags.shares(of, len(spelled), toxic)
        likely = np.flatnonzero((tox >= least) & (far(tox, clean) >= LEAST_Z))
        term = of[bags.at]
        for t in likely.tolist():
            if len(spelled[t]) < 3:
                continue
            here = np.flatnonzero((term == t) & own)
            n = min(int(tox[t]), len(np.unique(context[here])))
            if n >= least and far(n, clean[t]) >= LEAST_Z and (not length or len(np.unique(bags.at[here])) >= LEAST_DOCS):
                found.append((float(far(n, clean[t])), spelled[t], bool(length), float(np.log(rate(n, 1)) - np.log(rate(clean[t], 0)))))
    chosen: list[tuple[str, bool, float]] = []
    for _, stem, begins, weight in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
        if len(chosen) < TERMS and not any(b and (stem.startswith(o) or (begins and o.startswith(stem))) for o, b, _ in chosen):
            chosen.append((stem, begins, weight))
    return {t: w for t, b, w in chosen if not b}, {t: w for t, b, w in chosen if b}


class Model:
    def __init__(self, texts: list[str], toxic: list[int]):
        self.ready = len(set(toxic)) == 2
        self.automaton, self.weight = Automaton([], []), (np.zeros(0), np.zeros(0))
        if not self.ready:
            return
        y = np.array(toxic, np.int64)
        bags = Bags(texts)
        whole, begin = learn_terms(bags, y)
        clean = np.unique(bags.at[y[bags.text] == 0])
        clean_words = [bags.words[i] for i in clean]
        del bags
        self.weight = (np.array(list(whole.values())), np.array(list(begin.values())))
        self.automaton = Automaton(list(whole), list(begin))
        # words of clean texts that are one edit from a term
        points = np.frombuffer("".join(clean_words).encode("utf-32-le"), np.uint32)
        end = np.cumsum([len(w) for w in clean_words])
        near, _, kind = self.automaton.run(points, end - [len(w) for w in clean_words], end) if clean_words else (np.zeros(0, np.int64),) * 3
        self.automaton.exceptions = frozenset(clean_words[i] for i in near[kind == 1])
        quoted = [q for t, k in zip(texts, toxic, strict=True) if k for q in [self.quotation(t, len(t) % len(_PAIRS))] if q != t][:QUOTED]
        x = np.concatenate([self.features(pa.array(texts, pa.large_string())), self.features(pa.array(quoted, pa.large_string()))])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        # sampling takes each class on its own; one to three holds clean documents harder, and so do quotations, together one fourth
        share = np.concatenate([np.where(y == 1, 0.25 / y.sum(), 0.5 / (1 - y).sum()), np.full(len(quoted), 0.25 / max(len(quoted), 1))])
        self.fit((x - self.mean) / self.scale, np.concatenate([y, np.zeros(len(quoted))]), share / share.sum())

    def quotation(self, text: str, style: int) -> str:
        """text with all its hits between quotation marks: alone, or with the next words of their window."""
        data = text.encode(errors="replace")
        points, s, e, *_ = words(data, np.array([0, len(data)])) if data else (np.zeros(0, np.uint32),) * 5
        hits = np.unique(self.automaton.run(points, s, e)[0]) if len(s) else []
        out, at, opens = [], 0, _PAIRS[style]
        for n, w in enumerate(hits):
            lo, hi = (w, w) if n % 2 else (max(w - 2, 0), min(w + 2, len(s) - 1))
            if s[lo] < at:
                lo = w
            if s[w] >= at:
                out += [text[at : s[lo]], opens[0], text[s[lo] : e[hi]], opens[1]]
                at = e[hi]
        return "".join([*out, text[at:]])

    def fit(self, x: np.ndarray, y: np.ndarray, share: np.ndarray, steps: int = 3000) -> None:
        self.w, self.b = np.zeros(x.shape[1]), 0.0
        for i in range(steps):
            g = (1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30))) - y) * share
            rate = 2.0 / (1 + i / 500)
            self.w = np.maximum(self.w - rate * (x.T @ g + 1e-4 * self.w), 0)  # a hit never speaks for a text
            self.b -= rate * g.sum()

    def features(self, column: pa.Array) -> np.ndarray:
        """A row for each text."""
        raw, offsets = _words.buffers(column)
        out = np.zeros((len(column), 8))
        for i, j in _words.slices(offsets):
            part, cut = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                continue
            points, start, end, text, edges = words(part.tobytes(), cut)
            n = np.bincount(text, minlength=j - i)
            w, term, kind = self.automaton.run(points, start, end)
            if not len(w):
                continue
            value = np.where(kind == 2, 0.0, np.where(kind == 1, 0.9, 1.0))
            value[kind < 2] *= self.weight[0][term[kind < 2]]
            value[kind == 2] = self.weight[1][term[kind == 2]]
            owner, whole, quoted = text[w], kind < 2, self.quoted(points, start, end, text, w, edges)
            own = lambda mask, v: np.bincount(owner[mask], v[mask], minlength=j - i)  # noqa: B023, E731
            size = np.maximum(n, 1)
            a, b = own(whole & ~quoted, value), own(~whole & ~quoted, value)
            plain = [np.log1p(a), a > 0, a / np.sqrt(size), np.log1p(b), np.log1p(own(~whole & ~quoted, np.ones(len(w)))), np.minimum(10 * b / size, 3)]
            out[i:j] = np.stack([*plain, np.log1p(own(whole & quoted, value)), np.log1p(own(~whole & quoted, value))], 1)
        return out

    def quoted(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, text: np.ndarray, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Whether each word of w stands in quotation: opened before it and closed after it, within WINDOW words of its text.
        An opening mark doesn't follow a letter or digit, a closing one isn't followed by one: apostrophes are neither."""
        inside = classes()[points] <= 1
        ahead, behind = np.append(inside[1:], False), np.concatenate([[False], inside[:-1]])
        ahead[edges[1:][edges[1:] > 0] - 1], behind[edges[:-1][edges[:-1] < len(points)]] = False, False
        opens = np.concatenate([[0], np.cumsum(np.isin(points, _OPEN) & ~behind)])
        closes = np.concatenate([[0], np.cumsum(np.isin(points, _CLOSE) & ~ahead)])
        if not opens[-1] or not closes[-1]:
            return np.zeros(len(w), bool)
        last = len(start) - 1
        lo, hi = np.maximum(w - WINDOW, 0), np.minimum(w + WINDOW, last)
        lo, hi = np.maximum(lo, np.searchsorted(text, text[w], side="left")), np.minimum(hi, np.searchsorted(text, text[w], side="right") - 1)
        before = opens[start[w]] - opens[np.maximum(start[lo] - 2, edges[text[w]])]  # a mark and a space
        after = closes[np.minimum(end[hi] + 2, edges[text[w] + 1])] - closes[end[w]]
        return (before > 0) & (after > 0)

    def score(self, column: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(column))
        x = (self.features(column) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(x @ self.w + self.b, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = SAMPLE_BYTES) -> Model:
    """A model from at most `sample` labelled rows of either class outside the held-out fold, and `most` bytes of text."""
    marks = labels.select(F.col("doc_id").alias("_id"), "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("_id"))).groupBy("_id").agg((F.max("toxic") > 0).cast("int").alias("y"))
    order = F.xxhash64(F.col("_id").cast("string"), F.lit(6))
    picked = None
    for y in (0, 1):
        part = marks.where(F.col("y") == y).select("_id", "y", order.alias("h")).orderBy("h", "_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_digest"), "text")
    # at most 2 * sample ids: a proven bound for the broadcast and for what comes back
    sizes = texts.join(F.broadcast(picked), "_id").groupBy("h", "_id", "y").agg(F.min(F.struct("_digest", F.octet_length("text").alias("size"))).alias("least"))
    left, chosen = {0: most // 2, 1: most // 2}, {}
    for r in sorted(sizes.collect(), key=lambda r: (r["h"], r["_id"])):
        if r["least"]["size"] <= left[r["y"]]:
            left[r["y"]] -= r["least"]["size"]
            chosen[r["_id"]] = (r["least"]["_digest"], r["y"])
    if not chosen:
        return Model([], [])
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    wanted = spark.createDataFrame([(i, d, y, k) for k, (i, (d, y)) in enumerate(chosen.items())], f"_id {kind}, _digest long, y int, k int")
    rows = texts.join(F.broadcast(wanted), ["_id", "_digest"]).groupBy("k", "y").agg(F.first("text").alias("text"))
    # one task learns: the bound above holds for its memory, and the driver gets the model alone
    return pickle.loads(rows.repartition(1).mapInArrow(_fit, "model binary").first()["model"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(r for x in batches for r in zip(*(x.column(c).to_pylist() for c in ("k", "y", "text")), strict=True))
    if rows:
        model = Model([t for _, _, t in rows], [y for _, y, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            s = shared.value.score(x.column(2))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """docs without those that score limit or more. No shuffle."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield x.filter(pa.array(shared.value.score(x.column(at)) < limit))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from labels outside the held-out fold and scores all documents."""
    docs = read(spark, sf_dir, "documents")
    return score_toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
