"""Token counts of byte-level BPE by a finite-state transducer, compiled from the vocabulary.

Pre-tokens (the split that byte-level BPE makes before merging) come from a deterministic pass over
character classes. Inside a pre-token, a prefix's merges always end in one token, the only one that can
follow the token before it: two tokens can be neighbours iff merging their joined bytes gives them back.
So a transducer can read bytes: a state is the longest suffix that begins some token, with the last token
and the relative count at each place where a later token could start; a transition carries the change of
the token count. States and transitions are compiled when first met and kept for the worker's life, up to
MAX_STATES, when those in use are kept and compilation starts anew, also in the middle of a text.

Chunks are the pre-tokens: each resets the state, so its state map is constant, and composing chunk maps
by prefix scan is a segmented sum of their counts. All chunks of a slice run side by side, a byte at a time.
A pre-token of more than CHUNK bytes is cut into chunks that don't reset the state. Their maps are compiled
for the states that chunks before them can end in, all side by side, until the maps compose from the first
chunk to the last; equal chunks share a map, so a text of one letter needs few.

Scale: inside the row, without a shuffle. A longer text than a slice is cut where a single space stands
between ASCII letters or digits, which always ends a pre-token, so memory is bounded by the slice (or the
longest stretch without such a place), MAX_STATES and the chunks of a slice.

Edge cases: a null or empty text has 0 bytes and 0 tokens; special tokens in a text count as one token each,
as the library has it by default; an empty table gives an empty result; every row gets its own result;
other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import _words
from ._common import bounded_batches, read

LIMIT = 512
MAX_STATES = 150_000
#: Bytes of a chunk inside a long pre-token, and chunks that run side by side.
CHUNK, SIDE_BY_SIDE = 2048, 1 << 20
_CUT = re.compile(rb"[0-9A-Za-z] (?=[0-9A-Za-z])")
_LETTER, _NUMBER, _OTHER, _BLANK = range(4)
#: Unicode's White_Space.
_WHITE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[list(_WHITE)] = _BLANK
    return out


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for bytes in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Nothing read.
START = (b"", ((0, b"", 0),))


class Transducer:
    """Counts the tokens of byte strings for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [x["content"].encode() for x in model["added_tokens"] if x["special"]]
        letters = byte_letters()
        code = lambda s: bytes(letters[c] for c in s)
        self.vocab = {code(s) for s in model["model"]["vocab"]}
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["model"]["merges"])
        self.rank = {(code(a), code(b)): i for i, (a, b) in enumerate(pairs)}
        self.begins = {t[:i] for t in self.vocab for i in range(len(t) + 1)}
        self.longest = max(map(len, self.vocab))
        self.column = np.full(256, -1, np.int16)  # of a byte in the table, from its first use on
        self.table = np.zeros((0, 64), np.int32)
        self.reset()

    def reset(self) -> None:
        self.neighbours: dict[tuple[bytes, bytes], bool] = {}
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.table = np.full((1024, self.table.shape[1]), -1, np.int32)  # next state << 8 | change of the count + 128
        self.state_id(START)

    def renewed(self, state: np.ndarray) -> np.ndarray:
        """The given states after a reset."""
        used, place = np.unique(state, return_inverse=True)
        kept = [self.states[i] for i in used]
        self.reset()
        return np.array([self.state_id(x) for x in kept], np.int32)[place]

    def state_id(self, state: tuple) -> int:
        if state not in self.ids:
            self.ids[state] = len(self.states)
            self.states.append(state)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table) // 2, self.table.shape[1]), -1, np.int32)])
        return self.ids[state]

    def merged(self, text: bytes) -> list[bytes]:
        """Byte-pair encoding as defined: the earliest merge first, leftmost of equals."""
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            found = [self.rank.get(x, 1 << 60) for x in zip(parts, parts[1:], strict=False)]
            best = min(found)
            if best == 1 << 60:
                break
            out, i = [], 0
            while i < len(parts):
                both = i < len(found) and found[i] == best
                out.append(parts[i] + parts[i + 1] if both else parts[i])
                i += 1 + both
            parts = out
        return parts

    def can_follow(self, last: bytes, token: bytes) -> bool:
        """Can token come after last (b"" at the start)?"""
        key = (last, token)
        if key not in self.neighbours:
            self.neighbours[key] = self.merged(last + token) == ([last, token] if last else [token])
        return self.neighbours[key]

    def compile(self, state: int, byte: int) -> None:
        """Fill in one transition. A state is (suffix, ((start of a later token, last token before it, count there less the count at the end), ...))."""
        suffix, starts = self.states[state]
        text = suffix + bytes([byte])
        for at, last, count in starts:
            token = text[at:]
            if token in self.vocab and self.can_follow(last, token):
                change = count + 1
                break
        else:
            raise ValueError(f"no token ends after {text!r}")
        end = len(text)
        kept = [(a, t, c - change) for a, t, c in starts if text[a:] in self.begins] + [(end, token, 0)]
        cut = kept[0][0]
        new = self.state_id((text[cut:], tuple((a - cut, t, c) for a, t, c in kept)))
        self.table[state, self.column[byte]] = new << 8 | change + 128

    def run(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of tokens of each pre-token raw[start:end]."""
        count = np.zeros(len(start), np.int64)
        short = np.flatnonzero(end - start <= CHUNK)
        for i in range(0, len(short), SIDE_BY_SIDE):
            rows = short[i : i + SIDE_BY_SIDE]
            count[rows] = self.read(raw, start[rows], end[rows])[0]
        for i in np.flatnonzero(end - start > CHUNK):
            count[i] = self.composed(raw[start[i] : end[i]])
        return count

    def composed(self, raw: np.ndarray) -> int:
        """The number of tokens of one long pre-token, by maps of its chunks."""
        number: dict[bytes, int] = {}
        chunks = [number.setdefault(raw[i : i + CHUNK].tobytes(), len(number)) for i in range(0, len(raw), CHUNK)]
        place = {c: i * CHUNK for i, c in reversed(list(enumerate(chunks)))}
        maps: dict[int, dict[tuple, tuple[int, tuple]]] = {c: {} for c in place}
        todo = {(c, START): None for c in place}
        while todo:
            for i in range(0, len(todo), SIDE_BY_SIDE):
                part = list(todo)[i : i + SIDE_BY_SIDE]
                at = np.array([place[c] for c, _ in part])
                n, ends = self.read(raw, at, np.minimum(at + CHUNK, len(raw)), [s for _, s in part])
                for (c, s), k, e in zip(part, n.tolist(), ends, strict=True):
                    maps[c][s] = (k, self.states[e])
            todo, state, total = {}, START, 0
            for c in chunks:
                if state not in maps[c]:
                    todo[c, state] = None
                    state = next(reversed(maps[c].values()))[1]  # a guess at where it will end
                else:
                    k, state = maps[c][state]
                    total += k
        return total

    def read(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray, states: list[tuple] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(change of the count, last state) of each raw[start:end], read side by side from the given states."""
        for byte in np.flatnonzero(np.bincount(raw, minlength=256) * (self.column < 0)):
            self.column[byte] = self.column.max() + 1
            if self.column[byte] == self.table.shape[1]:
                self.table = np.concatenate([self.table, np.full((len(self.table), 64), -1, np.int32)], 1)
        order = np.argsort(start - end, kind="stable")  # the longest first
        length = (end - start)[order]
        at, state = start[order], np.zeros(len(start), np.int32) if states is None else np.array([self.state_id(x) for x in states], np.int32)[order]
        n, p = int(np.searchsorted(-length, 0, side="left")), 0
        total = np.zeros(len(start), np.int32)
        while n:
            if len(self.states) > MAX_STATES + len(state):
                state = self.renewed(state)
            byte = raw[at[:n] + p]
            now = state[:n]
            new = self.table[now, self.column[byte]]
            if (missing := new < 0).any():
                for key in np.unique(now[missing].astype(np.int64) << 8 | byte[missing]).tolist():
                    self.compile(key >> 8, key & 255)
                new = self.table[now, self.column[byte]]
            total[:n] += (new & 255) - 128
            state[:n] = new >> 8
            p += 1
            n = int(np.searchsorted(-length, -p, side="left"))
        count, last = np.zeros(len(start), np.int64), np.zeros(len(start), np.int32)
        count[order], last[order] = total, state
        return count, last

    def counts(self, column: pa.Array) -> np.ndarray:
        """The number of tokens of each text."""
        raw, offsets = _words.buffers(column)
        offsets, owner = parts(raw, offsets)
        return np.bincount(owner, self.part_counts(raw, offsets), len(column)).astype(np.int64) if len(owner) else np.zeros(len(column), np.int64)

    def part_counts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for i, j in _words.slices(offsets):
            part, cut = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            if not len(part):
                continue
            edges, more = cut, np.zeros(j - i, np.int64)
            data = part.tobytes()
            drop = []
            for s in self.special:
                at = data.find(s)
                while at >= 0:
                    doc = int(np.searchsorted(cut, at, side="right")) - 1
                    if at + len(s) <= cut[doc + 1]:
                        drop.append((at, at + len(s)))
                        more[doc] += 1
                    at = data.find(s, at + len(s))
            if drop:
                edges = np.unique(np.concatenate([cut, np.array(drop).ravel()]))
            start, end = pretokens(data, edges)
            if drop:
                lo, hi = np.array(sorted(drop)).T
                near = np.searchsorted(lo, start, side="right") - 1
                inside = (near >= 0) & (start < hi[near])
                start, end = start[~inside], end[~inside]
            owner = np.searchsorted(cut, start, side="right") - 1
            out[i:j] = more + np.bincount(owner, self.run(part, start, end), j - i).astype(np.int64)
        return out


def parts(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of the parts of all texts, the text of each part): texts longer than a slice are cut where a pre-token ends."""
    cuts, owner = [0], []
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        if hi - lo > _words.SLICE:
            data = raw[lo:hi].tobytes()
            at = 0
            while m := _CUT.search(data, at + _words.SLICE):
                at = m.start() + 1
                cuts.append(lo + at)
                owner.append(i)
        cuts.append(hi)
        owner.append(i)
    return np.array(cuts, np.int64), np.array(owner, np.int64)


def pretokens(data: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte ranges of the pre-tokens of UTF-8 text, where a new text begins at each edge."""
    points = np.frombuffer(data.decode().encode("utf-32-le"), np.uint32)
    n = len(points)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    place = np.concatenate([[0], np.cumsum(width)])
    kind = classes()[points]
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, edges)] = True
    edge[0] = edge[n] = True
    begin = edge[:n].copy()
    begin[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(begin)
    stop = np.append(run[1:], n)
    blank = kind[run] == _BLANK
    # white space before other text: its last character goes on its own or, if it's a space, with what follows
    before = blank & ~edge[stop]
    last = stop[before] - 1
    begin[last] = True
    joined = last[points[last] == 32] + 1
    begin[joined] = False
    # an apostrophe on its own before one of the endings takes that ending
    lone = (kind[run] == _OTHER) & (points[run] == 39) & (stop - run == 1) & ~edge[stop]
    lone &= (run == 0) | edge[run] | (points[np.maximum(run - 1, 0)] != 32)
    for i in run[lone]:
        if kind[i + 1] != _LETTER:
            continue
        for c in _CONTRACTIONS:
            if i + 1 + len(c) <= n and all(points[i + 1 + k] == ord(x) and (k == 0 or not edge[i + 1 + k]) for k, x in enumerate(c)):
                begin[i + 1] = False
                if i + 1 + len(c) < n:
                    begin[i + 1 + len(c)] |= kind[i + 1 + len(c)] == _LETTER
                break
    start = np.flatnonzero(begin)
    return place[start], place[np.append(start[1:], n)]


@lru_cache(4)
def transducer(path: str | None = None) -> Transducer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Transducer(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. path: the vocabulary file on every executor; by default the installed one."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for x in batches:
            size = np.diff(_words.buffers(x.column(1))[1])
            n = machine.counts(x.column(1))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents; see token_counts."""
    return token_counts(read(spark, sf_dir, "documents"))
