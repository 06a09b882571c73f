"""Language identification by averaged hashed subword embeddings with a linear softmax.

Subwords are the runs of 2, 3 and 4 bytes of the lower-cased UTF-8 text, white space as one blank and
digits alike, hashed to BUCKETS rows of an embedding table. A text's vector is the average over all its
subwords; a linear layer and a softmax follow. Both layers are trained by stochastic gradient descent in
numpy, on pieces of PIECE bytes of the sampled texts so that short texts are learned too. A
temperature and a rejection limit are fitted on a fifth of the sample that training leaves out: below the
limit, `rejected` is true, while lang_pred stays the best guess.

Learning sees at most SAMPLE labelled rows, of those whose crc32(doc_id) mod 5 is not 0: each language has
the same share, what rare ones leave of theirs goes to the others, and in a language the rows are the least
by a hash of doc_id and text. Of SAMPLE_BYTES of text each language has an equal part; a text that doesn't
fit into what is left of it is passed over. Of the training texts every piece is learned if there are at most PIECES; else the
languages share PIECES in the same way, and so do the texts of a language, whose pieces are drawn at random.
Every language keeps a row, and every text a piece. lang, source and doc_id are never inputs of a prediction.

Scale: the model (BUCKETS x languages numbers, as the two layers fold into one table) is broadcast; texts
are read once more for prediction, without a shuffle. All work on a text is done in slices.

Edge cases: a null text, or one without a letter, gives `und` with score 0; an empty table, or one without
labels to learn from, gives `und` for every row; rows are independent; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import bounded_batches, read

SAMPLE = 3000
SAMPLE_BYTES = 32 << 20
BUCKETS = 1 << 15
DIM = 16
PIECE = 400
PIECES = 8 * SAMPLE
LENGTHS = (2, 3, 4)
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[48:58] = 48
_MAP[[9, 10, 11, 12, 13]] = 32
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def subwords(raw: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the n bytes from each place on."""
    b = _MAP[raw].astype(np.uint32) + 1
    m = max(0, len(b) - n + 1)
    h = np.full(m, n, np.uint32)
    for j in range(n):
        h += b[j : j + m] * _FACTORS[j]
        h ^= h >> 15
        h *= np.uint32(0x2C1B3C6D)
    return (h >> 17).astype(np.int64) & (BUCKETS - 1)


def sums(table: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the table's rows over each text's subwords, their number)."""
    texts = len(offsets) - 1
    total, count = np.zeros((texts, table.shape[1])), np.zeros(texts, np.int64)
    for n in LENGTHS:
        rows = np.maximum(np.diff(offsets) - n + 1, 0)
        some = np.flatnonzero(rows)
        if not len(some):
            continue
        at = subwords(raw, n)
        owner_start, owner_end = offsets[some], offsets[some] + rows[some]
        for k in range(table.shape[1]):
            run = np.concatenate([[0.0], np.cumsum(table[at, k], dtype=np.float64)])
            total[some, k] += run[owner_end] - run[owner_start]
        count += rows
    return total, count


def pieces(text: str) -> list[bytes]:
    raw = text.encode()
    return [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]


def share(sizes: Iterable[int], most: int) -> int:
    """The largest part that each may have, so that all have at most `most` together; 1 at least."""
    sizes = sorted(sizes)
    for i, n in enumerate(sizes):
        part = most // (len(sizes) - i)
        if n > part:
            return max(1, part)
        most -= n
    return max(sizes, default=1)


def bounded(train: list[tuple[bytes, int, int]], most: int) -> list[tuple[bytes, int, int]]:
    """The (piece, language, text) to learn from: all, or `most` shared by the languages and then by the texts of each."""
    texts: dict[int, Counter] = {}
    for _, y, i in train:
        texts.setdefault(y, Counter())[i] += 1
    part = share((c.total() for c in texts.values()), most)
    of_text = {y: share(c.values(), min(part, c.total())) for y, c in texts.items()}
    out, seen = [], Counter()
    for p, y, i in train:
        seen[i] += 1
        if seen[i] <= of_text[y]:
            out.append((p, y, i))
    return out


class Model:
    """langs, and the folded table: a text's logits are the bias plus the average of its subwords' rows."""

    def __init__(self, texts: list[str], langs: list[str], seed: int = 11):
        self.langs = sorted(set(langs))
        k, rng = len(self.langs), np.random.default_rng(seed)
        self.temperature, self.limit = 1.0, 0.0
        self.table, self.bias = np.zeros((BUCKETS, max(k, 1)), np.float32), np.zeros(max(k, 1))
        if not k:
            return
        y_of = {lang: i for i, lang in enumerate(self.langs)}
        train = [(p, y_of[lang], i) for i, (t, lang) in enumerate(zip(texts, langs, strict=True)) if i % 5 for p in pieces(t)]
        check = [(t.encode(), y_of[lang]) for i, (t, lang) in enumerate(zip(texts, langs, strict=True)) if i % 5 == 0]
        rng.shuffle(train)
        train = bounded(train, PIECES)
        embed, weight, bias = rng.uniform(-0.5, 0.5, (BUCKETS, DIM)) / DIM, np.zeros((DIM, k)), np.zeros(k)
        data = []
        for p, y, _ in train:
            raw = np.frombuffer(p, np.uint8)
            at = np.concatenate([subwords(raw, n) for n in LENGTHS])
            if len(at):
                rows, c = np.unique(at, return_counts=True)
                data.append((rows, (c / len(at))[:, None], y))
        epochs = 3 if len(data) > 4000 else max(3, 12000 // max(1, len(data)))
        for epoch in range(epochs):
            rate = 0.5 * (1 - epoch / epochs)
            for i in rng.permutation(len(data)):
                rows, c, y = data[i]
                v = (embed[rows] * c).sum(0)
                z = v @ weight + bias
                g = np.exp(z - z.max())
                g /= g.sum()
                g[y] -= 1
                step = weight @ g
                weight = np.clip(weight - rate * np.outer(v, g), -10, 10)
                bias -= 0.1 * rate * g
                embed[rows] -= (rate * 20) * c * np.clip(step, -5, 5)
        self.table, self.bias = (embed @ weight).astype(np.float32), bias
        if check:
            self.calibrate([t for t, _ in check], np.array([y for _, y in check]))

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        total, count = sums(self.table, raw, offsets)
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = self.logits(raw, offsets) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def calibrate(self, texts: list[bytes], y: np.ndarray) -> None:
        """Temperature by the likelihood of the texts left out; the limit keeps their errors below 1 % of what is accepted."""
        raw, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        z = self.logits(raw, offsets)

        doubt = 1 / (len(y) + 2)  # as if one more text were of any language: a sample without errors doesn't claim certainty

        def loss(t: float) -> float:
            s = z / t
            s = s - s.max(1, keepdims=True)
            s -= np.log(np.exp(s).sum(1, keepdims=True))
            return float(-((1 - doubt) * s[np.arange(len(y)), y] + doubt * s.mean(1)).mean())

        self.temperature = float(min(np.geomspace(0.02, 20, 60), key=loss))
        p = self.probabilities(raw, offsets)
        order = np.argsort(-p.max(1))
        wrong = np.cumsum((p.argmax(1) != y)[order])
        fine = np.flatnonzero(wrong <= 0.01 * np.arange(1, len(y) + 1))
        self.limit = float(p.max(1)[order][fine[-1]]) if len(fine) else 1.0

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        raw, offsets = _words.buffers(column)
        lang, score = np.full(len(column), "und", object), np.zeros(len(column))
        for i, j in _words.slices(offsets):
            part, cut = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[part])])
            letters = seen[cut[1:]] > seen[cut[:-1]]
            for x in np.flatnonzero(~letters):
                letters[x] = any(c.isalpha() for c in part[cut[x] : cut[x + 1]].tobytes().decode())
            if not self.langs or not letters.any():
                continue
            p = self.probabilities(part, cut)
            lang[i:j] = np.where(letters, np.array(self.langs, object)[p.argmax(1)], "und")
            score[i:j] = np.where(letters, p.max(1), 0)
        return lang.tolist(), score


def sampled(rows: DataFrame, sample: int, most: int = SAMPLE_BYTES) -> list:
    """At most `sample` of the rows (doc_id, text, lang), shared by the languages, and `most` bytes of their texts, on the
    driver. Counts come first, so that the executors send about 1.5 times that between them, however many tasks there
    are; then sizes, then the chosen texts. Rows that repeat doc_id and text count as one."""
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    part = share(counts.values(), sample)
    rows = rows.withColumn("h", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(5)))
    limits = {lang: int((1.5 * part + 20) / n * (1 << 31)) for lang, n in counts.items() if n > 2 * part + 40}
    if limits:
        limit = F.create_map(*[F.lit(v) for kv in limits.items() for v in kv])[F.col("lang")]
        rows = rows.where(F.pmod("h", F.lit(1 << 31)) < F.coalesce(limit, F.lit(1 << 31)))
    chosen, seen, left = [], Counter(), Counter({lang: most // max(1, len(counts)) for lang in counts})
    for r in sorted(rows.groupBy("lang", "h").agg(F.first(F.octet_length("text")).alias("size")).collect(), key=lambda r: (r["h"] % (1 << 31), r["h"], r["lang"])):
        if seen[r["lang"]] < part and r["size"] <= left[r["lang"]]:
            seen[r["lang"]] += 1
            left[r["lang"]] -= r["size"]
            chosen.append((r["lang"], r["h"]))
    if not chosen:
        return []
    wanted = F.broadcast(rows.sparkSession.createDataFrame(chosen, "lang string, h long"))  # at most `sample` rows
    found = rows.join(wanted, ["lang", "h"]).groupBy("lang", "h").agg(F.first("text").alias("text")).collect()
    return sorted(found, key=lambda r: (r["h"] % (1 << 31), r["h"], r["lang"]))


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows outside the held-out fold."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    found = sampled(rows, sample)
    return Model([r.text for r in found], [r.lang for r in found])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lang, score = shared.value.predict(x.column(2))
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(score < shared.value.limit)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of documents and predicts all of them."""
    docs = read(spark, sf_dir, "documents")
    return identify(docs, train(docs))
