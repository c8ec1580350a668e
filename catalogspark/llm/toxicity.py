"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is. Sentences are scored by a
logistic model over their words and word beginnings; a document's probability is the noisy-or ``1 - prod(1 - p_sentence)``.
The weights are trained from document labels alone, each gradient summed over the partitions of the labelled sample, and
the sentence scores then locate the offending sentences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kernels import NOT_ALNUM, Words, text_chunks
from .tables import drop_stored, stored

#: Rows of each class that the model is fitted on at most, the first in order of a hash of doc_id.
TRAIN_PER_CLASS = 4000
#: A feature has a weight if it is in so many training texts.
MIN_TEXTS = 8
#: Gradient steps, the length of a step, and the tasks that share one.
STEPS, RATE, PARTS = 60, 0.15, 12
#: Toxic texts of the sample weigh as much as the root of how many others there are to each, at most so much.
MOST_WEIGHT = 4.0
#: Pull of each weight to exactly zero, in units of the share of texts that must speak for it, times the root of their
#: number: what chance makes a word say shrinks as the sample grows.
PULL = 0.022
#: Beginnings of words, in bytes, that are features beside whole words: inflected forms share their stem's weight.
PREFIXES = (4, 5, 6)
_BIAS = -4.0
_ENDS = np.zeros(256, bool)
_ENDS[[10, 33, 46, 63]] = True  # line end, exclamation mark, full stop, question mark


class SentenceWords:
    """Words of a chunk with the sentence that each stands in; sentences are numbered through the chunk."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, NOT_ALNUM)
        ends = np.concatenate([[0], np.cumsum(_ENDS[data])])
        row = words.row_of_word()
        mark = ends[words.start] + row  # rises at every end of a sentence and of a text
        new = np.ones(len(mark), bool)
        new[1:] = mark[1:] != mark[:-1]
        self.words, self.new = words, new
        self.sentence = np.cumsum(new) - 1
        self.start, self.end = words.start, words.end
        self.sentence_row = row[new]

    def features(self):
        """(hashes, their sentences), one array pair for each kind of feature."""
        yield self.words.hash, self.sentence
        for n in PREFIXES:
            at, hashes = self.words.prefix_hash(n)
            yield hashes, self.sentence[at]


def _log_not(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))."""
    return -np.logaddexp(0, z)


def _counted(batches):
    """(h, n): in how many texts of a chunk each feature is."""
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column("text")):
            chunk = SentenceWords(data, offsets)
            hashes, sentences = (np.concatenate(x) for x in zip(*chunk.features(), strict=True))
            h, code = np.unique(hashes, return_inverse=True)
            both = np.unique(chunk.sentence_row[sentences] * np.int64(max(len(h), 1)) + code) if len(h) else np.zeros(0, np.int64)
            n = np.bincount(both % max(len(h), 1), minlength=len(h))
            yield pa.record_batch({"h": h.view(np.int64), "n": n.astype(np.int64)})


_CELLS = "labels binary, bags binary, sentences binary, words binary"


def _cells(vocabulary):
    """One row for each chunk of texts: their labels, the text of each sentence, and the distinct (sentence, feature)."""

    def run(batches):
        words = vocabulary.value
        for batch in batches:
            labels = batch.column("toxic").to_numpy()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                chunk = SentenceWords(data, offsets)
                cells = [np.zeros(0, np.int64)]
                for h, own in chunk.features() if len(words) else ():
                    at = np.minimum(np.searchsorted(words, h), len(words) - 1)
                    hit = np.flatnonzero(words[at] == h)
                    cells.append(own[hit] * np.int64(len(words)) + at[hit])
                both = np.unique(np.concatenate(cells))
                parts = (labels[a:b], chunk.sentence_row, both // max(len(words), 1), both % max(len(words), 1))
                yield pa.record_batch({f.split(" ")[0]: pa.array([x.astype(np.int32).tobytes()]) for f, x in zip(_CELLS.split(", "), parts, strict=True)})

    return run


def gradient(labels: np.ndarray, bags: np.ndarray, sentences: np.ndarray, words: np.ndarray, weights: np.ndarray, toxic: float = 1.0) -> np.ndarray:
    """Of minus the noisy-or log likelihood of one chunk, in which toxic texts count ``toxic`` times; ``weights`` end with
    the bias."""
    z = np.bincount(sentences, weights[words], len(bags)) + weights[-1]
    log_none = np.bincount(bags, _log_not(z), len(labels))  # log(1 - P) of each document
    p = -np.expm1(log_none)
    ratio = np.where(labels > 0, -toxic * np.exp(log_none) / np.maximum(p, 1e-6), 1.0)  # d loss / d log-odds mass
    dz = ratio[bags] / (1 + np.exp(-z))
    out = np.bincount(words, dz[sentences], len(weights))
    out[-1] = dz.sum()
    return out


def _gradients(weights, toxic: float):
    """One row for each task: the sum over its chunks, and their texts."""

    def run(batches):
        total, texts = np.zeros(len(weights.value)), 0
        for batch in batches:
            for row in zip(*(batch.column(f.split(" ")[0]).to_pylist() for f in _CELLS.split(", ")), strict=True):
                parts = [np.frombuffer(x, np.int32) for x in row]
                total += gradient(*parts, weights.value, toxic)
                texts += len(parts[0])
        if texts:
            yield pa.record_batch({"g": pa.array([total.tobytes()]), "n": pa.array([texts], pa.int64())})

    return run


def fit(rows: DataFrame) -> NoisyOr:
    """Noisy-or model of ``rows(text, toxic)``: one job for each step, in which each task adds up its own gradient. The
    driver gets PARTS arrays of as many numbers as there are features in MIN_TEXTS texts of the sample."""
    context = rows.sparkSession.sparkContext
    counted = rows.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_TEXTS)
    words = np.sort(counted.select("h").toPandas()["h"].to_numpy(np.int64).view(np.uint64))
    sent = context.broadcast(words)
    cells = stored(rows.mapInArrow(_cells(sent), _CELLS).repartition(PARTS), "cells", "zstd")
    n = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic = float(np.clip(np.sqrt(n.get(0, 0) / max(n.get(1, 0), 1)), 1, MOST_WEIGHT))
    weights = np.append(np.zeros(len(words)), _BIAS)
    m, v = np.zeros(len(weights)), np.zeros(len(weights))
    for step in range(1, STEPS + 1):
        now = context.broadcast(weights)
        parts = cells.mapInArrow(_gradients(now, toxic), "g binary, n long").collect()
        now.unpersist()
        texts = sum(r["n"] for r in parts)
        if not texts:
            break
        # the same sum whatever order the tasks end in
        grad = np.sum([np.frombuffer(g) for g in sorted(bytes(r["g"]) for r in parts)], 0) / texts
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        rate = RATE / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        weights = weights - rate * m / (1 - 0.9**step)
        weights[:-1] = np.sign(weights[:-1]) * np.maximum(np.abs(weights[:-1]) - rate[:-1] * PULL / np.sqrt(texts), 0)
    drop_stored(cells)
    used = np.flatnonzero(weights[:-1])
    return NoisyOr(words[used], weights[used], float(weights[-1]))


class NoisyOr:
    """The trained model: sorted feature hashes, those of the bounded sample that have a weight, and the bias."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, bias: float):
        self.words, self.weights, self.bias = words, weights, bias

    def sentence_scores(self, chunk: SentenceWords) -> np.ndarray:
        z = np.full(len(chunk.sentence_row), self.bias)
        size = len(self.words)
        for hashes, sentence in chunk.features() if size else ():
            at = np.minimum(np.searchsorted(self.words, hashes), size - 1)
            hit = np.flatnonzero(self.words[at] == hashes)
            cells = np.unique(sentence[hit] * np.int64(size) + at[hit])
            z += np.bincount(cells // size, self.weights[cells % size], len(z))
        return z

    def document_scores(self, chunk: SentenceWords, n: int) -> np.ndarray:
        """Of ``n`` texts; a text without words has no toxic sentence and scores 0."""
        none = np.bincount(chunk.sentence_row, _log_not(self.sentence_scores(chunk)), n) if len(chunk.sentence_row) else np.zeros(n)
        return np.clip(-np.expm1(none), 0.0, 1.0)


def held_out(doc_id):
    """True for the fifth of rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> NoisyOr:
    """Fit on at most ``per_class`` labelled rows of each class outside the held-out fifth.

    Labels: (doc_id, toxic); null labels are left out, of several for one doc_id the highest counts, and of several
    texts of one doc_id the first in order of text; texts that repeat count once. Without rows the model gives every
    sentence the same low score."""
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    marked = marked.where(~held_out(F.col("doc_id")))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.where("toxic = 1").orderBy(*order).limit(per_class).unionByName(marked.where("toxic = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # one text of each doc_id, then one label of each text
    sample = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = sample.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).repartition(PARTS, "text").sortWithinPartitions("text")
    sample = stored(sample, "sample", "zstd")
    model = fit(sample)
    drop_stored(sample)
    return model


def _offending(p: np.ndarray, of: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The sentences (probability ``p``, text ``of``) of 0.5 or more; of texts that reach it only together, those with the
    highest probabilities that reach it."""
    alone = p >= 0.5
    diffuse = scores >= 0.5
    diffuse[of[alone]] = False
    for d in np.flatnonzero(diffuse):
        own = np.flatnonzero(of == d)
        own = own[np.argsort(-p[own], kind="stable")]
        enough = np.flatnonzero(1 - np.cumprod(1 - p[own]) >= 0.5)
        alone[own[: enough[0] + 1 if len(enough) else len(own)]] = True
    return np.flatnonzero(alone)


def score(docs: DataFrame, model: NoisyOr, located: bool = False) -> DataFrame:
    """(doc_id, score) per row of ``docs``; with ``located`` also ``spans``: (begin, end, score) in code points of the
    text, from the first to the last word of each sentence that alone scores 0.5 or more. Where none does, but all
    together, they are the fewest highest ones that together do: every text of 0.5 or more has spans.

    Null and empty texts score 0; repeated rows are scored each; an empty table gives no rows; further columns are
    ignored."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for a, b, data, offsets in text_chunks(batch.column("text")):
                chunk = SentenceWords(data, offsets)
                scores = sent.value.document_scores(chunk, b - a)
                out = {"doc_id": ids.slice(a, b - a), "score": scores}
                if located:
                    p = 1 / (1 + np.exp(-sent.value.sentence_scores(chunk)))
                    first = np.flatnonzero(chunk.new)
                    last = np.append(first[1:], len(chunk.new)) - 1
                    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                    spans: list[list[dict]] = [[] for _ in range(b - a)]
                    for s in _offending(p, chunk.sentence_row, scores):
                        d = int(chunk.sentence_row[s])
                        begin, end = points[chunk.start[first[s]]] - points[offsets[d]], points[chunk.end[last[s]]] - points[offsets[d]]
                        spans[d].append({"begin": int(begin), "end": int(end), "score": float(p[s])})
                    out["spans"] = pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])))
                yield pa.record_batch(out)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double" + ", spans array<struct<begin:long,end:long,score:double>>" * located)


def toxicity(docs: DataFrame, labels: DataFrame, located: bool = True) -> DataFrame:
    """(doc_id, held_out, score, predicted[, spans]) per row of ``docs``: :func:`train`, then :func:`score`; the spans are
    the offending sentences."""
    scored = score(docs, train(docs, labels), located)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), *["spans"] * located
    )
