"""Quality classifier: a linear-chain conditional random field labels every line good or bad.

A line's score is linear in its own features and those of the lines before and after it; a transition matrix ties
neighbouring labels. Forward-backward gives every line's marginal, and a document's quality is the marginals' mean
weighted by line length. Training maximises the likelihood of document labels spread over their lines.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from loomtab.llm.common import crc_mod, documents, joined, query, record, texts
from loomtab.llm.wordblocks import SPACED, Texts, code_points_before, lines_of, run_hashes, slices, word_hashes, words_of
from loomtab.session import load

FEATURES = 14
MAX_DOCS = 4000


def _byte_mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_UPPER, _DIGIT = _byte_mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _byte_mask("0123456789")
_LETTER = _byte_mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | (np.arange(256) >= 128)
_MARKS, _SYMBOLS, _SPACE = _byte_mask(".,;:'\"?()-"), _byte_mask("!#$%&*+/<=>@[\\]^_`{|}~"), ~SPACED


def line_features(text: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features in [0, 1], owner, length in code points) of every line of a slice."""
    start, end, owner = lines_of(text)
    size = np.maximum(end - start, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask[text.data])])
        return (total[end] - total[start]) / size

    words = words_of(text)
    low, high = np.searchsorted(words.start, start, "left"), np.searchsorted(words.start, end, "left")
    n = np.maximum(high - low, 1)
    hashes = word_hashes(text, words)
    line = np.repeat(np.arange(len(start)), high - low)
    same = np.zeros(len(hashes) + 1)
    same[1:-1] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    same = np.cumsum(same)
    order = np.lexsort((hashes, line))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (hashes[order][1:] != hashes[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order][fresh], minlength=len(start))
    last = text.data[words.end - 1] if len(words.end) else np.empty(0, np.uint8)
    marked = np.concatenate([[0], np.cumsum(_SYMBOLS[last])])
    key = run_hashes(text, start, end)
    again = np.zeros(len(start))
    again[1:] = (key[1:] == key[:-1]) & (owner[1:] == owner[:-1])
    points = code_points_before(text)
    length = points[end] - points[start]
    columns = [
        np.ones(len(start)), share(_UPPER), share(_DIGIT), share(_LETTER), share(_MARKS), share(_SYMBOLS), share(_SPACE),
        np.minimum(np.log1p(high - low) / 8, 1), np.minimum((end - start) / n / 20, 1), (same[high] - same[low]) / n,
        distinct / n, (marked[high] - marked[low]) / n, again, (high == low).astype(float),
    ]
    return np.stack(columns, axis=1), owner, length


def with_neighbours(own: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it; zeros where there is none."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    same = (owner[1:] == owner[:-1])[:, None]
    before[1:], after[:-1] = own[:-1] * same, own[1:] * same
    return np.concatenate([own, before, after], axis=1)


@dataclass
class Chain:
    """State weights of label 1 against label 0, and the scores of label pairs."""

    weights: np.ndarray
    pairs: np.ndarray

    def marginals(self, score: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(probability of label 1 of every line, expected label pairs), forward and backward over all chains at once."""
        count = np.bincount(owner)[np.unique(owner)] if len(owner) else np.empty(0, np.int64)
        first = np.cumsum(count) - count
        order = np.argsort(-count, kind="stable")
        first, count = first[order], count[order]
        active = np.searchsorted(-count, -np.arange(1, count[0] + 1 if len(count) else 1), "right")  # chains with a t-th line
        emit = np.stack([np.ones_like(score), np.exp(np.clip(score, -30, 30))], axis=1)
        move = np.exp(self.pairs)
        ahead, back = emit.copy(), np.ones_like(emit)
        ahead /= ahead.sum(axis=1, keepdims=True)
        for t in range(1, len(active)):
            at = first[: active[t]] + t
            x = (ahead[at - 1] @ move) * emit[at]
            ahead[at] = x / x.sum(axis=1, keepdims=True)
        expected = np.zeros((2, 2))
        for t in range(len(active) - 1, 0, -1):
            at = first[: active[t]] + t
            y = emit[at] * back[at]
            z = ahead[at - 1][:, :, None] * move * y[:, None, :]
            expected += (z / z.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            x = y @ move.T
            back[at - 1] = x / x.sum(axis=1, keepdims=True)
        both = ahead * back
        return both[:, 1] / both.sum(axis=1), expected


def fit_chain(own: np.ndarray, owner: np.ndarray, label: np.ndarray, rounds: int = 150, rate: float = 0.5, ridge: float = 1e-5) -> Chain:
    """Gradient ascent (Adam) on the mean log-likelihood of the lines; ``label`` is by line."""
    x = with_neighbours(own, owner)
    chain = Chain(np.zeros(x.shape[1]), np.zeros((2, 2)))
    if not len(x):
        return chain
    joint = owner[1:] == owner[:-1]
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][joint], label[1:][joint]), 1.0)
    theta, m, v = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for t in range(1, rounds + 1):
        p, expected = chain.marginals(x @ chain.weights, owner)
        grad = np.concatenate([x.T @ (label - p), (seen - expected).ravel()]) / len(x) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        chain = Chain(theta[:-4], theta[-4:].reshape(2, 2))
    return chain


def training_lines(docs: DataFrame, labels: DataFrame, max_docs: int, held_out: int, by: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, document and label of the lines of at most ``max_docs`` labelled documents, those of smallest id hash.

    The bound is a parameter of the fit: the sample is broadcast to the documents, and its features come to the driver.
    """
    labelled = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_mod("doc_id", by) != held_out))
    chosen = labelled.groupBy("doc_id").agg(F.max("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    rows = docs.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("own", pa.binary())])
        for batch in batches:
            for part, text in slices(batch):
                own, owner, _ = line_features(text)
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                blobs = [own[a:b].astype(np.float32).tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield record(schema, doc_id=part.column("doc_id"), y=part.column("y"), own=blobs)

    got = rows.select("doc_id", "text", "y").mapInArrow(emit, "doc_id long, y int, own binary").toArrow().sort_by("doc_id")
    own = joined(got["own"], np.float32).reshape(-1, FEATURES).astype(np.float64)
    sizes = [len(x) // (4 * FEATURES) for x in got["own"].to_pylist()]
    return own, np.repeat(np.arange(len(got)), sizes), np.repeat((got["y"].to_numpy() > 0).astype(np.int64), sizes)


def fit_quality(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, held_out: int = 0, by: int = 5) -> Chain:
    """The chain learned from at most ``max_docs`` labelled documents whose crc32 of the id mod ``by`` is not ``held_out``."""
    return fit_chain(*training_lines(texts(docs), labels, max_docs, held_out, by))


def with_quality(docs: DataFrame, chain: Chain, text: str = "text") -> DataFrame:
    """``docs`` with ``__score`` in [0, 1], the length-weighted mean of its lines' good marginals, and ``__lines``."""

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in slices(batch, text):
                own, owner, length = line_features(body)
                good, _ = chain.marginals(with_neighbours(own, owner) @ chain.weights, owner)
                weight, n = length + 1.0, len(part)
                score = np.bincount(owner, good * weight, n) / np.bincount(owner, weight, n)
                more = [pa.array(np.clip(np.round(score, 9), 0.0, 1.0)), pa.array(np.bincount(owner, minlength=n))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "__score", "__lines"])

    schema = StructType([*docs.schema.fields, StructField("__score", DoubleType()), StructField("__lines", LongType())])
    return docs.mapInArrow(judge, schema)


def line_quality(
    docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, held_out: int = 0, by: int = 5, threshold: float = 0.3,
    key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (score >= ``threshold``), n_lines.

    Only the text is scored. A null or empty text is one empty line. Rows without an id are scored and not held out;
    repeated rows score alike; an empty table gives an empty one; without labels every line scores one half.
    """
    rows = texts(docs, key, text)
    scored = with_quality(rows, fit_quality(rows, labels, max_docs, held_out, by))
    return scored.select(
        "doc_id", F.coalesce(crc_mod("doc_id", by) == held_out, F.lit(False)).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__lines").alias("n_lines"),
    )


@query()
def op5_line_quality(spark, folder):
    """Quality of all documents."""
    return line_quality(documents(spark, folder), load(spark, folder, "labels"))
