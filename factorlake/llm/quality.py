"""Text quality from zstandard dictionaries of good and bad labelled text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorlake.llm.scratch import bounded_batches

#: Labelled rows of each class that a model is fitted on, at most; the bound of what reaches the driver.
SAMPLE_ROWS = 1500
#: Stretches of BLOCK characters, evenly spread, that a sampled text longer than all of them gives to the fit.
#: With SAMPLE_ROWS this bounds the bytes that reach the driver.
SAMPLE_BLOCKS = 8
#: Bytes of one compressed block: a whole text is scored block by block, so that the dictionary
#: matters in every part of it and a text of any length takes the same memory.
BLOCK = 2048
DICT_BYTES = 112_640
LEVEL = 3
#: Bytes of an empty frame as it is written here.
FRAME = 9


class CompressionModel:
    """Two dictionaries and a logistic curve over the compressed sizes they give."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray) -> None:
        self.good, self.bad, self.weights = good, bad, weights

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        parameters = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        made = []
        for content in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(content)
            d.precompute_compress(level=LEVEL)
            made.append(zstandard.ZstdCompressor(dict_data=d, **parameters))
        return made

    def score(self, sizes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features(sizes) @ self.weights, -30, 30)))


def blocks(text: bytes) -> Iterator[bytes]:
    """About equal blocks of at most BLOCK bytes that cover the whole text."""
    n = max(1, -(-len(text) // BLOCK))
    step = -(-len(text) // n) if text else 0
    return (text[i * step : (i + 1) * step] for i in range(n))


def compressed_sizes(text: bytes, compressors: list[zstandard.ZstdCompressor]) -> tuple[float, float, float]:
    """Bytes of the text, and of its blocks under each dictionary without their frames."""
    good = bad = 0
    for b in blocks(text):
        good += len(compressors[0].compress(b)) - FRAME
        bad += len(compressors[1].compress(b)) - FRAME
    return len(text), good, bad


def features(sizes: np.ndarray) -> np.ndarray:
    """1, the normalised difference of the compressed sizes, and the normalised mean size; short texts draw near to usual values."""
    n, good, bad = sizes.T
    return np.stack([np.ones(len(n)), 20 * (bad - good) / (good + bad + 100), ((good + bad) / 2 + 50) / (n + 120)], axis=1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method for a weighted, slightly damped logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (y - p)) - ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def dictionary(texts: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary trained on every block of the texts; where they are too few to train on, the blocks themselves."""
    pieces = [b for t in texts for b in blocks(t) if b]
    try:
        return zstandard.train_dictionary(DICT_BYTES, pieces)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"\n".join(pieces)[-DICT_BYTES:] or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def stretches(text: Column) -> Column:
    """The whole text, or SAMPLE_BLOCKS stretches of it where it is longer than these."""
    n = F.char_length(text)
    some = F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_BLOCKS - 1)), lambda i: F.substring(text, F.floor(i * n / SAMPLE_BLOCKS).cast("int") + 1, F.lit(BLOCK)))
    return F.when(n <= BLOCK * SAMPLE_BLOCKS, text).otherwise(F.array_join(some, ""))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> CompressionModel:
    """Fit on at most `sample_rows` labelled documents of each class, taken in the order of a hash of doc_id.

    Half of each sample makes the dictionary of its class, the other half the calibration, which
    weighs the classes by their true share in `labels`. With one class or none the score is a constant.
    Null labels and ids are left out; a doc_id counts once per class, however often it is labelled or
    given, with the least of its texts; of a text longer than SAMPLE_BLOCKS * BLOCK characters as many
    stretches are used. So at most 2 * sample_rows * SAMPLE_BLOCKS * BLOCK characters reach the driver.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1)).groupBy("doc_id", F.col(label_col).alias("__y")).agg(F.count("*").alias("n"))
    share = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.sum("n").alias("n")).collect()}  # two rows
    drawn = None
    for y in (0, 1):  # a bounded top-n per class
        part = known.where(F.col("__y") == y).drop("n").orderBy(F.xxhash64(F.lit(5), "doc_id"), "doc_id").limit(sample_rows)
        drawn = part if drawn is None else drawn.unionByName(part)
    # at most 2 * sample_rows ids
    held = docs.select("doc_id", F.col(text_col).alias("__t")).join(F.broadcast(drawn), "doc_id")
    rows = held.groupBy("doc_id", "__y").agg(F.min(stretches(F.col("__t"))).alias("__t")).orderBy(F.xxhash64(F.lit(6), "doc_id"), "doc_id").collect()
    texts = {y: [(r["__t"] or "").encode() for r in rows if r["__y"] == y] for y in (0, 1)}
    if not texts[0] or not texts[1]:
        only = share.get(1, 0) / max(1, sum(share.values())) if share else 0.5
        p = min(max(only, 0.01), 0.99)
        return CompressionModel(b" ", b" ", np.array([np.log(p / (1 - p)), 0.0, 0.0]))
    model = CompressionModel(dictionary(texts[1][::2]).as_bytes(), dictionary(texts[0][::2]).as_bytes(), np.zeros(3))
    own = model.compressors()
    y = np.array([v for v in (0, 1) for _ in texts[v][1::2]], dtype=float)
    if len(set(y)) < 2:
        y = np.array([v for v in (0, 1) for _ in texts[v]], dtype=float)
        sizes = np.array([compressed_sizes(t, own) for v in (0, 1) for t in texts[v]])
    else:
        sizes = np.array([compressed_sizes(t, own) for v in (0, 1) for t in texts[v][1::2]])
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    model.weights = fit_logistic(features(sizes), y, weight * len(y) / weight.sum())
    return model


def with_score(docs: DataFrame, model: CompressionModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of `docs` and `out`: the calibrated chance, 0 to 1, that the label is 1.

    Null texts count as empty, and empty texts get the score of their (equal) compressed sizes.
    Equal texts get equal scores; an empty table gives an empty table; a column named `out` is replaced.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.drop(out)
    shared = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.weights))  # two dictionaries of DICT_BYTES
    at = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = CompressionModel(*shared.value)
        compressors = own.compressors()
        for b in batches:
            sizes = np.array([compressed_sizes((t.as_py() or "").encode(), compressors) for t in b.column(at)], dtype=float).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.score(sizes))], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())]))
