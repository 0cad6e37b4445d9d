"""Operator 12: a quality classifier by compression.

Dictionaries of the zstandard library are built from windows of good and of bad labelled texts, several pairs of them from
disjoint windows. A text is cut into windows, and each is compressed alone with every dictionary: what resembles good text
gets smaller with the good one. The normalised difference, (bad - good) / (bad + good) of the sizes summed over the
windows and averaged over the pairs, is calibrated to a probability by a logistic fit on labelled texts that made no dictionary.
The fit also sees how far the windows shrink without a dictionary, as text that repeats itself shrinks alike with any.

Training texts are a bounded sample of distinct texts, read whole: texts are picked by hash from narrow tables, so no text is
shuffled but the picked ones. Windows are all of a text's bytes, so the score of a long text doesn't depend on where it begins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.lineage import Shelf

#: About so many distinct texts of each label are sampled, half for dictionaries, half for the calibration.
TEXTS = 8_000
#: About so many distinct windows make one dictionary, of at most so many of one text.
WINDOWS = 4_000
WINDOWS_OF_TEXT = 16
#: Bytes of a window and of a dictionary, pairs of dictionaries, and the level of compression.
WINDOW = 512
DICTIONARY = 32 << 10
PAIRS = 4
LEVEL = 1
#: From this score on a text is predicted to be good.
THRESHOLD = 0.3
SEED = 12


@dataclass
class ZipModel:
    """Pairs of dictionaries (good, bad) and the weights of the logistic fit; compressors are made in each worker."""

    pairs: list[tuple[bytes, bytes]]
    weights: np.ndarray
    _ready: list = field(default_factory=list, repr=False)

    def __getstate__(self) -> dict:
        return {"pairs": self.pairs, "weights": self.weights, "_ready": []}

    def compressors(self) -> list:
        """For each pair its two compressors, and last one without a dictionary."""
        if not self._ready:
            import zstandard

            def made(raw: bytes | None):
                options = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
                if not raw:
                    return zstandard.ZstdCompressor(**options)
                dictionary = zstandard.ZstdCompressionDict(raw)
                dictionary.precompute_compress(level=LEVEL)
                return zstandard.ZstdCompressor(dict_data=dictionary, **options)

            self._ready += [(made(g), made(b)) for g, b in self.pairs] + [made(None)]
        return self._ready

    def measure(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of each text: the normalised difference, the share that is left without a dictionary, and the logarithm of its size."""
        *pairs, plain = self.compressors()
        starts, sizes, owner = windows(offsets)
        n, lengths = len(offsets) - 1, np.diff(offsets)
        whole = memoryview(buf)
        parts = [whole[a : a + size] for a, size in zip(starts.tolist(), sizes.tolist(), strict=True)]

        def summed(compressor) -> np.ndarray:
            return np.bincount(owner, np.fromiter((len(compressor.compress(p)) for p in parts), float, len(parts)), minlength=n)

        difference = np.zeros(n)
        for good, bad in pairs:
            g, b = summed(good), summed(bad)
            difference += (b - g) / np.maximum(b + g, 1)
        left = np.where(lengths > 0, summed(plain) / np.maximum(lengths, 1), 1.0)
        return np.c_[difference / max(1, len(pairs)), np.minimum(left, 1.0), np.log1p(lengths)]

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(measures) @ self.weights, -50, 50)))


def windows(offsets: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, sizes and texts of the windows that cover all texts; an empty text has one empty window."""
    lengths = np.diff(offsets)
    counts = np.maximum(1, -(-lengths // size))
    owner = np.repeat(np.arange(len(lengths)), counts)
    inside = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * size
    return offsets[owner] + inside, np.minimum(size, lengths[owner] - inside), owner


def design(measures: np.ndarray) -> np.ndarray:
    """Columns of the logistic fit."""
    difference, left, size = measures.T
    return np.c_[np.ones(len(measures)), 10 * difference, left, left**2, size / 10, 10 * difference * left]


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights of a ridge logistic fit by Newton's method with step halving."""
    w = np.zeros(x.shape[1])
    draw = decay * weight.sum() / len(w) * np.r_[0, np.ones(len(w) - 1)]

    def loss(v: np.ndarray) -> float:
        return float((weight * np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v))).sum() + 0.5 * (draw * v * v).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        gradient = x.T @ (weight * (p - y)) + draw * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(draw + 1e-9), gradient)
        rate = 1.0
        while rate > 1e-4 and loss(w - rate * step) > loss(w):
            rate /= 2
        w = w - rate * step
        if np.abs(step).max() < 1e-8:
            break
    return w


def dictionary_of(samples: Sequence[bytes]) -> bytes:
    """A trained dictionary, or for samples that are too few to train on their bytes one after another."""
    import zstandard

    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, level=LEVEL).as_bytes() if len(samples) >= 8 else b"".join(samples)
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY]


def constant(share: float) -> ZipModel:
    """The model that gives each text the share of good labels."""
    p = min(max(share, 1e-6), 1 - 1e-6)
    return ZipModel([], np.r_[np.log(p / (1 - p)), np.zeros(5)])


def _below(key: Column, n: int, total: int) -> Column:
    """A hash sample of about n of total."""
    return F.pmod(key, F.lit(1 << 30)) < (1 << 30 if not total else min(1 << 30, -(-(n << 30) // total)))


def fold(id_col: str, parts: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def sample_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, n: int) -> tuple[DataFrame, dict[int, int]]:
    """(text, y, key) of about n distinct labelled texts of each label, by the texts' hashes, and how many there are of each."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text, F.lit(SEED)).alias("key"))
    rows = rows.where("text is not null").where(fold("id") != 0)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(fold("id") != 0).where("y in (0, 1)")
    # a text's label is that of most of its documents, so that copies count once; only ids and hashes are shuffled
    texts = rows.select("id", "key").join(known, "id").groupBy("key").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    texts = Shelf(docs.sparkSession).put(texts)
    counts = {r["y"]: r["n"] for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return texts.limit(0).select(F.lit("").alias("text"), "y", "key"), counts
    picked = texts.where(F.when(F.col("y") == 1, _below(F.col("key"), n, counts[1])).otherwise(_below(F.col("key"), n, counts[0])))
    # about 2 n rows of two numbers, whatever the size of the tables
    return rows.join(F.broadcast(picked), "key").groupBy("key").agg(F.first("text").alias("text"), F.first("y").alias("y")), counts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ZipModel:
    """The model of the documents and labels whose crc32(id) mod 5 is not 0.

    Null ids, texts and labels are not learned from; other labels than 0 and 1 neither. Copies of a text count once, with
    the label of most of them (good where even). Texts are read whole; of a very long one about WINDOWS_OF_TEXT windows
    spread over it help to make dictionaries. Without texts of both labels all scores are the share of good ones, or one half.
    """
    sampled, counts = sample_texts(docs, labels, id_col, text_col, label_col, TEXTS)
    if set(counts) != {0, 1}:
        return constant(counts.get(1, 0) / sum(counts.values()) if counts else 0.5)
    shelf = Shelf(docs.sparkSession)
    sampled = shelf.put(sampled.withColumn("builds", F.shiftright("key", 40) % 2 == 0))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                starts, sizes, owner = windows(offsets)
                of_text = np.bincount(owner, minlength=part.num_rows)
                hashes = bytescan.mix(bytescan.span_hashes(buf, starts, starts + sizes))
                keep = (hashes >> np.uint64(44)).astype(np.int64) * of_text[owner] < WINDOWS_OF_TEXT << 20
                keep &= sizes > 0
                raw = [buf[a : a + s].tobytes() for a, s in zip(starts[keep].tolist(), sizes[keep].tolist(), strict=True)]
                y = part.column(1).take(pa.array(owner[keep]))
                yield pa.RecordBatch.from_arrays([y, pa.array((hashes[keep] & np.uint64((1 << 40) - 1)).astype(np.int64)), pa.array(raw, pa.binary())], ["y", "h", "raw"])

    cuts = shelf.put(sampled.where("builds").select("text", "y").mapInArrow(cut, "y int, h long, raw binary"))
    distinct = {r["y"]: r["n"] for r in cuts.groupBy("y").agg(F.approx_count_distinct("h").alias("n")).collect()}
    chosen = cuts.where(F.when(F.col("y") == 1, _below(F.col("h"), PAIRS * WINDOWS, distinct.get(1, 0))).otherwise(_below(F.col("h"), PAIRS * WINDOWS, distinct.get(0, 0))))
    # bounded: about PAIRS * WINDOWS distinct windows of WINDOW bytes for each label
    got: dict[tuple[int, int], list[bytes]] = {}
    for r in sorted((r["y"], r["h"], bytes(r["raw"])) for r in chosen.distinct().collect()):
        got.setdefault((r[0], (r[1] >> 32) % PAIRS), []).append(r[2])
    pairs = [(dictionary_of(got.get((1, k), [])), dictionary_of(got.get((0, k), []))) for k in range(PAIRS)]
    model = ZipModel([p for p in pairs if all(p)], np.zeros(6))
    if not model.pairs:
        return constant(counts[1] / sum(counts.values()))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                m = model.measure(buf, offsets)
                yield pa.RecordBatch.from_arrays([part.column(1), *map(pa.array, m.T)], ["y", "d", "r", "s"])

    rows = sampled.where("not builds").select("text", "y").mapInArrow(measured, "y int, d double, r double, s double").collect()
    table = np.array(sorted(tuple(r) for r in rows)).reshape(-1, 4)
    y = table[:, 0]
    if not 0 < y.sum() < len(y):
        return constant(counts[1] / sum(counts.values()))
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))  # the sample's shares back to the texts'
    model.weights = logistic(design(table[:, 1:]), y, weight)
    shelf.clear()
    return model


def score(docs: DataFrame, model: ZipModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts are scored alike, as one empty window; very long ones are scored whole, window by window. Null ids
    are not held out. Repeated rows are scored one by one, alike; other columns are not read; no documents give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                value = model.score(model.measure(buf, offsets))
                good = pa.array((value >= THRESHOLD).astype(np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value), good], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
