"""Operator 6: toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives and any texts of the training folds the unlabelled; labels of 0 are used for the
class prior only. Linear classifiers over the presence of features minimise the non-negative risk: the prior times the
positives' loss, plus the unlabelled texts' loss as negatives less the prior times the positives' loss as
negatives, which is held at zero or above (Kiryo et al., 2017). Features are words and beginnings of longer words (for
languages that build words from stems), each as present, as standing twice or as frequent for the text's length. Those that
positives have clearly more or clearly less often than unlabelled texts enter the model, and their weights are free.
Several classifiers from resampled texts are averaged.

Training rows are a bounded sample; their texts are read whole. Features are counted by aggregation on the executors, and
only the chosen ones' places in each sampled text come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.lineage import Shelf

#: About so many positives and unlabelled texts are sampled, by hash; copies of a text count once.
POSITIVES = 2_000
UNLABELLED = 4_000
#: Bytes of the beginnings that are features of longer words.
PREFIXES = (4, 5, 6, 7, 8)
#: A feature is frequent if it stands once in so many words at least.
FREQUENT = 150
#: A feature stands in so many sampled texts at least, and the difference of its shares has this z score, up or down.
LEAST_COUNT = 4
LEAST_Z = 5.0
#: The model's size: features with the largest z scores.
FEATURES = 600
CLASSIFIERS = 3
STEPS = 800
SEED = 5

_SEPARATORS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass
class Toxic:
    """Averaged classifiers: sorted feature hashes, weights (classifiers x features) and biases."""

    words: np.ndarray
    weights: np.ndarray
    biases: np.ndarray

    def score(self, owner: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """Probabilities of n texts from their (text, feature) pairs."""
        out = np.zeros(n)
        for w, b in zip(self.weights, self.biases, strict=True):
            margin = np.bincount(owner, w[feature], minlength=n) + b
            out += 1 / (1 + np.exp(-np.clip(margin, -50, 50)))
        return out / len(self.biases)


#: The lowest two bits of a feature say how often it must stand; the rest is the hash of its word or beginning.
_BASE = np.uint64((1 << 64) - 4)


def word_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Hashes of all words (runs of letters, A-Z in lower case; bytes over 127 count as letters), then of the
    beginnings of each length of the words that are longer; for each of these arrays its documents; each document's words."""
    low = bytescan.LOWER[buf]
    starts, ends = bytescan.spans(low, offsets, _SEPARATORS)
    n_words = np.diff(bytescan.document_of(starts, offsets))
    owner = np.repeat(np.arange(len(n_words)), n_words)
    found, owners = [bytescan.span_hashes(low, starts, ends) & _BASE], [owner]
    for size in PREFIXES:
        longer = np.flatnonzero(ends - starts > size)
        # a mark keeps a beginning apart from the word that it would be
        found.append(bytescan.mix(bytescan.span_hashes(low, starts[longer], starts[longer] + size) ^ np.uint64(size)) & _BASE)
        owners.append(owner[longer])
    return found, owners, n_words


def features_of(bases: np.ndarray, counts: np.ndarray, n_words: np.ndarray | int) -> list[np.ndarray]:
    """Features of bases that stand so often: present, twice, frequent; zero where one does not hold."""
    return [bases, np.where(counts >= 2, bases | np.uint64(1), 0), np.where(counts * FREQUENT >= n_words, bases | np.uint64(2), 0)]


def known_pairs(words: np.ndarray, found: list[np.ndarray], owners: list[np.ndarray], n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, place in the sorted features) of the features that the documents have."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bases = np.unique(words & _BASE)
    sieve = np.zeros(1 << 16, bool)
    sieve[(bases >> np.uint64(48)).astype(np.int64)] = True
    pairs = []
    for hashes, owner in zip(found, owners, strict=True):
        maybe = np.flatnonzero(sieve[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(bases, hashes[maybe]), len(bases) - 1)
        hit = bases[at] == hashes[maybe]
        pairs.append(owner[maybe[hit]] * len(bases) + at[hit])
    both, counts = np.unique(np.concatenate(pairs), return_counts=True)
    doc, base = both // len(bases), bases[both % len(bases)]
    docs, places = [], []
    for f in features_of(base, counts, n_words[doc]):
        at = np.minimum(np.searchsorted(words, f), len(words) - 1)
        hit = words[at] == f
        docs.append(doc[hit])
        places.append(at[hit])
    return np.concatenate(docs), np.concatenate(places)


def z_score(positive: Column, unlabelled: Column, n_positive: int, n_unlabelled: int) -> Column:
    """How far a feature's share of the positives lies over its share of the unlabelled texts, in standard errors."""
    p, q = positive / n_positive, (unlabelled + 0.5) / (n_unlabelled + 1)
    return (p - q) / F.sqrt(q * (1 - F.least(q, F.lit(0.999))) * (1 / n_positive + 1 / (n_unlabelled + 1)))


def select(texts: DataFrame, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Sorted hashes of the features of texts (features as bytes of 64-bit hashes, positive, unlabelled) that positives have clearly
    more or less often: counted within each batch, then by one aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [np.frombuffer(b, np.uint64) for b in batch.column(0).to_pylist()]
            if not lists:
                continue
            found, inverse = np.unique(np.concatenate(lists), return_inverse=True)
            sizes = [len(x) for x in lists]
            sums = [np.bincount(inverse, np.repeat(np.asarray(batch.column(k).to_numpy(zero_copy_only=False), float), sizes), minlength=len(found)).astype(np.int64) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *map(pa.array, sums)], ["feature", "p", "u"])

    counts = texts.select("features", "positive", "unlabelled").mapInArrow(count, "feature long, p long, u long").groupBy("feature").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    scored = counts.where(F.col("p") + F.col("u") >= LEAST_COUNT).withColumn("z", F.abs(z_score(F.col("p"), F.col("u"), n_positive, n_unlabelled))).where(F.col("z") >= LEAST_Z)
    chosen = scored.orderBy(F.desc("z"), "feature").limit(FEATURES).collect()
    return np.sort(np.array([r["feature"] for r in chosen], np.int64).view(np.uint64))


def nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = STEPS, rate: float = 0.05, decay: float = 0.02) -> tuple[np.ndarray, float]:
    """Weights and bias of one linear classifier under the non-negative risk with the sigmoid loss, by Adam. Weights start
    from the log ratios of the features' shares and are drawn back to them."""
    d = x_pos.shape[1]
    p, q = (x_pos.sum(0) + 0.5) / (len(x_pos) + 1), (x_unl.sum(0) + 0.5) / (len(x_unl) + 1)
    w = np.append(np.clip(np.log(p / q), -1, 1), -1.0).astype(np.float32)
    first = w.copy()
    m, v = np.zeros(d + 1, np.float32), np.zeros(d + 1, np.float32)
    pos, unl = (np.c_[x, np.ones(len(x))].astype(np.float32) for x in (x_pos, x_unl))
    for t in range(1, steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(pos @ w, -50, 50))), 1 / (1 + np.exp(-np.clip(unl @ w, -50, 50)))
        # loss of a positive is 1 - s, of a negative s
        slope_p, slope_u = sp * (1 - sp), su * (1 - su)
        negative = su.mean() - prior * sp.mean()
        by_pos = prior * (slope_p @ pos) / len(pos)
        grad_negative = (slope_u @ unl) / len(unl) - by_pos
        grad = grad_negative - by_pos if negative >= 0 else -grad_negative
        grad[:-1] += decay * (w[:-1] - first[:-1]) / max(1, d)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1].astype(float), float(w[-1])


def train(words: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Toxic:
    """Classifiers over the sorted features ``words``; texts are places in them. Without texts of both kinds or features the
    score is the prior."""
    if not len(words) or not positive or not unlabelled or not 0 < prior < 1:
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Toxic(np.zeros(0, np.uint64), np.zeros((1, 0)), np.array([np.log(p / (1 - p))]))

    def matrix(texts: list[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(texts), len(words)), np.float32)
        for k, t in enumerate(texts):
            x[k, t] = 1
        return x

    x_pos, x_unl = matrix(positive), matrix(unlabelled)
    rng = np.random.default_rng(SEED)
    fits = [nnpu(x_pos[rng.integers(0, len(x_pos), len(x_pos))], x_unl[rng.integers(0, len(x_unl), len(x_unl))], prior) for _ in range(CLASSIFIERS)]
    return Toxic(words, np.array([w for w, _ in fits]), np.array([b for _, b in fits]))


def _below(key: Column, n: int, total: int) -> Column:
    """A hash sample of about n of total."""
    return F.pmod(F.xxhash64(key, F.lit(SEED)), F.lit(1 << 20)) < (1 << 20 if not total else min(1 << 20, -(-(n << 20) // total)))


def fold(id_col: str, parts: int = 5) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Toxic:
    """The model of the documents and labels whose crc32(id) mod 5 is not 0.

    Null ids, texts and labels are not learned from; of an id with several labels each counts for the prior and any 1 makes
    its documents positives. Copies of a text count once; texts are read whole, however long. Without a toxic label, a
    document or a telling feature all scores are the prior.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(fold("id") != 0).where("y in (0, 1)")
    total = known.agg(F.count("*").alias("n"), F.sum("y").alias("toxic")).first()
    n, toxic = total["n"], total["toxic"] or 0
    prior = toxic / n if n else 0.0
    none = np.zeros(0, np.uint64)
    if not toxic:
        return train(none, [], [], prior)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where(fold("id") != 0).where("text is not null")
    many = rows.select("id").count()
    # ids by hash, about POSITIVES of them
    chosen = known.where("y = 1").where(_below(F.col("id"), POSITIVES, toxic)).select("id").distinct().withColumn("positive", F.lit(True))
    flagged = rows.join(F.broadcast(chosen), "id", "left").select("text", F.coalesce("positive", F.lit(False)).alias("positive"), _below(F.col("id"), UNLABELLED, many).alias("unlabelled"))
    # copies of one text would make all its words telling
    picked = flagged.where("positive or unlabelled").groupBy("text").agg(F.bool_or("positive").alias("positive"), F.bool_or("unlabelled").alias("unlabelled"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                found, owners, n_words = word_hashes(buf, offsets)
                hashes, owner = np.concatenate(found), np.concatenate(owners)
                hashes = hashes[np.argsort(owner, kind="stable")]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))])
                features = []
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    all_of = np.unique(np.concatenate(features_of(*np.unique(hashes[a:b], return_counts=True), n_words[k])))
                    features.append(all_of[all_of > 0].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(features, pa.binary()), part.column(1), part.column(2)], ["features", "positive", "unlabelled"])

    texts = Shelf(docs.sparkSession).put(picked.mapInArrow(hashed, "features binary, positive boolean, unlabelled boolean"))
    sizes = texts.agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).first()
    if not sizes["p"] or not sizes["u"]:
        return train(none, [], [], prior)
    words = select(texts, sizes["p"], sizes["u"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.flatnonzero(np.isin(words, np.frombuffer(b, np.uint64), assume_unique=True)).astype(np.int16) for b in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out], pa.binary()), batch.column(1), batch.column(2)], ["places", "positive", "unlabelled"])

    got = [(bytes(r["places"]), r["positive"], r["unlabelled"]) for r in texts.mapInArrow(places, "places binary, positive boolean, unlabelled boolean").collect()]
    got.sort()
    read = lambda raw: np.frombuffer(raw, np.int16).astype(np.int64)
    return train(words, [read(x) for x, p, _ in got if p], [read(x) for x, _, u in got if u], prior)


def score(docs: DataFrame, model: Toxic, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null and empty texts have no words and get the score that the biases give; very long ones are scored whole, each as
    one slice. Null ids are not held out. Repeated rows are scored one by one, alike; other columns are not read; of no documents there are no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                n = part.num_rows
                owner, feature = known_pairs(model.words, *word_hashes(buf, offsets))
                value = model.score(owner, feature, n)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
