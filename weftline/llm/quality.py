"""Operator 9: quality rules with host-level verdicts.

Word, symbol, line and repetition counts come from one vectorised scan of each text. Rule failures are summed by host and
each host's failure rate is shrunk towards an empirical beta prior fitted to all hosts. A host loses all its documents if
the low end of its posterior still lies over twice the corpus's mean rate and over a tenth: then it is worse than
the others beyond what its number of documents could do by chance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.lineage import Shelf, small_side

MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW = 8
#: A host is rejected if its shrunk rate less DEVIATIONS posterior standard deviations exceeds both RATIO times the mean
#: rate and LEAST_RATE.
RATIO = 2.0
DEVIATIONS = 3.0
LEAST_RATE = 0.1
#: Documents that the prior weighs at most, as it does where hosts do not differ; it weighs one at least.
PRIOR_WEIGHT = 50.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_document(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values between the cuts."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[cuts[1:]] - total[cuts[:-1]]


def _with_document(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents of the slice."""
    return bytescan.mix(hashes ^ bytescan.mix(owner.astype(np.uint64) + np.uint64(1)))


def metrics_of(buf: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The five metrics of each document of a slice, as in METRICS."""
    n = len(offsets) - 1
    starts, ends = bytescan.spans(buf, offsets, bytescan.WORD_SEPARATORS)
    cuts = bytescan.document_of(starts, offsets)
    words = np.diff(cuts)
    chars = bytescan.characters_before(buf)
    word_chars = _per_document(chars[ends] - chars[starts], cuts)
    symbols = _per_document(_SYMBOL[buf], offsets)

    line_starts, line_ends = bytescan.spans(buf, offsets, bytescan.LINE_SEPARATORS)
    worded = np.searchsorted(starts, line_starts) < np.searchsorted(starts, line_ends)
    line_starts, line_ends = line_starts[worded], line_ends[worded]
    line_cuts = bytescan.document_of(line_starts, offsets)
    line_owner = np.repeat(np.arange(n), np.diff(line_cuts))
    _, first = np.unique(_with_document(bytescan.span_hashes(buf, line_starts, line_ends), line_owner), return_index=True)
    dup_lines = np.diff(line_cuts) - np.bincount(line_owner[first], minlength=n)

    repeat = np.zeros(n, np.int64)
    if len(starts) >= WINDOW:
        hashes = bytescan.span_hashes(buf, starts, ends)
        owner = np.repeat(np.arange(n), words)
        size = len(starts) - WINDOW + 1
        key = np.zeros(size, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(WINDOW):
                key = key * np.uint64(0x9FB21C651E98DF25) + hashes[k : k + size]
        at = np.flatnonzero(owner[:size] == owner[WINDOW - 1 :])
        if len(at):
            _, inverse, counts = np.unique(_with_document(key[at], owner[at]), return_inverse=True, return_counts=True)
            twice = at[counts[inverse.ravel()] > 1]
            steps = np.zeros(len(starts) + 1, np.int64)
            steps[twice] += 1
            np.subtract.at(steps, twice + WINDOW, 1)
            repeat = _per_document(np.cumsum(steps[:-1]) > 0, cuts)
    return [words, word_chars, symbols, dup_lines, repeat]


def measure(text: Column) -> Column:
    """A struct of the metrics of each whole text (null: none)."""
    return bytescan.text_column(lambda buf, offsets: [pa.array(v.astype(np.int64)) for v in metrics_of(buf, offsets)], [(m, "int64") for m in METRICS])(text)


def base_failed(m: str = "") -> Column:
    """The base rules on the metrics."""
    return (F.col(f"{m}n_words") < MIN_WORDS) | (100 * F.col(f"{m}n_repeat_words") > REPEAT_PERCENT * F.col(f"{m}n_words"))


def host_verdicts(rows: DataFrame, host: str = "host", failed: str = "failed") -> DataFrame:
    """(host, n_docs, n_failed, shrunk_rate, host_kept) of each non-null host.

    The beta prior's mean is the rate of all documents. Its weight is moment-matched: what hosts' rates vary beyond the
    binomial noise of their numbers of documents (a host of one document has nothing but noise) gives the correlation rho of
    two documents of one host, and the weight is 1 / rho - 1, between 1 and PRIOR_WEIGHT.
    """
    hosts = rows.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col(failed).cast("long")).alias("n_failed"))
    n, bad = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    sums = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(bad).alias("bad"), F.sum(n * n).alias("nn"), F.sum(bad * bad / n).alias("rr"))
    mean, others = F.col("bad") / F.col("n"), F.col("k") - 1
    spread = (F.col("rr") - F.col("bad") * mean) / (mean * (1 - mean)) - others  # beyond what noise alone gives
    room = F.col("n") - F.col("nn") / F.col("n") - others
    rho = F.when((mean > 0) & (mean < 1) & (room > 0), spread / room).otherwise(0.0)
    weight = 1 / F.greatest(F.lit(1 / (1 + PRIOR_WEIGHT)), F.least(F.lit(0.5), rho)) - 1
    # the prior is one row
    out = hosts.crossJoin(F.broadcast(sums.select(mean.alias("mean"), weight.alias("weight"))))
    shrunk = (F.col("n_failed") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    out = out.withColumn("shrunk_rate", shrunk)
    low = F.col("shrunk_rate") - DEVIATIONS * F.sqrt(F.col("shrunk_rate") * (1 - F.col("shrunk_rate")) / (F.col("n_docs") + F.col("weight") + 1))
    return out.select("host", "n_docs", "n_failed", "shrunk_rate", (low <= F.greatest(RATIO * F.col("mean"), F.lit(LEAST_RATE))).alias("host_kept"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: id, metrics, base_failed, kept, and its host's shrunk_rate.

    Empty and null texts fail (no words). Documents without a host are judged by the base rules alone, and null ids like
    others. Very long texts are measured whole, each as one slice. Repeated rows are judged one by one and count one by
    one for their host; equal rates of hosts give equal verdicts. Other columns of docs are not read.
    """
    shelf = Shelf(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(host_col).cast("string").alias("host"))
    measured = rows.select("doc_id", "host", measure(F.col("text")).alias("m")).select("doc_id", "host", "m.*")
    stored = shelf.put(measured.withColumn("base_failed", base_failed()))
    hosts = shelf.put(host_verdicts(stored, failed="base_failed"))
    verdict = hosts.select("host", "shrunk_rate", "host_kept")
    out = stored.join(small_side(verdict), "host", "left")
    return out.select("doc_id", *METRICS, "base_failed", (~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).alias("kept"), "shrunk_rate")


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """docs without those that the rules or their host's verdict reject; all columns stay as they are, whatever their names.

    Null and empty texts go; rows with a null host or id are judged by the base rules alone; repeated rows each stay or go
    alike; of no documents none are left. The texts are scanned twice (for the hosts, then for the documents) rather than shuffled.
    """
    mark = "__quality"
    while mark in docs.columns:
        mark += "_"
    metrics = measure(F.col(text_col).cast("string")).alias(mark)
    narrow = docs.select(F.col(host_col).cast("string").alias("host"), metrics)
    rejected = Shelf(docs.sparkSession).put(host_verdicts(narrow.select("host", base_failed(f"{mark}.").alias("failed"))).where(~F.col("host_kept")).select(F.col("host").alias(mark + "_host")))
    kept = docs.select("*", metrics).where(~base_failed(f"{mark}.")).drop(mark)
    return kept.join(small_side(rejected), kept[host_col].cast("string") == F.col(mark + "_host"), "left_anti")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("shrunk_rate")


ORACLE = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), g AS (
  SELECT doc_id, source, text, words, list_transform(range(1, len(words) - 6), lambda i: array_to_string(words[i : i + 7], ' ')) AS grams FROM w
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times
  FROM (SELECT doc_id, unnest(grams) AS gram, unnest(range(1, len(grams) + 1)) AS i FROM g)
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE times > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
), dup AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT g.doc_id, g.source, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM g LEFT JOIN dup ON g.doc_id = dup.doc_id LEFT JOIN rep ON g.doc_id = rep.doc_id
), f AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum(base_failed::INT)::DOUBLE AS bad FROM f WHERE source IS NOT NULL GROUP BY source
), t AS (
  SELECT count(*) - 1 AS others, sum(n) AS n, sum(bad) AS bad, sum(n * n) AS nn, sum(bad * bad / n) AS rr, sum(bad) / sum(n) AS mean FROM h
), r AS (
  SELECT mean, CASE WHEN mean > 0 AND mean < 1 AND n - nn / n - others > 0
    THEN ((rr - bad * mean) / (mean * (1 - mean)) - others) / (n - nn / n - others) ELSE 0.0 END AS rho FROM t
), p AS (
  SELECT mean, 1 / greatest(1 / 51.0, least(0.5, rho)) - 1 AS weight FROM r
), v AS (
  SELECT source, n + weight AS m, (bad + mean * weight) / (n + weight) AS shrunk, mean FROM h, p
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND coalesce(shrunk - 3.0 * sqrt(shrunk * (1 - shrunk) / (m + 1)) <= greatest(2 * mean, 0.1), TRUE)) AS kept
FROM f LEFT JOIN v ON f.source = v.source
"""
