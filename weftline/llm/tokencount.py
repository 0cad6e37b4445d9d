"""Operator 2: token counts by section, attributed by offsets.

A document is encoded whole, once. The bytes of each token give its character span, which is joined with the spans of
the document's sections, or of the fields that it was put together from; a token that crosses a border is allotted by an
explicit rule.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan

#: What becomes of a token with characters in several sections: all of it goes to the section of its first or last
#: character, or to that with most of its characters (the first of equals), or it is split in proportion.
RULES = ("first", "last", "most", "split")

_coders: dict[tuple[str, str], RankBpe] = {}


class RankBpe:
    """A rank file of the tiktoken library and how many bytes each id stands for."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for raw, i in ranks.items():
            self.sizes[i] = len(raw)

    def ends(self, text: str) -> np.ndarray:
        """Byte offsets at which the tokens of the whole text end."""
        return np.cumsum(self.sizes[np.asarray(self.coder.encode_ordinary(text), np.int64)])


def line_sections(buf: np.ndarray) -> np.ndarray:
    """Character offsets of the section borders of a text whose sections are its lines, line ends included: the first is 0, the
    last the text's length."""
    chars = bytescan.characters_before(buf)
    ends = chars[np.flatnonzero(buf == 0x0A) + 1]
    return np.unique(np.concatenate([[0], ends, chars[-1:]]))


def attribute(buf: np.ndarray, token_ends: np.ndarray, borders: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the crossing tokens touch it. Sums of the first are the number of tokens."""
    n = max(0, len(borders) - 1)
    if not len(token_ends) or not n:
        return np.zeros(n), np.zeros(n, np.int64)
    chars = bytescan.characters_before(buf)
    begin = np.concatenate([[0], token_ends[:-1]])
    # a token that begins within a character's bytes has that character too
    first = chars[begin] - ((buf[begin] & 0xC0) == 0x80)
    last = chars[token_ends] - 1
    a = np.searchsorted(borders, first, "right") - 1
    b = np.searchsorted(borders, last, "right") - 1
    crossing = np.flatnonzero(a != b)
    counts = np.bincount(a[a == b], minlength=n).astype(float)
    touched = np.zeros(n, np.int64)
    for t in crossing.tolist():
        sections = np.arange(a[t], b[t] + 1)
        held = np.minimum(borders[sections + 1], last[t] + 1) - np.maximum(borders[sections], first[t])
        touched[sections] += 1
        if rule == "split":
            counts[sections] += held / held.sum()
        else:
            counts[sections[{"first": 0, "last": -1, "most": int(held.argmax())}[rule]]] += 1
    return counts, touched


def count_tokens(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections: Callable[[np.ndarray], np.ndarray] | str = line_sections, rule: str = "most") -> DataFrame:
    """One row per section: doc_id, section (from 0), start and length in characters, n_tokens, n_crossing, doc_tokens.

    sections: a function from a text's bytes to the character offsets of its borders, from 0 to its length, or the name of an
    array column that holds them. n_tokens is a double and whole but for the rule "split". A null or empty text is one
    empty section without tokens (with an array column: as many empty sections as it says); very long texts are encoded
    whole. Of sections with equal shares of a token the first takes it ("most"). Null ids stay null; repeated rows are
    counted one by one; other columns are not read; of no documents there are no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *([F.col(sections).cast("array<long>").alias("borders")] if isinstance(sections, str) else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (ranks, pattern) not in _coders:
            _coders[ranks, pattern] = RankBpe(ranks, pattern)
        coder = _coders[ranks, pattern]
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                sizes, out = [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    own = buf[offsets[k] : offsets[k + 1]]
                    ends = coder.ends(text)
                    borders = np.asarray(part.column(2)[k].as_py() or [0, 0], np.int64) if isinstance(sections, str) else sections(own)
                    if len(borders) < 2:
                        borders = np.array([0, 0])
                    counts, touched = attribute(own, ends, borders, rule)
                    n = len(counts)
                    sizes.append(n)
                    out.append((np.arange(n), borders[:-1], np.diff(borders), counts, touched, np.full(n, len(ends))))
                if sum(sizes):
                    keys = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
                    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays([keys, *(pa.array(c) for c in columns)], ["doc_id", "section", "start", "length", "n_tokens", "n_crossing", "doc_tokens"])

    return rows.mapInArrow(run, "doc_id long, section long, start long, length long, n_tokens double, n_crossing long, doc_tokens long")


def count_field_tokens(docs: DataFrame, fields: Sequence[str], ranks: str, pattern: str, id_col: str = "doc_id", between: str = "\n", rule: str = "most") -> DataFrame:
    """One row per document and field: doc_id, field, start, length, n_tokens, n_crossing, doc_tokens, of documents that are
    put together from their fields, with ``between`` after each but the last as part of it. Null fields are empty and have a row;
    of very long ones, null ids, repeated rows, ties and empty tables the same holds as for count_tokens."""
    texts = [F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit(between if k < len(fields) - 1 else "")) for k, f in enumerate(fields)]
    ends = [sum((F.length(t) for t in texts[1 : k + 1]), F.length(texts[0])) for k in range(len(texts))]
    whole = docs.select(F.col(id_col).alias("doc_id"), F.concat(*texts).alias("text"), F.array(F.lit(0), *ends).alias("borders"))
    counts = count_tokens(whole, ranks, pattern, "doc_id", "text", "borders", rule)
    names = F.array(*map(F.lit, fields))
    return counts.withColumn("section", F.element_at(names, F.col("section").cast("int") + 1)).withColumnRenamed("section", "field")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
