"""Operator 3: packing by power-of-two decomposition.

Each document's ids are cut into pieces whose lengths are powers of two: as many of the largest length as fit, then
the binary digits of the rest, largest first. A piece is a sequence of its own, so a sequence never holds two documents and
needs no padding. Sequences of equal length share a bucket, and a bucket's sequences fill batches of ``longest`` tokens: a batch
is a rectangle of sequences of one length. One pass over the text, no shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan
from weftline.llm.wordbpe import WordBpe

END_ID = 2
SEQUENCE = 4096

_coders: dict[str, WordBpe] = {}


def decompose(n: int, longest: int = SEQUENCE) -> list[int]:
    """Lengths of the pieces of n tokens, in order: powers of two of at most ``longest`` that sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket (log2 of the length), batch_id
    and batch_row (the batch of the bucket that holds the sequence, and where), and with ``with_ids`` the piece's ids.

    Null and empty texts make one piece of the end id alone; very long ones are packed whole. Null ids stay null; repeated
    rows are packed one by one; other columns are not read; of no documents there are no pieces. Sequence and batch ids
    are unique, not dense: the partition's number in the high bits, a counter in the low 33. A batch is filled by one
    task, so each task leaves at most one short batch a bucket. Store the result before reading it twice if docs come
    from a shuffle, whose partitions may be numbered anew.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long, batch_row int" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _coders:
            _coders[tokenizer] = WordBpe(tokenizer)
        coder, task = _coders[tokenizer], TaskContext.get()
        sequence = batches_made = (task.partitionId() if task else 0) << 33
        batch_of: dict[int, tuple[int, int]] = {}  # of each length the open batch and how many sequences it holds
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                ids, cuts = coder.encode_slice(buf, offsets)
                keys = part.column(0)
                doc, start, length, crc, total, pieces, batch_id, batch_row = [], [], [], [], [], [], [], []
                tail = np.array([end_id], "<u4")
                for k in range(part.num_rows):
                    own = np.concatenate([ids[cuts[k] : cuts[k + 1]], tail]).astype("<u4")
                    raw, at = memoryview(own.tobytes()), 0
                    for size in decompose(len(own), longest):
                        doc.append(k)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(raw[4 * at : 4 * (at + size)]))
                        total.append(len(own))
                        number, held = batch_of.get(size, (0, longest // size))
                        if held == longest // size:
                            number, held, batches_made = batches_made, 0, batches_made + 1
                        batch_of[size] = number, held + 1
                        batch_id.append(number)
                        batch_row.append(held)
                        if with_ids:
                            pieces.append(own[at : at + size].astype(np.int32))
                        at += size
                n = len(doc)
                sizes = np.array(length, np.int64)
                columns = [keys.take(pa.array(doc, pa.int64())), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(sequence + np.arange(n, dtype=np.int64)), pa.array(np.zeros(n, np.int64)), pa.array(np.log2(sizes).astype(np.int32)), pa.array(batch_id, pa.int64()), pa.array(batch_row, pa.int32())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "batch_row"]
                if with_ids:
                    columns.append(pa.array(pieces, pa.list_(pa.int32())))
                    names.append("ids")
                sequence += n
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
