"""Operator 5: SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The merges are our own: a score-ordered agenda of adjacent symbol pairs, best score first, leftmost among equals.
Text is cut where no piece of the vocabulary can join what stands on both sides (checked on the vocabulary), and each
distinct chunk is merged once. New chunks of each Arrow batch are checked against the sentencepiece library, and the
decoded text against the encoded one.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan

SPACE_MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_SPACE, _LETTER, _DIGIT, _OTHER, _UNSURE = range(5)
_KIND = np.full(256, _UNSURE, np.uint8)
_KIND[:128] = _OTHER
_KIND[0x20] = _SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTER
_KIND[48:58] = _DIGIT

_coders: dict[str, PieceBpe] = {}


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def _kind_of(char: str) -> int:
    if char == SPACE_MARK:
        return _SPACE
    if char.isascii():
        return int(_KIND[ord(char)])
    return _LETTER if "À" <= char <= "ſ" and char not in "×÷" else _UNSURE


class PieceBpe:
    """A merge-type model; ValueError if the model needs what is not supported (unigram, rewriting rules, user pieces)."""

    def __init__(self, path: str, check: bool = True):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        scores, kinds, trainer, rules = [], [], {}, {}
        for field, value in _fields(raw):
            if field == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif field == 2:
                trainer = dict(_fields(value))
            elif field == 3:
                rules = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35) or trainer.get(24):
            raise ValueError("only merge-type models with byte fallback and leading space marks are supported")
        if rules.get(2) or not rules.get(3, 1) or rules.get(4, 1) or not rules.get(5, 1) or {USER_DEFINED, UNUSED} & set(kinds):
            raise ValueError("models with rewriting rules, own or unused pieces are not supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.rank = {p: -scores[i] for p, i in self.ids.items()}
        self.byte_ids = [0] * 256
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        joined = {(_kind_of(a), _kind_of(b)) for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        self.apart = np.zeros((5, 5), bool)
        for a in range(4):
            for b in range(4):
                self.apart[a, b] = (a, b) not in joined
        self.before_space = not any((a, _SPACE) in joined for a in (_LETTER, _DIGIT, _OTHER, _UNSURE))
        meaning = [p.replace(SPACE_MARK, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.surface_at = np.concatenate([[0], np.cumsum([len(m) for m in meaning])]).astype(np.int64)
        self.surface = np.frombuffer(b"".join(meaning), np.uint8)
        self.is_byte = np.array([k == BYTE for k in kinds])
        names = [f"{i},".encode() for i in range(len(self.pieces))]
        self.name_at = np.concatenate([[0], np.cumsum([len(m) for m in names])]).astype(np.int64)
        self.name = np.frombuffer(b"".join(names), np.uint8)
        self.library = None
        if check:
            import sentencepiece

            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.table = bytescan.ChunkTable(self._solve, np.int32)

    def merge(self, text: str) -> list[int]:
        """Ids of one chunk (spaces stand for space marks), by the agenda."""
        rank, ids = self.rank, self.ids
        symbols = [*text.replace(" ", SPACE_MARK)]
        n = len(symbols)
        if n > 1:
            after, before = [*range(1, n), -1], [*range(-1, n - 1)]
            agenda = [(rank[p], k, p) for k in range(n - 1) if (p := symbols[k] + symbols[k + 1]) in rank]
            heapq.heapify(agenda)
            while agenda:
                _, left, piece = heapq.heappop(agenda)
                right = after[left]
                if right < 0 or not symbols[left] or symbols[left] + symbols[right] != piece:
                    continue  # one of the two has been merged since
                symbols[left], symbols[right] = piece, ""
                after[left] = last = after[right]
                if last >= 0:
                    before[last] = left
                    if (p := piece + symbols[last]) in rank:
                        heapq.heappush(agenda, (rank[p], left, p))
                first = before[left]
                if first >= 0 and (p := symbols[first] + piece) in rank:
                    heapq.heappush(agenda, (rank[p], first, p))
        out = []
        for s in symbols:
            if s:
                if (i := ids.get(s)) is None:
                    out.extend(self.byte_ids[b] for b in s.encode())
                else:
                    out.append(i)
        return out

    def _solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [c.decode() for c in chunks]
        solved = list(map(self.merge, texts))
        if self.library is not None:
            # a chunk that begins with a space stands as the library's own dummy prefix makes it; others get one and lose it
            plain = [k for k, t in enumerate(texts) if t[0] == " "]
            for k, ids in zip(plain, self.library.encode([texts[k][1:] for k in plain], num_threads=1), strict=True):
                if ids and ids != solved[k]:
                    raise ValueError(f"merges differ from the sentencepiece library on {texts[k][:80]!r}")
            mark = self.ids.get(SPACE_MARK)
            rest = [k for k, t in enumerate(texts) if t[0] != " "]
            for k, ids in zip(rest, self.library.encode(["\n" + texts[k] for k in rest], num_threads=1), strict=True):
                if texts[k][0] != SPACE_MARK and ids != [mark, self.byte_ids[10], *solved[k]]:
                    raise ValueError(f"merges differ from the sentencepiece library on {texts[k][:80]!r}")
        sizes = np.fromiter(map(len, solved), np.int64, len(solved))
        return np.fromiter((i for s in solved for i in s), np.int32, int(sizes.sum())), sizes

    def chunk_spans(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that cover the bytes, cut where no piece can join the two sides."""
        n = len(buf)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        kinds = _KIND[buf]
        lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
        lead = lead[~((buf[lead] == 0xC3) & ((buf[lead + 1] == 0x97) | (buf[lead + 1] == 0xB7)))]
        inner = np.zeros(n, bool)
        inner[lead + 1] = True
        kinds[lead] = kinds[lead + 1] = _LETTER
        begin = np.zeros(n, bool)
        begin[1:] = self.apart[kinds[:-1], kinds[1:]] & ~inner[1:]
        if self.before_space:
            begin[1:] |= (kinds[1:] == _SPACE) & (kinds[:-1] == _UNSURE) & (buf[:-1] != 0x81)
        begin[0] = True
        begin[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], n)

    def encode_slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, whose bytes have the dummy space before them, and each document's offsets."""
        starts, ends = self.chunk_spans(buf, offsets)
        ids, cuts = self.table.lookup(bytescan.span_hashes(buf, starts, ends), buf, starts, ends)
        return ids, cuts[bytescan.document_of(starts, offsets)]

    def decode_slice(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Decoded bytes of all documents, still with the leading space, and offsets. Bytes may not be valid UTF-8."""
        out, at = bytescan.gather(self.surface_at, self.surface, ids)
        return out, at[cuts]

    def decode(self, ids: list[int]) -> str:
        """Text of one list of ids as the library's decode has it: bytes that aren't UTF-8 become U+FFFD each."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                size = next((s for s in (1, 2, 3, 4) if _is_character(bytes(run[at : at + s]), s)), 0)
                out.append(run[at : at + size].decode() if size else "�")
                at += size or 1
            run.clear()

        begun = False
        for i in ids:
            raw = self.surface[self.surface_at[i] : self.surface_at[i + 1]].tobytes()
            if self.is_byte[i]:
                run += raw
                begun = True
                continue
            flush()
            if raw:
                out.append(raw[1:].decode() if not begun and raw[:1] == b" " and i in self.ids.values() else raw.decode())
                begun = True
        flush()
        return "".join(out)


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def coder_of(path: str) -> PieceBpe:
    if path not in _coders:
        _coders[path] = PieceBpe(path)
    return _coders[path]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` ids and decoded text.

    Null and empty texts have no ids and decode to the empty text. Very long texts are encoded whole, each as one slice. Null ids
    stay null; repeated rows stay; of no documents there are no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            prefix = pc.if_else(pc.equal(pc.binary_length(texts), 0), "", " ")
            spaced = pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join_element_wise(prefix, texts, "")], ["doc_id", "text"])
            for part, buf, offsets, _ in bytescan.text_slices(spaced, "text"):
                ids, cuts = coder.encode_slice(buf, offsets)
                names, at = bytescan.gather(coder.name_at, coder.name, ids)
                at, names = at[cuts].tolist(), memoryview(names)
                decoded, to = coder.decode_slice(ids, cuts)
                source = buf.tobytes().replace(SPACE_MARK.encode(), b" ")
                whole = decoded.tobytes()
                if whole != source:
                    raise ValueError("decoding does not give the encoded text back")
                to = to.tolist()
                n = part.num_rows
                columns = [part.column(0), pa.array(np.diff(cuts)), pa.array([hashlib.sha256(names[at[k] : max(at[k], at[k + 1] - 1)]).hexdigest() for k in range(n)]), pa.array([hashlib.sha256(whole[to[k] + (to[k + 1] > to[k]) : to[k + 1]]).hexdigest() for k in range(n)])]
                fields = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids)), pa.array([whole[to[k] + (to[k + 1] > to[k]) : to[k + 1]].decode() for k in range(n)])]
                    fields += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, fields)

    return rows.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
