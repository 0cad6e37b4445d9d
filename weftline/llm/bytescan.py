"""Vectorised scanning of UTF-8 text in Arrow batches.

Words, lines and other chunks are found and hashed by numpy over the raw bytes of many documents at once, so no
Python object is made for each word. All separators used here are ASCII, so bytes above 127 never split a character.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

#: Bytes of text that are hashed at once; bounds the memory of the temporary arrays (about 40 bytes for each).
BLOCK = 1 << 17
#: Bytes of text that one slice of a batch may hold (a longer document makes a slice of its own).
SLICE = 1 << 19

try:  # where the C library has it
    _libc = ctypes.CDLL("libc.so.6")
    _libc.malloc_trim  # noqa: B018
except (OSError, AttributeError):
    _libc = None

WORD_SEPARATORS = np.zeros(256, bool)
WORD_SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
LINE_SEPARATORS = np.zeros(256, bool)
LINE_SEPARATORS[0x0A] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


_PLACE = np.uint64(0x9E3779B97F4A7C15)
_SIZE = np.uint64(0xD6E8FEB86659FD93)
_FILL = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def padded(buf: np.ndarray) -> np.ndarray:
    """A copy with eight zeros at the end."""
    out = np.zeros(len(buf) + 8, np.uint8)
    out[: len(buf)] = buf
    return out


def _words(buf: np.ndarray) -> np.ndarray:
    """For each position of padded bytes the eight bytes from it on as one number; a view."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, strides=(1,))


def _eights(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of these sizes in blocks of eight bytes: each block's span, its number in the span, and how many bytes it has."""
    counts = (sizes + 7) >> 3
    owner = np.repeat(np.arange(len(sizes)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owner, number, np.minimum(sizes[owner] - 8 * number, 8)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """A 64-bit hash of each span buf[start:end]; spans are in order and do not overlap.

    Each eight bytes are mixed, mixed again with their place in the span, and summed: what a byte adds is no multiple of a power
    of anything, so spans built from few letters by a rule collide no more than others.
    """
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + block, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        s, sizes = starts[i:j] - lo, ends[i:j] - starts[i:j]
        owner, number, filled = _eights(sizes)
        with np.errstate(over="ignore"):
            parts = mix((_words(padded(buf[lo:hi]))[s[owner] + 8 * number] & _FILL[filled]) + _SIZE)
            parts = mix(parts + (number.astype(np.uint64) + np.uint64(1)) * _PLACE)
            sums = np.zeros(len(parts) + 1, np.uint64)
            np.cumsum(parts, out=sums[1:])
            last = np.cumsum((sizes + 7) >> 3)
            out[i:j] = sums[last] - sums[last - ((sizes + 7) >> 3)] + sizes.astype(np.uint64) * _SIZE
        i = j
    return mix(out)


def equal_spans(buf: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, other_starts: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether the spans of buf equal those of the other bytes, one by one; both are padded."""
    same = sizes == other_sizes
    at = np.flatnonzero(same)
    step = 1 << 16  # spans at a time
    mine, theirs = _words(buf), _words(other)
    for k in range(0, len(at), step):
        part = at[k : k + step]
        owner, number, filled = _eights(sizes[part])
        differ = (mine[starts[part][owner] + 8 * number] ^ theirs[other_starts[part][owner] + 8 * number]) & _FILL[filled]
        same[part[owner[differ != 0]]] = False
    return same


def spans(buf: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without separators; no run crosses a document's border."""
    inside = ~separators[buf]
    flips = np.zeros(len(buf) + 1, bool)
    if len(buf):
        flips[1:-1] = inside[1:] != inside[:-1]
        flips[0], flips[-1] = inside[0], inside[-1]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(buf))]
        cut = np.unique(borders[inside[borders - 1] & inside[borders]])
    else:
        cut = np.zeros(0, np.int64)
    at = np.flatnonzero(flips)
    starts, ends = at[0::2], at[1::2]
    if len(cut):
        starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    return starts, ends


def document_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each of the sorted positions, how many spans begin before each document: an index array of n + 1."""
    return np.searchsorted(starts, offsets, "left")


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of the batch with about ``limit`` bytes of text each: (rows, bytes, offsets, which rows are not null)."""
    if not batch.num_rows:
        return
    texts = batch.column(batch.schema.get_field_index(column))
    present = np.asarray(pc.is_valid(texts).to_numpy(zero_copy_only=False), bool)
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    raw = texts.buffers()
    offsets = np.frombuffer(raw[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    i, n = 0, len(texts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        lo, hi = int(offsets[i]), int(offsets[j])
        yield batch.slice(i, j - i), data[lo:hi], offsets[i : j + 1] - lo, present[i:j]
        i = j
    release()


def text_column(scan, fields: list[tuple[str, str]]) -> object:
    """A column function of a text column: a struct of the fields (name, type), whose arrays ``scan`` gives for the bytes and
    offsets of some texts at a time. Only the texts go to Python and only the structs come back; the other columns stay."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = pa.RecordBatch.from_arrays([texts], ["text"])
            found = [pa.StructArray.from_arrays(scan(buf, offsets), [n for n, _ in fields]) for _, buf, offsets, _ in text_slices(rows, "text")]
            yield pa.concat_arrays(found) if found else pa.array([], pa.struct([(n, pa.type_for_alias(t)) for n, t in fields]))

    return F.arrow_udf(run, ", ".join(f"{n} {'long' if t == 'int64' else t}" for n, t in fields))


def release() -> None:
    """Gives freed memory back to the system: a worker is kept for later tasks, beside which its share would stay taken."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def gather(offsets: np.ndarray, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenates data[offsets[r]:offsets[r + 1]] for r in rows; returns it and the new offsets."""
    sizes = offsets[rows + 1] - offsets[rows]
    ends = np.cumsum(sizes)
    out = np.zeros(len(rows) + 1, np.int64)
    out[1:] = ends
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total, dtype=np.int64) + np.repeat(offsets[rows] - out[:-1], sizes)
    return data[at], out


def characters_before(buf: np.ndarray) -> np.ndarray:
    """How many characters begin before each byte position (an array one longer than buf)."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


class ChunkTable:
    """What is known of each distinct chunk of text: a row of values, kept while there is room.

    Chunks are found by hash and then compared byte by byte, so a hash that two chunks share costs time only. ``solve`` gets
    a list of new chunks (bytes) and returns their values in order and how many each has. Forgetting chunks costs time
    only; a chunk takes about 50 bytes beside its own.
    """

    def __init__(self, solve, dtype, room: int = 600_000, size: int = 32 << 20):
        self.solve, self.dtype, self.room, self.size = solve, dtype, room, size
        self._reset()

    def _reset(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.rows = np.zeros(0, np.int64)
        self.offsets = np.zeros(1, np.int64)
        self.data = np.zeros(0, self.dtype)
        self.byte_at = np.zeros(1, np.int64)
        self.bytes = padded(np.zeros(0, np.uint8))

    def _add(self, chunks: list[bytes]) -> np.ndarray:
        """New rows for the chunks, in order."""
        fresh, sizes = self.solve(chunks)
        rows = len(self.offsets) - 1 + np.arange(len(chunks))
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(sizes)])
        self.data = np.concatenate([self.data, fresh.astype(self.dtype, copy=False)])
        self.byte_at = np.concatenate([self.byte_at, self.byte_at[-1] + np.cumsum(np.fromiter(map(len, chunks), np.int64, len(chunks)))])
        self.bytes = np.concatenate([self.bytes[:-8], np.frombuffer(b"".join([*chunks, bytes(8)]), np.uint8)])
        return rows

    def lookup(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values of all chunks in order, and the offsets of each chunk's values."""
        unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        inverse = inverse.ravel()
        at = np.searchsorted(self.keys, unique)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == unique if len(self.keys) else np.zeros(len(unique), bool)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.keys) and (len(self.keys) + len(new) > self.room or len(self.bytes) + int((ends - starts)[first[new]].sum()) > self.size):
                self._reset()
                new = np.arange(len(unique))
            raw = buf.tobytes()
            rows = self._add([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            keys, rows = np.concatenate([self.keys, unique[new]]), np.concatenate([self.rows, rows])
            order = np.argsort(keys, kind="stable")
            self.keys, self.rows = keys[order], rows[order]
            at = np.searchsorted(self.keys, unique)
        found, sizes, own = self.rows[at], ends - starts, padded(buf)
        rows = found[inverse]
        # each unique hash's first chunk against what is kept, then the others against that first one
        kept = equal_spans(own, starts[first], sizes[first], self.bytes, self.byte_at[found], self.byte_at[found + 1] - self.byte_at[found])
        same = kept[inverse] & equal_spans(own, starts, sizes, own, starts[first][inverse], sizes[first][inverse])
        if not same.all():  # other chunks of a known hash: solved anew, under no key
            odd = np.flatnonzero(~same)
            chunks = [buf[s:e].tobytes() for s, e in zip(starts[odd].tolist(), ends[odd].tolist(), strict=True)]
            number = {c: k for k, c in enumerate(dict.fromkeys(chunks))}
            rows[odd] = self._add(list(number))[[number[c] for c in chunks]]
        return gather(self.offsets, self.data, rows)
