"""Token ids of whole texts from a lower-casing word BPE vocabulary of the tokenizers library.

Text is cut where the vocabulary's own pattern must cut it too (white space, or between a letter, a digit and
punctuation whose kinds are certain), each distinct chunk is encoded by the library once, and ids are gathered.
"""

from __future__ import annotations

import os

import numpy as np

from weftline.llm import bytescan

SPECIALS = (b"<|startoftext|>", b"<|endoftext|>")

SPACE, LETTER, DIGIT, PUNCTUATION, UNSURE = range(5)
_KIND = np.full(256, UNSURE, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = SPACE
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) != "'"]] = PUNCTUATION


def byte_kinds(buf: np.ndarray, table: np.ndarray = _KIND) -> np.ndarray:
    """The kind of each byte; both bytes of a Latin letter (U+00C0 to U+017F but U+0130) count as a letter."""
    kinds = table[buf]
    if len(buf) > 1:
        lead = np.flatnonzero((buf[:-1] >= 0xC3) & (buf[:-1] <= 0xC5))
        after = buf[lead + 1]
        lead = lead[~((buf[lead] == 0xC3) & ((after == 0x97) | (after == 0xB7))) & ~((buf[lead] == 0xC4) & (after == 0xB0))]
        kinds[lead] = LETTER
        kinds[lead + 1] = LETTER
    return kinds


def chunk_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of chunks between which the pattern surely cuts."""
    kinds = byte_kinds(buf)
    sure = (kinds == LETTER) | (kinds == DIGIT) | (kinds == PUNCTUATION)
    inside = kinds != SPACE
    n = len(buf)
    begin = np.zeros(n, bool)
    if n:
        begin[0] = inside[0]
        begin[1:] = inside[1:] & (~inside[:-1] | (sure[1:] & sure[:-1] & ((kinds[1:] != kinds[:-1]) | (kinds[1:] == DIGIT))))
        at = offsets[:-1][offsets[:-1] < n]
        begin[at] |= inside[at]
    starts = np.flatnonzero(begin)
    stop = np.zeros(n + 1, bool)
    stop[starts] = True
    if n:
        stop[1:n] |= ~inside[1:] & inside[:-1]
        stop[n] = True
    cuts = np.flatnonzero(stop)
    return starts, cuts[np.searchsorted(cuts, starts, "right")]


def _printable_bytes() -> dict[int, str]:
    """The public byte-to-character rule of byte-level vocabularies: printable Latin-1 bytes stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in plain}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return names


class WordBpe:
    """encode_slice gives the ids of each document of a slice, as the library does without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        vocabulary = self.full.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.names = _printable_bytes()
        self.table = bytescan.ChunkTable(self._solve, np.uint32)

    def _solve(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks in order and how many each has: Latin words in one call on the merges alone."""
        plain, others, texts = [], [], []
        for k, c in enumerate(chunks):
            if c.isalpha():
                plain.append(k)
                texts.append(c.decode())
            elif (s := c.decode()).isalpha() and max(s) < "\u0180" and "\u0130" not in s:
                plain.append(k)
                texts.append(s.lower().encode().decode("latin-1").translate(self.names))
            else:
                others.append(k)
        ids = np.asarray(self.merges.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(plain):
            raise ValueError("the vocabulary does not mark the ends of words")
        rest = [e.ids for e in self.full.encode_batch_fast([chunks[k].decode() for k in others], add_special_tokens=False)]
        offsets = np.concatenate([[0], ends, len(ids) + np.cumsum([len(r) for r in rest], dtype=np.int64)]).astype(np.int64)
        data = np.concatenate([ids, *(np.asarray(r, np.uint32) for r in rest)])
        order = np.empty(len(chunks), np.int64)
        order[np.array(plain + others, np.int64)] = np.arange(len(chunks))
        return bytescan.gather(offsets, data, order)[0], (offsets[1:] - offsets[:-1])[order]

    def encode_slice(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents in order, and the offsets of each document's ids."""
        low = bytescan.LOWER[buf]
        starts, ends = chunk_spans(low, offsets)
        ids, cuts = self.table.lookup(bytescan.span_hashes(low, starts, ends), low, starts, ends)
        cuts = cuts[bytescan.document_of(starts, offsets)]
        raw = buf.tobytes()
        if any(s in raw for s in SPECIALS):  # their strings are single ids to the library, whatever stands around them
            rows = [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                if any(s in raw[a:b] for s in SPECIALS):
                    rows[k] = np.asarray(self.full.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32)
            cuts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
            ids = np.concatenate(rows)
        return ids, cuts
