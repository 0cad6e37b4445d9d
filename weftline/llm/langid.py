"""Operator 4: language identification by a linear-chain conditional random field.

Every word of a text gets a distribution over languages by forward-backward: its features are hashed byte n-grams with
marked borders, affixes (the longer n-grams at a border) and a lexicon of frequent words. Weights of features and of the
transitions between languages follow the exact gradient of the likelihood of code-switched sequences, spliced from
labelled texts. A document's language is that with the largest mean probability of its words.

Texts are cut into blocks of words that are carried through the chain side by side: the product of each block's
transfer matrices gives the messages at its borders, and then all blocks run forward and backward at once. That is
the exact chain over the whole text. A text of more than two slices is read in pieces, twice: first for each piece's transfer
matrix, then with the messages from both sides, so that memory is bounded by the slice (and the longest word).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bytescan

UNKNOWN = "und"
#: About so many distinct labelled texts are sampled for each language.
SAMPLE = 200
#: Words of one text in a row within a training sequence, and their bytes at most (words of thousands of bytes teach nothing).
WORDS = 30
WINDOW_BYTES = 1 << 14
#: About so many windows of one text are learned from, spread over it by hash.
MOST_WINDOWS = 500
ORDERS = (1, 2, 3, 4)
#: Lengths of n-grams that are features at a word's border only.
AFFIXES = (5, 6)
HASHED = 1 << 16
#: A word is in the lexicon from so many occurrences in the sample.
LEXICON_COUNT = 5
EPOCHS = 4
BATCH = 64
SEED = 11
#: Words in a block of the chain.
BLOCK = 32
#: Bytes of text whose chains are in memory at once (about 300 bytes for each).
SLICE = 1 << 18
#: A document is rejected by the filter if no language has half of its words (by their mean probability).
MIN_SCORE = 0.5

_LETTERLESS = np.zeros(256, bool)
_LETTERLESS[[b for b in range(128) if not chr(b).isalpha()]] = True


@dataclass
class Crf:
    """Weights of a trained model; labels are in order."""

    labels: list[str]
    grams: np.ndarray  # HASHED x labels
    lexicon: np.ndarray  # sorted hashes of words
    words: np.ndarray  # len(lexicon) x labels
    moves: np.ndarray  # labels x labels, from row to column
    start: np.ndarray


def gram_features(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-gram features of each word (bytes, with a mark before and after), and their offsets."""
    sizes = ends - starts + 2
    to = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes, out=to[1:])
    marked = np.zeros(int(to[-1]), np.uint64)
    body, _ = bytescan.gather(np.stack([starts, ends], 1).ravel(), buf, 2 * np.arange(len(starts)))
    place = np.ones(len(marked), bool)
    place[to[:-1]] = place[to[1:] - 1] = False
    marked[place] = body.astype(np.uint64) + np.uint64(3)
    marked[to[:-1]], marked[to[1:] - 1] = 1, 2
    word = np.repeat(np.arange(len(starts), dtype=np.int32), sizes)
    found, owner = [], []
    rolling = np.zeros(len(marked), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(AFFIXES) + 1):
            m = len(marked) - n + 1
            if m <= 0:
                break
            rolling = rolling[:m] * np.uint64(0x100000001B3) + marked[n - 1 :]
            if n in ORDERS or n in AFFIXES:
                fit = np.flatnonzero(word[:m] == word[n - 1 :])
                if n in AFFIXES:
                    fit = fit[(marked[fit] == 1) | (marked[fit + n - 1] == 2)]
                found.append((bytescan.mix(rolling[fit] + np.uint64(n) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(HASHED - 1)).astype(np.int32))
                owner.append(word[fit])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=len(starts)), out=at[1:])
    return found[order], at


def _lexicon_rows(lexicon: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Each hash's place in the lexicon, or -1."""
    if not len(lexicon):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)
    return np.where(lexicon[at] == hashes, at, -1)


def _scores(model: Crf, features: np.ndarray, at: np.ndarray, lexical: np.ndarray) -> np.ndarray:
    """Emission scores of words; features are averaged so that long words weigh like short ones."""
    sums = np.add.reduceat(model.grams[features], at[:-1], axis=0) / np.sqrt(np.diff(at))[:, None]
    sums[lexical >= 0] += model.words[lexical[lexical >= 0]]
    return sums


class _Lanes:
    """The documents' words in blocks that are carried side by side. head: the message before each document's first word
    (instead of the start scores); tail: what comes back to its last word."""

    def __init__(self, emit: np.ndarray, cuts: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int, head: np.ndarray | None, tail: np.ndarray | None):
        n_labels = emit.shape[1]
        sizes = np.diff(cuts)
        docs = np.flatnonzero(sizes)
        self.blocks = blocks = -(-sizes[docs] // block)
        self.lane0 = lane0 = np.concatenate([[0], np.cumsum(blocks)])  # first lane of each document
        self.block, self.lanes, self.a, self.start = block, int(lane0[-1]), np.exp(moves), np.exp(start)
        owner = np.repeat(np.arange(len(docs)), sizes[docs])
        inside = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(sizes[docs])[:-1]]), sizes[docs])
        self.lane, self.step = lane0[owner] + inside // block, inside % block
        self.place = np.repeat(cuts[docs], sizes[docs]) + inside
        raw = emit[self.place]
        self.e = np.ones((block, self.lanes, n_labels))
        self.e[self.step, self.lane] = np.exp(raw - raw.max(1, keepdims=True))
        self.length = np.full(self.lanes, block)
        self.length[lane0[1:] - 1] = sizes[docs] - (blocks - 1) * block
        self.first = np.zeros(self.lanes, bool)
        if head is None:
            self.first[lane0[:-1]] = True
        # from the message before the block to that at its end (moves come before each word); a first block forgets what
        # was before it, so that any message of sum one may stand there
        transfer = np.broadcast_to(np.eye(n_labels), (self.lanes, n_labels, n_labels)).copy()
        for t in range(block):
            active = slice(None) if t < self.length.min() else self.length > t
            part = (transfer[active].reshape(-1, n_labels) @ self.a).reshape(-1, n_labels, n_labels) * self.e[t][active][:, None, :]
            if t == 0:  # every block has a first word
                part[self.first] = (self.start * self.e[0][self.first])[:, None, :]
            transfer[active] = part / part.max((1, 2), keepdims=True)
        self.transfer = transfer
        self.before = np.full((self.lanes, n_labels), 1 / n_labels)
        if head is not None:
            self.before[lane0[:-1]] = head
        self.after = np.ones((self.lanes, n_labels))  # what the next block sends back to the last word of this one
        if tail is not None:
            self.after[lane0[1:] - 1] = tail

    def exchange(self) -> None:
        """The messages at the borders of all blocks."""
        order = np.argsort(-self.blocks, kind="stable")
        lead, depth = self.lane0[:-1][order], self.blocks[order]
        for k in range(1, int(depth[0])):
            now = lead[: int(np.searchsorted(-depth, -k, "left"))] + k
            m = np.einsum("ni,nij->nj", self.before[now - 1], self.transfer[now - 1])
            self.before[now] = m / m.sum(1, keepdims=True)
        for k in range(int(depth[0]) - 1, 0, -1):
            now = lead[: int(np.searchsorted(-depth, -k, "left"))] + k
            m = np.einsum("nij,nj->ni", self.transfer[now], self.after[now])
            self.after[now - 1] = m / m.max(1, keepdims=True)

    def marginals(self) -> np.ndarray:
        """Of the documents' words in order."""
        forward = np.empty_like(self.e)
        f = self.before
        for t in range(self.block):
            f = (f @ self.a) * self.e[t]
            if t == 0:
                f[self.first] = self.start * self.e[0][self.first]
            f = f / f.sum(1, keepdims=True)
            forward[t] = f
        marg, b, full = np.empty_like(self.e), self.after, self.length == self.block
        for t in range(self.block - 1, -1, -1):
            if t == self.block - 1:
                b = self.after.copy()
                b[~full] = 1.0
            else:
                b = (self.e[t + 1] * b) @ self.a.T
                b /= b.max(1, keepdims=True)
                ended = self.length == t + 1
                b[ended] = self.after[ended]
            g = forward[t] * b
            marg[t] = g / g.sum(1, keepdims=True)
        return marg[self.step, self.lane]


def chain_marginals(emit: np.ndarray, cuts: np.ndarray, moves: np.ndarray, start: np.ndarray, block: int = BLOCK, head: np.ndarray | None = None, tail: np.ndarray | None = None) -> np.ndarray:
    """Exact marginals of every word. emit: scores, words x labels; cuts: offsets of the documents' words. head and tail:
    messages from what stands before and after, for a piece of a document."""
    out = np.zeros_like(emit)
    if cuts[-1] > cuts[0]:
        lanes = _Lanes(emit, cuts, moves, start, block, head, tail)
        lanes.exchange()
        out[lanes.place] = lanes.marginals()
    return out


def chain_transfer(emit: np.ndarray, moves: np.ndarray, start: np.ndarray | None, block: int = BLOCK) -> np.ndarray:
    """The matrix that carries a message over all these words, up to its scale; with start scores for a text's first words."""
    n = emit.shape[1]
    lanes = _Lanes(emit, np.array([0, len(emit)]), moves, np.zeros(n) if start is None else start, block, np.ones(n) if start is None else None, None)
    out = np.eye(n)
    for t in lanes.transfer:
        out = out @ t
        out /= out.max()
    return out


def expectations(emit: np.ndarray, bounds: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of short sequences side by side: every word's marginals, the expected number of each transition, and the
    sum of the log partition functions."""
    sizes = np.diff(bounds)
    count, longest, n = len(sizes), int(sizes.max()), emit.shape[1]
    owner = np.repeat(np.arange(count), sizes)
    inside = np.arange(len(emit)) - bounds[owner]
    top = emit.max(1)
    e, live = np.ones((longest, count, n)), np.arange(longest)[:, None] < sizes
    e[inside, owner] = np.exp(emit - top[:, None])
    a, total = np.exp(moves), float(top.sum())
    forward = np.empty_like(e)
    f = np.exp(start) * e[0]
    for t in range(longest):
        if t:
            f = np.where(live[t][:, None], (f @ a) * e[t], f)
        scale = f.sum(1, keepdims=True)
        total += float(np.log(scale).sum())
        f = f / scale
        forward[t] = f
    marg, pairs, b = np.empty_like(e), np.zeros((n, n)), np.ones((count, n))
    for t in range(longest - 1, -1, -1):
        if t < longest - 1:
            on = live[t + 1]
            right = e[t + 1] * b
            cell = forward[t][:, :, None] * a * right[:, None, :]
            pairs += (cell / cell.sum((1, 2), keepdims=True))[on].sum(0)
            b = np.where(on[:, None], right @ a.T, 1.0)
            b /= b.max(1, keepdims=True)
        g = forward[t] * b
        marg[t] = g / g.sum(1, keepdims=True)
    return marg[inside, owner], pairs, total


def gradients(emit: np.ndarray, gold: np.ndarray, bounds: np.ndarray, moves: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of the negative log likelihood of the gold labels: by emission scores, by moves, by start scores; and its value."""
    marg, pairs, total = expectations(emit, bounds, moves, start)
    words = np.arange(len(gold))
    inner = np.ones(len(gold), bool)
    inner[bounds[:-1]] = False
    right = np.flatnonzero(inner)
    value = total - emit[words, gold].sum() - moves[gold[right - 1], gold[right]].sum() - start[gold[bounds[:-1]]].sum()
    marg[words, gold] -= 1
    np.subtract.at(pairs, (gold[right - 1], gold[right]), 1.0)
    return marg, pairs, marg[bounds[:-1]].sum(0), float(value)


def train(samples: list[tuple[str, str]], seed: int = SEED) -> Crf | None:
    """A model from (label, text) samples; None without any word."""
    samples = [(lang, text) for lang, text in samples if text.strip()]
    if not samples:
        return None
    labels = sorted({lang for lang, _ in samples})
    rng = np.random.default_rng(seed)
    raw = [t.encode() for _, t in samples]
    buf = bytescan.LOWER[np.frombuffer(b"".join(raw), np.uint8)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    starts, ends = bytescan.spans(buf, offsets, bytescan.WORD_SEPARATORS)
    cuts = bytescan.document_of(starts, offsets)
    # features of each distinct word
    known, seen_at, word, times = np.unique(bytescan.span_hashes(buf, starts, ends, 1 << 15), return_index=True, return_inverse=True, return_counts=True)
    parts = [gram_features(buf, starts[seen_at[k : k + 4096]], ends[seen_at[k : k + 4096]]) for k in range(0, len(known), 4096)]
    features = np.concatenate([f for f, _ in parts])
    at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(a) for _, a in parts]))])
    word = word.ravel().astype(np.int32)
    lexicon = known[times >= LEXICON_COUNT]
    lexical = _lexicon_rows(lexicon, known)
    del buf, raw, starts, ends, parts
    n = len(labels)
    model = Crf(labels, np.zeros((HASHED, n)), lexicon, np.zeros((len(lexicon), n)), np.eye(n), np.zeros(n))
    gold_of = {lang: i for i, lang in enumerate(labels)}
    # all words of each text, so many in a row
    windows = [(p, min(p + WORDS, int(cuts[k + 1])), gold_of[samples[k][0]]) for k in range(len(samples)) for p in range(int(cuts[k]), int(cuts[k + 1]), WORDS)]
    sums = [np.full_like(x, 1e-6) for x in (model.grams, model.words, model.moves, model.start)]
    length = 2 * WORDS

    def step(param: np.ndarray, total: np.ndarray, rows, grad: np.ndarray, rate: float) -> None:
        total[rows] += grad * grad
        param[rows] -= rate * grad / np.sqrt(total[rows])

    for _ in range(EPOCHS):
        rng.shuffle(windows)
        sequences, now, gold = [], [], []
        for s, e, y in windows:  # code-switched sequences: pieces of windows one after the other
            cut = int(rng.integers(s + 1, e + 1))
            for p, q in ((s, cut), (cut, e)):
                if q > p:
                    now.extend(range(p, q))
                    gold.extend([y] * (q - p))
                if rng.random() < 0.5:
                    break
            if len(now) >= length:
                sequences.append((np.array(now[:length], np.int32), np.array(gold[:length], np.int16)))
                now, gold = [], []
        if now:
            sequences.append((np.array(now, np.int32), np.array(gold, np.int16)))
        for k in range(0, len(sequences), BATCH):
            batch = sequences[k : k + BATCH]
            flat = np.concatenate([s for s, _ in batch])
            y = np.concatenate([g for _, g in batch]).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum([len(s) for s, _ in batch])])
            feats, fat = bytescan.gather(at, features, word[flat])
            lex = lexical[word[flat]]
            emit = _scores(model, feats, fat, lex)
            delta, grad_moves, grad_start, _ = gradients(emit, y, bounds, model.moves, model.start)
            scale = 1 / len(batch)
            scaled = delta / np.sqrt(np.diff(fat))[:, None]
            rows = np.flatnonzero(np.bincount(feats, minlength=HASHED))
            grad = np.stack([np.bincount(feats, np.repeat(c, np.diff(fat)), HASHED)[rows] for c in scaled.T], 1)
            step(model.grams, sums[0], rows, grad * scale + 1e-5 * model.grams[rows], 0.2)
            has = lex >= 0
            if has.any():
                rows = np.flatnonzero(np.bincount(lex[has], minlength=len(lexicon)))
                grad = np.stack([np.bincount(lex[has], c, len(lexicon))[rows] for c in delta[has].T], 1)
                step(model.words, sums[1], rows, grad * scale + 1e-5 * model.words[rows], 0.2)
            step(model.moves, sums[2], slice(None), grad_moves * scale, 0.1)
            step(model.start, sums[3], slice(None), grad_start * scale, 0.1)
    model.grams = model.grams.astype(np.float32)
    bytescan.release()
    return model


def word_scores(model: Crf, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Emission scores of all words (zeros for those without a letter), which words have a letter, the documents' cuts."""
    low = bytescan.LOWER[buf]
    starts, ends = bytescan.spans(low, offsets, bytescan.WORD_SEPARATORS)
    cuts = bytescan.document_of(starts, offsets)
    if not len(starts):
        return np.zeros((0, len(model.labels))), np.zeros(0, bool), cuts
    hashes = bytescan.span_hashes(low, starts, ends)
    unique, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    features, at = gram_features(low, starts[first], ends[first])
    blanks = np.zeros(len(low) + 1, np.int64)
    np.cumsum(_LETTERLESS[low], out=blanks[1:])
    lettered = (blanks[ends[first]] - blanks[starts[first]]) < ends[first] - starts[first]
    scores = _scores(model, features, at, _lexicon_rows(model.lexicon, unique)) * lettered[:, None]
    inverse = inverse.ravel()
    return scores[inverse], lettered[inverse], cuts


def predict_slice(model: Crf, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean marginals of each document's words with a letter, documents x labels; zeros for documents without such words."""
    if len(offsets) == 2 and len(buf) > 2 * SLICE:
        sums = _long_sums(model, buf)[None]
    else:
        scores, lettered, cuts = word_scores(model, buf, offsets)
        marg = chain_marginals(scores, cuts, model.moves, model.start) * lettered[:, None]
        total = np.zeros((len(marg) + 1, len(model.labels)))
        np.cumsum(marg, axis=0, out=total[1:])
        sums = total[cuts[1:]] - total[cuts[:-1]]
    return sums / np.maximum(sums.sum(1, keepdims=True), 1e-12)


def _pieces(buf: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Pieces of about so many bytes, cut between words; a longer word makes a longer piece."""
    out, lo = [], 0
    while lo < len(buf):
        hi = lo + size
        while hi < len(buf):
            gap = np.flatnonzero(bytescan.WORD_SEPARATORS[buf[hi : hi + size]])
            if len(gap):
                hi += int(gap[0])
                break
            hi += size
        hi = min(hi, len(buf))
        out.append((lo, hi))
        lo = hi
    return out


def _long_sums(model: Crf, buf: np.ndarray, size: int = SLICE) -> np.ndarray:
    """Summed marginals of the words with a letter of one text, read in pieces."""
    n = len(model.labels)
    pieces, carries = [], []
    for lo, hi in _pieces(buf, size):
        scores, _, _ = word_scores(model, buf[lo:hi], np.array([0, hi - lo]))
        if len(scores):
            carries.append(chain_transfer(scores, model.moves, None if pieces else model.start))
            pieces.append((lo, hi))
    tails = [np.ones(n)] * len(pieces)
    for k in range(len(pieces) - 2, -1, -1):
        m = carries[k + 1] @ tails[k + 1]
        tails[k] = m / m.max()
    head, sums = np.full(n, 1 / n), np.zeros(n)
    for k, (lo, hi) in enumerate(pieces):
        scores, lettered, cuts = word_scores(model, buf[lo:hi], np.array([0, hi - lo]))
        sums += chain_marginals(scores, cuts, model.moves, model.start, head=head[None] if k else None, tail=tails[k][None])[lettered].sum(0)
        head = head @ carries[k]
        head /= head.sum()
    return sums


def _training_windows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, trainable: Column) -> list[tuple[str, str]]:
    """(language, words in a row) of a sample of the distinct labelled texts, by hash: about SAMPLE for each language, and
    about MOST_WINDOWS windows of each, spread over the whole text. Only windows come to the driver, whatever a text's size."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), trainable.alias("ok")).where("ok and lang is not null and text is not null")
    key = F.xxhash64("text", F.lit(SEED))  # copies have one hash, so that a common text counts once, here and below
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct(key, 0.02).alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 20, -(-(SAMPLE << 20) // max(1, n))))).otherwise(share)
    picked = rows.where(F.pmod(key, F.lit(1 << 20)) < share).select("lang", "text").distinct()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offsets, _ in bytescan.text_slices(batch, "text"):
                starts, ends = bytescan.spans(buf, offsets, bytescan.WORD_SEPARATORS)
                cuts = bytescan.document_of(starts, offsets).tolist()
                firsts = [np.arange(a, b, WORDS) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                of_text = np.array([len(f) for f in firsts])
                first = np.concatenate(firsts)
                owner = np.repeat(np.arange(part.num_rows), of_text)
                last = np.minimum(first + WORDS, np.array(cuts)[owner + 1]) - 1
                lo, hi = starts[first], ends[last]
                drawn = (bytescan.mix(bytescan.span_hashes(buf, lo, hi)) >> np.uint64(44)).astype(np.int64)
                keep = (drawn * of_text[owner] < MOST_WINDOWS << 20) & (hi - lo <= WINDOW_BYTES)
                texts = [buf[i:j].tobytes() for i, j in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner[keep])), pa.array(texts, pa.binary())], ["lang", "words"])

    return sorted((r["lang"], bytes(r["words"]).decode()) for r in picked.mapInArrow(cut, "lang string, words binary").collect())


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for null ids."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """The model of the labelled documents whose crc32(id) mod 4 is not 2; None if no label or no word is left. Rows with a null
    id, text or label are not learned from, copies of a text count once, and of a very long text the windows of words that
    are learned from are spread over all of it."""
    known = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(False))
    return train(_training_windows(docs, id_col, text_col, lang_col, known))


def predict(text: Column, model: Crf | None) -> Column:
    """A struct of the predicted language (lang) and its score."""

    def scan(buf: np.ndarray, offsets: np.ndarray) -> list[pa.Array]:
        n = len(offsets) - 1
        names, best = np.array([UNKNOWN] * n, object), np.zeros(n)
        cuts = [0]  # chains of so many bytes of text are in memory at once
        while cuts[-1] < n:
            cuts.append(max(cuts[-1] + 1, int(np.searchsorted(offsets, offsets[cuts[-1]] + SLICE, "right")) - 1))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own, off = buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            # a letter is what Unicode calls one; ASCII decides nearly always
            letters = np.zeros(len(own) + 1, np.int32)
            np.cumsum((own < 128) & ~_LETTERLESS[own], out=letters[1:])
            has = letters[off[1:]] > letters[off[:-1]]
            for k in np.flatnonzero(~has & (np.diff(off) > 0)).tolist():
                has[k] = any(map(str.isalpha, own[off[k] : off[k + 1]].tobytes().decode()))
            if model is not None and has.any():
                mean = predict_slice(model, own, off)
                at = a + np.flatnonzero(has)
                names[at] = np.array(model.labels, object)[mean.argmax(1)][has]
                best[at] = np.clip(mean.max(1), 0, 1)[has]
        return [pa.array(names.tolist(), pa.string()), pa.array(best)]

    return bytescan.text_column(scan, [("lang", "string"), ("score", "double")])(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (mean probability of the predicted language, 0 for und).

    Texts that are null, empty or without a letter are "und"; so are all if there is nothing to learn from. Very long texts
    are read whole, in pieces. Of languages with equal means the first in order wins. Null ids are neither held out nor
    learned from. Repeated rows are predicted one by one, alike, and learned from once; other columns are not read.
    """
    model = fit(docs, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), predict(F.col(text_col).cast("string"), model).alias("p"))
    return rows.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score")


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without those that have no language or a score under MIN_SCORE; all columns stay as they are, whatever their names.

    Null, empty and letterless texts go, and all texts where nothing can be learned; very long ones are judged whole, in pieces;
    repeated rows each stay or go alike; null ids are judged like others; of no documents none are left.
    """
    mark = "__lang"
    while mark in docs.columns:
        mark += "_"
    judged = docs.select("*", predict(F.col(text_col).cast("string"), fit(docs, id_col, text_col, lang_col)).alias(mark))
    return judged.where((F.col(f"{mark}.lang") != UNKNOWN) & (F.col(f"{mark}.score") >= MIN_SCORE)).drop(mark)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
