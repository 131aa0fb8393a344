"""Toxicity by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Two words are as alike as the subsequences of three characters that they share, each weighted down by the
stretch it spans; characters put in between and inflected forms lower the likeness only a little. A bounded
sample of labelled rows gives the landmarks: stretches of words that tell toxic texts from others, so that words
never seen before are known by their stem, and the ordinary words most like these. A word's features are the
highest kernel values of its own stretches with the landmarks, whitened. Only
texts are labelled, so the machine learns from witnesses: in a toxic text the word that scores highest, in
other texts every word. A text's score is that of its worst word, calibrated on the labelled texts. Of a word or a
run of spelled letters that is too long to be compared at once, every stretch as long as a landmark is scored too.

The kernel is worked out once for each word type of a worker, and only with the landmarks with which the type
shares enough character pairs in order; with the others it counts as 0, in training as in scoring.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from heapq import heapify, heappop, heapreplace
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import draw, ship, tidy
from .textcore import Block, TypeTable, blocks, mix

#: Bytes that are compared at once, length of the subsequences, decay for each character spanned, widest gap of a pair.
WIDTH, ORDER, DECAY, GAP = 24, 3, 0.6, 2
#: Share of a landmark's neighbouring pairs that a word must have in order.
GUARD = 0.6
#: Labelled rows of each class to learn from, at most; landmarks of either kind, at most.
SAMPLE_ROWS, LANDMARKS, CONTRAST = 3000, 64, 24
#: Bytes of a stretch that may be a landmark, the mark of a word's start included.
STRETCH = range(5, 9)
#: Log-likelihood ratio from which a stretch tells toxic texts from others.
TELLING = 25.0
#: Characters before which a word is cut; single letters in a row that are read as one word.
MARKS, SPELLED = b".,!?;:|", 4

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_POWERS = np.triu(DECAY ** np.maximum(np.arange(WIDTH)[None, :] - np.arange(WIDTH)[:, None], 0)).astype(np.float32)


def kernel(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The gap-weighted subsequence kernel of aligned words (n, WIDTH), zero-padded."""
    n = len(s)
    width = int((t != 0).sum(axis=1).max()) if n else 0
    t, powers = t[:, :width], _POWERS[:width, :width]
    before = [np.ones((n, width + 1), dtype=np.float32), *[np.zeros((n, width + 1), dtype=np.float32) for _ in range(ORDER - 1)]]
    total = np.zeros(n)
    longest = int((s != 0).sum(axis=1).max()) if n else 0
    for i in range(longest):
        same = (s[:, i, None] == t) & (t != 0)
        ends = [same * (np.float32(DECAY**2) * b[:, :-1]) for b in before]
        total += ends[-1].sum(axis=1)
        on = s[:, i, None] != 0
        for k in range(1, ORDER):
            before[k][:, 1:] = np.where(on, np.float32(DECAY) * before[k][:, 1:] + ends[k - 1] @ powers, before[k][:, 1:])
    return total


def fold(chars: np.ndarray) -> np.ndarray:
    """Words with A-Z lower-cased, without the characters that are no letters, and with a mark in front for their start."""
    odd = np.flatnonzero(((chars != 0) & ~_LETTER[chars]).any(axis=1))
    out = _FOLD[chars]
    if len(odd):
        some = out[odd]
        some[~_LETTER[some]] = 0
        out[odd] = np.take_along_axis(some, np.argsort(some == 0, axis=1, kind="stable"), axis=1)
    marked = np.zeros_like(out)
    marked[:, 1:] = out[:, :-1]
    marked[:, 0] = out[:, 0] != 0
    return marked


def encode(words: list[bytes]) -> np.ndarray:
    out = np.zeros((len(words), WIDTH), dtype=np.uint8)
    for k, w in enumerate(words):
        out[k, : min(len(w), WIDTH)] = np.frombuffer(w[:WIDTH], dtype=np.uint8)
    return fold(out)


def stretches(word: bytes, lengths: list[int]) -> Iterator[np.ndarray]:
    """The parts of a long word as if each were a word, folded: what stands between characters that are no letters, and every stretch of its letters of the given lengths."""
    letter = np.frombuffer(word, dtype=np.uint8)
    kept = _LETTER[letter]
    parts = {p for p in bytes(np.where(kept, letter, 32).astype(np.uint8)).split(b" ") if ORDER <= len(p) < WIDTH}
    if parts:
        yield encode(sorted(parts))
    letters = _FOLD[letter[kept]]
    for n in lengths:
        for a in range(0, len(letters) - n + 1, 1 << 14):
            seen = np.lib.stride_tricks.sliding_window_view(letters[a : a + (1 << 14) + n - 1], n)
            out = np.zeros((len(seen), WIDTH), dtype=np.uint8)
            out[:, 0], out[:, 1 : n + 1] = 1, seen
            yield out


@dataclass
class Machine:
    """Landmarks, the whitening of their kernel, the weights, and the calibration of a text's worst word."""

    landmarks: np.ndarray
    whiten: np.ndarray
    weights: np.ndarray
    bias: float = -1.0
    slope: float = 4.0
    offset: float = 0.0
    pairs: np.ndarray = field(init=False)
    need: np.ndarray = field(init=False)
    own: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        m = len(self.landmarks)
        self.pairs = np.zeros((1 << 16, max(m, 1)), dtype=np.uint8)
        size = (self.landmarks != 0).sum(axis=1) if m else np.zeros(0, dtype=int)
        for k in range(m):
            a, b = self.landmarks[k, : size[k] - 1].astype(int), self.landmarks[k, 1 : size[k]].astype(int)
            self.pairs[a << 8 | b, k] = 1
        distinct = self.pairs[:, :m].sum(axis=0, dtype=int) if m else np.zeros(0, dtype=int)
        self.need = np.maximum(np.ceil(GUARD * distinct), 2).astype(int)
        self.own = np.sqrt(np.maximum(kernel(self.landmarks, self.landmarks), 1e-12)) if m else np.zeros(0)

    def likeness(self, words: np.ndarray) -> np.ndarray:
        """Normalised kernel values (words, landmarks) of folded words; 0 where the guard doesn't hold."""
        m = len(self.landmarks)
        out = np.zeros((len(words), m), dtype=np.float32)
        for a in range(0, len(words), 1 << 14):
            w = words[a : a + (1 << 14)]
            hits = np.zeros((len(w), m), dtype=np.uint8)
            c = w.astype(np.int64)
            for gap in range(1, GAP + 1):
                for i in range(WIDTH - gap):
                    on = np.flatnonzero(c[:, i + gap])
                    if not len(on):
                        break
                    hits[on] += self.pairs[c[on, i] << 8 | c[on, i + gap], :m]
            row, col = np.nonzero(hits >= self.need[None, :])
            for b in range(0, len(row), 1 << 14):
                r, k = row[b : b + (1 << 14)], col[b : b + (1 << 14)]
                np.maximum.at(out, (a + r, k), self._nearest(w[r], k))
        return out

    def _nearest(self, words: np.ndarray, col: np.ndarray) -> np.ndarray:
        """The highest normalised kernel value of each word's stretches, as long as its landmark or a character longer, with that landmark; the guard holds for a stretch too."""
        size, best = (words != 0).sum(axis=1), np.zeros(len(words))
        c, every, needed = words.astype(np.int64), np.arange(len(words)), self.need[col]
        # pairs of each gap that begin before a place
        before = np.zeros((GAP, len(words), WIDTH + 1), dtype=np.int16)
        for gap in range(1, GAP + 1):
            shared = self.pairs[c[:, :-gap] << 8 | c[:, gap:], col[:, None]]
            np.cumsum(shared, axis=1, out=before[gap - 1, :, 1 : WIDTH - gap + 1])
        for more in (0, 1):
            width = np.minimum((self.landmarks[col] != 0).sum(axis=1) + more, size)
            for start in range(int((size - width).max()) + 1):
                hits = sum(b[every, np.minimum(np.maximum(start + width - gap, start), WIDTH - gap)] - b[:, start] for gap, b in enumerate(before, 1))
                on = np.flatnonzero((start + width <= size) & (hits >= needed))
                if not len(on):
                    continue
                part = np.zeros((len(on), WIDTH), dtype=np.uint8)
                part[:, : WIDTH - start] = words[on, start:]
                part[np.arange(WIDTH)[None, :] >= width[on, None]] = 0
                norm = np.sqrt(np.maximum(kernel(part, part), 1e-12))
                best[on] = np.maximum(best[on], kernel(part, self.landmarks[col[on]]) / (norm * self.own[col[on]]))
        return best

    def words(self, words: np.ndarray) -> np.ndarray:
        """Decision values of folded words."""
        if not len(self.landmarks):
            return np.full(len(words), self.bias)
        return self.likeness(words) @ (self.whiten @ self.weights) + self.bias

    def long_word(self, word: bytes) -> float:
        """The highest decision value of the stretches of a word that is longer than WIDTH."""
        sizes = {int(n) - 1 for n in (self.landmarks != 0).sum(axis=1)} | {WIDTH - 1} if len(self.landmarks) else set()
        return max((float(self.words(x).max()) for x in stretches(word, sorted(sizes - {0}))), default=self.bias)

    def probability(self, worst: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.offset, -30, 30)))


def spelled(block: Block) -> list[tuple[int, bytes]]:
    """(text number, word) of runs of at least SPELLED single letters with white space between."""
    size = block.end - block.start
    one = (size == 1) & _LETTER[block.buf[block.start]] if len(size) else np.zeros(0, dtype=bool)
    if one.sum() < SPELLED:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[False], one, [False]]).astype(np.int8)))
    out = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        for d in np.unique(block.doc[a:b]).tolist():
            at = np.flatnonzero(block.doc[a:b] == d) + a
            if len(at) >= SPELLED:
                out.append((d, block.buf[block.start[at]].tobytes()))
    return out


def worst_words(block: Block, machine: Machine, table: TypeTable) -> np.ndarray:
    """The highest decision value of each text's words; a text without words has the bias."""
    out = np.full(block.n, machine.bias)
    if len(block.start):

        def make(at: np.ndarray) -> np.ndarray:
            value = machine.words(fold(block.characters(at, WIDTH)[0]))
            for k in np.flatnonzero(block.end[at] - block.start[at] >= WIDTH).tolist():
                value[k] = max(value[k], machine.long_word(block.buf[block.start[at[k]] : block.end[at[k]]].tobytes()))
            return value[:, None]

        np.maximum.at(out, block.doc, table.of(block.hash, make)[:, 0])
        if runs := spelled(block):
            np.maximum.at(out, np.array([d for d, _ in runs]), machine.words(encode([w for _, w in runs])))
            if far := [(d, machine.long_word(w)) for d, w in runs if len(w) >= WIDTH]:
                np.maximum.at(out, np.array([d for d, _ in far]), np.array([v for _, v in far]))
    return out


def svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last weight is the bias, which is not shrunk."""
    x = np.column_stack([z, np.ones(len(z))])
    w = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], ridge)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xs, ws = x[on], weight[on]
        gradient = shrink * w - (xs * (ws * y[on] * slack[on])[:, None]).sum(axis=0)
        step = np.linalg.solve(np.diag(shrink) + (xs * ws[:, None]).T @ xs, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def platt(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the labels over the scores, lightly shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        h = (a * (p * (1 - p) + 1e-9)[:, None]).T @ a + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def _ratio(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> np.ndarray:
    """Twice the log-likelihood ratio of counts in texts of either kind against one rate for both."""

    def part(k: np.ndarray, n: int, rate: np.ndarray) -> np.ndarray:
        return k * np.log(np.maximum(rate, 1e-300)) + (n - k) * np.log(np.maximum(1 - rate, 1e-300))

    both = (bad + good) / (n_bad + n_good)
    return 2 * (part(bad, n_bad, bad / n_bad) + part(good, n_good, good / n_good) - part(bad, n_bad, both) - part(good, n_good, both))


def telling_stretches(codes: np.ndarray, bad: list[np.ndarray], good: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(landmarks, types with one of them): stretches of word types that tell the bad texts, given by their types, from the good ones.

    The most telling stretch comes first, the longest of equal ones. Types that have a chosen stretch count no more
    for others, so inflected forms take no places of their own.
    """
    n_bad, n_good = len(bad), len(good)
    pairs, value = [], []
    for n in STRETCH:
        at = np.zeros((len(codes), WIDTH - n + 1), dtype=np.uint64)
        for k in range(n):
            at = at << np.uint64(8) | codes[:, k : WIDTH - n + 1 + k].astype(np.uint64)
        at[codes[:, n - 1 :] == 0] = 0
        names, many = np.unique(np.concatenate([np.unique(at[ks]) for ks in bad]), return_counts=True)
        names, many = names[(many >= 3) & (names > 0)], many[(many >= 3) & (names > 0)]
        if not len(names):
            continue
        clean = np.zeros(len(names), dtype=np.int64)
        for ks in good:
            x = np.unique(at[ks])
            k = np.minimum(np.searchsorted(names, x), len(names) - 1)
            clean[k[names[k] == x]] += 1
        names = names[(many * n_good > 10 * clean * n_bad) & (_ratio(many, clean, n_bad, n_good) > TELLING)]
        if len(names):
            k = np.minimum(np.searchsorted(names, at), len(names) - 1)
            row, col = np.nonzero(names[k] == at)
            pairs.append(np.unique(np.column_stack([k[row, col] + len(value), row]), axis=0))
            value += [(n, int(x)) for x in names]
    free = np.ones(len(codes), dtype=bool)
    if not value:
        return np.zeros((0, WIDTH), dtype=np.uint8), ~free
    texts = [np.concatenate(x) for x in zip(*((ks, np.full(len(ks), d)) for d, ks in enumerate([*bad, *good])), strict=True)]
    order = np.argsort(texts[0], kind="stable")
    of_type, first = texts[1][order], np.searchsorted(texts[0][order], np.arange(len(codes) + 1))
    every = np.concatenate(pairs)
    edge = np.searchsorted(every[:, 0], np.arange(len(value) + 1))

    def rank(c: int) -> tuple:
        types = every[edge[c] : edge[c + 1], 1]
        seen = np.unique(np.concatenate([of_type[first[t] : first[t + 1]] for t in types[free[types]]] or [np.zeros(0, dtype=int)]))
        b, g = int((seen < n_bad).sum()), int((seen >= n_bad).sum())
        ok = b >= 3 and b * n_good > 10 * g * n_bad
        return (-float(_ratio(np.array(b), np.array(g), n_bad, n_good)) if ok else 0.0, -value[c][0], value[c][1], c)

    heap, chosen = [rank(c) for c in range(len(value))], []
    heapify(heap)
    while heap and len(chosen) < LANDMARKS and -heap[0][0] > TELLING:
        now = rank(heap[0][3])
        if now > heap[0]:
            heapreplace(heap, now)
            continue
        c = heappop(heap)[3]
        chosen.append(value[c][1].to_bytes(value[c][0], "big"))
        free[every[edge[c] : edge[c + 1], 1]] = False
    marks = np.zeros((len(chosen), WIDTH), dtype=np.uint8)
    for k, x in enumerate(chosen):
        marks[k, : len(x)] = np.frombuffer(x, dtype=np.uint8)
    return marks, ~free


def _kin(words: list[list[bytes]]) -> np.ndarray:
    """A group number for each sampled text: near copies count as one text. Texts that agree in one of four triples of smallest hashes are grouped."""
    kin = np.arange(len(words))
    factors = np.random.default_rng(5).integers(1, 1 << 62, 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    seen: dict[tuple, int] = {}

    def top(x: int) -> int:
        while kin[x] != x:
            kin[x] = kin[kin[x]]
            x = int(kin[x])
        return x

    for d, ws in enumerate(words):
        if not ws:
            continue
        h = np.array([crc32(w) for w in ws], dtype=np.uint64)
        low = [int(mix(h * f).min()) for f in factors]
        for band in range(4):
            key = (band, *low[3 * band : 3 * band + 3])
            a, b = top(d), top(seen.setdefault(key, d))
            kin[max(a, b)] = min(a, b)
    return np.array([top(d) for d in range(len(words))])


def word_lists(block: Block) -> list[list[bytes]]:
    """The distinct words of each text that the machine learns from, lower-cased, their first WIDTH bytes."""
    raw = block.buf.tobytes().lower()
    each: list[set[bytes]] = [set() for _ in range(block.n)]
    for d, s, e in zip(block.doc.tolist(), block.start.tolist(), block.end.tolist(), strict=True):
        if e - s >= ORDER:
            each[d].add(raw[s : min(e, s + WIDTH)])
    for d, w in spelled(block):
        each[d].add(w.lower()[:WIDTH])
    return [sorted(x) for x in each]


def train(texts: list[tuple[bytes, int]], rounds: int = 8) -> Machine:
    """A machine learned from (UTF-8 text, label) pairs."""
    words = [x for _, _, block in blocks(pa.array([t for t, _ in texts], pa.binary()), fold_ascii=True, marks=MARKS) for x in word_lists(block)]
    return train_words([(ws, y) for ws, (_, y) in zip(words, texts, strict=True)], rounds)


def train_words(texts: list[tuple[list[bytes], int]], rounds: int = 8) -> Machine:
    """A machine learned from (distinct words of a text, label) pairs."""
    empty = Machine(np.zeros((0, WIDTH), dtype=np.uint8), np.zeros((0, 0)), np.zeros(0), -1.0, 1.0, -3.0)
    words = [ws for ws, _ in texts]
    label = np.array([y for _, y in texts], dtype=int)
    if not len(label) or label.min() == label.max():
        return empty
    types = sorted({w for ws in words for w in ws})
    number = {w: k for k, w in enumerate(types)}
    codes = encode(types)
    of_text = [np.array([number[w] for w in ws], dtype=int) for ws in words]
    # near copies count as one text
    kin: list[dict[int, list]] = [defaultdict(list), defaultdict(list)]
    for d, k in enumerate(_kin(words).tolist()):
        kin[label[d]][k].append(of_text[d])
    good, bad = ([np.unique(np.concatenate(x)) for x in side.values()] for side in kin)
    chosen, known = telling_stretches(codes, bad, good)
    if not len(chosen):
        return empty
    # a word that has such a stretch, but by itself doesn't tell toxic texts from others, is no example of it
    often = [np.bincount(np.concatenate(side), minlength=len(codes)) for side in (bad, good)]
    known &= often[0] * len(good) > 10 * often[1] * len(bad)
    clean = np.zeros(len(types), dtype=bool)
    for d in np.flatnonzero(label == 0):
        clean[of_text[d]] = True
    first = Machine(chosen, np.eye(len(chosen)), np.zeros(len(chosen)))
    alike = first.likeness(codes)
    # the clean words most like each landmark in turn, those with equal likenesses once
    clean &= ~known
    ordinary = np.flatnonzero(clean & alike.any(axis=1))
    ordinary = ordinary[np.unique(alike[ordinary], axis=0, return_index=True)[1]]
    ranks = np.argsort(np.argsort(-alike[ordinary], axis=0, kind="stable"), axis=0, kind="stable").min(axis=1) if len(ordinary) else np.zeros(0, dtype=int)
    contrast = ordinary[np.argsort(ranks, kind="stable")[:CONTRAST]]
    marks = np.concatenate([chosen, codes[contrast]])
    base = Machine(marks, np.eye(len(marks)), np.zeros(len(marks)))
    values, vectors = np.linalg.eigh(base.likeness(marks).astype(float) / 2 + base.likeness(marks).T.astype(float) / 2)
    whiten = vectors / np.sqrt(np.maximum(values, 1e-3))
    # words unlike every landmark have no features; one stands for them all
    like = base.likeness(codes)
    some = like.any(axis=1)
    some |= known
    some[contrast] = True
    number = np.where(some, np.cumsum(some), 0)
    z = np.concatenate([np.zeros((1, like.shape[1]), dtype=np.float32), like[some]]) @ whiten
    contrast, of_text = number[contrast], [np.unique(number[ks]) for ks in of_text]
    clean, known = np.concatenate([[True], clean[some]]), np.concatenate([[False], known[some]])
    del like
    # witnesses: in a toxic text the words with a landmark, or else the one that scores highest; in other texts the worst ones, gathered over the rounds
    picked = {d: of_text[d][known[of_text[d]]].tolist() for d in np.flatnonzero(label == 1)}
    start, best = dict(picked), (-1.0, None)
    hard = set(contrast.tolist())
    w = np.zeros(z.shape[1] + 1)
    for turn in range(rounds):
        witness = sorted({k for ks in picked.values() for k in ks})
        if not witness:
            return empty
        bad = np.array(sorted(hard.difference(witness)), dtype=int)
        x = np.concatenate([z[witness], z[bad], np.zeros((1, z.shape[1]))])
        y = np.concatenate([np.ones(len(witness)), -np.ones(len(bad) + 1)])
        weight = np.concatenate([np.full(len(witness), 2.0), np.ones(len(bad) + 1)])
        w = svm(x, y, weight)
        # the round whose worst words tell the sampled texts apart best is kept
        top = np.array([(z[ks] @ w[:-1]).max() + w[-1] if len(ks) else w[-1] for ks in of_text])
        a, b = platt(top, label.astype(float))
        right = float(np.mean((a * top + b > 0) == (label == 1)))
        if right > best[0]:
            best = (right, w)
        if turn + 1 < rounds:
            value = z @ w[:-1] + w[-1]
            for d in np.flatnonzero(label == 0):
                ks = of_text[d]
                hard.update(ks[np.argsort(-value[ks], kind="stable")[:2]].tolist())
            for d in (d for d in picked if not start[d]):
                ks = of_text[d][(value[of_text[d]] > 0) & ~clean[of_text[d]]]
                picked[d] = ks[np.argsort(-value[ks], kind="stable")[:1]].tolist()
    w = best[1]
    machine = Machine(marks, whiten, w[:-1], float(w[-1]))
    value = z @ w[:-1] + w[-1]
    worst = np.array([value[ks].max() if len(ks) else machine.bias for ks in of_text])
    machine.slope, machine.offset = platt(worst, label.astype(float))
    return machine


def learn(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Machine:
    """A machine learned from at most SAMPLE_ROWS usable rows of each label, those with the smallest hashes of their id.

    Null labels, ids and texts take no part. With labels of one kind only, every text scores the same and low.
    """
    marked = labels.where(F.col(doc_id).isNotNull() & usable).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where("y IN (0, 1)").distinct()
    few = reduce(DataFrame.unionByName, [draw(marked.where(F.col("y") == y), "doc_id", SAMPLE_ROWS) for y in (0, 1)])
    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in blocks(batch.column(0), fold_ascii=True, marks=MARKS):
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(low, high - low), pa.array(word_lists(block), pa.list_(pa.binary()))], ["y", "words"])

    # 2 * SAMPLE_ROWS rows of the sample, each word of a text once
    got = rows.join(F.broadcast(few), "doc_id").select("text", "y").mapInArrow(tidy(run), "y int, words array<binary>").toArrow()
    return train_words(sorted(zip(got["words"].to_pylist(), got["y"].to_pylist(), strict=True)))


def score(docs: DataFrame, machine: Machine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted of every whole text.

    Null and empty texts, and texts without words, have the score of the machine's bias. Rows are mapped where
    they lie; null or repeated ids and equal rows stay. Only the id and the text are read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = shared.value, TypeTable(1, dtype=np.float64)
        for batch in batches:
            for low, high, block in blocks(batch.column(1), fold_ascii=True, marks=MARKS):
                p = own.probability(worst_words(block, own, table))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run), f"doc_id {kind}, score double, predicted int")
