"""Language identification by a linear-chain conditional random field over words.

A word's emission scores come from its affixes, its byte n-grams and its entry in a learned lexicon; learned
transitions tie neighbouring words, so code-switched stretches get their own labels. Forward-backward gives the
marginals of every word, exactly and over whole texts: texts are cut into segments of equal length, a segment's
transfer matrix is worked out for all segments at once, matrices are chained along each text, and a second pass
inside the segments yields the marginals. A document's language is the label with the largest mean marginal
over its words with letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, give_back, rows_of, ship, tidy
from .textcore import Block, TypeTable, blocks, mix

#: Hash slots of emission weights; bytes of a piece, longer words are several; words of a segment.
SLOTS, WIDTH, SEGMENT = 1 << 17, 18, 64
#: Sampled stretches from which a word of one language is in the lexicon, and the share of its stretches that are of that language.
LEXICON_TEXTS, LEXICON_SHARE = 3, 0.8
#: Labelled rows of each language to learn from, about; stretches of each, and their characters.
SAMPLE_ROWS, STRETCHES, STRETCH_CHARS = 500, 2, 300
#: Languages that are learned, at most: those of most rows.
LANGS = 1000
#: Characters before which a word of letters is cut.
MARKS = b".,!?;:|"
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


@dataclass
class Lexicon:
    """Words of one language, as sorted hashes, each with the number of its language."""

    words: np.ndarray
    label: np.ndarray

    def of(self, words: np.ndarray) -> np.ndarray:
        """The number of the language of each word, -1 if the word is not in the lexicon."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.label[at], -1)


NO_LEXICON = Lexicon(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))


def word_names(chars: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each whole word, A-Z folded."""
    out = length.astype(np.uint64)
    for k in range(chars.shape[1]):
        out = np.where(k < length, mix(out * np.uint64(257) + _FOLD[chars[:, k]].astype(np.uint64)), out)
    return out


def features(chars: np.ndarray, length: np.ndarray, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(slots, present) of each word's features: its language in the lexicon, itself, prefixes and suffixes of 1 to 4 bytes, n-grams of 2 and 3 bytes. A-Z are folded."""
    c = _FOLD[chars].astype(np.uint64)
    n, width = c.shape
    where = np.arange(width)[None, :]
    out, has = [], []

    def add(value: np.ndarray, kind: int, present: np.ndarray) -> None:
        out.append((mix(value * np.uint64(64) + np.uint64(kind)) & np.uint64(SLOTS - 1)).astype(np.int32))
        has.append(present)

    known = lexicon.of(word_names(chars, length))
    add(np.maximum(known, 0).astype(np.uint64), 12, known >= 0)
    whole = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        whole = np.where(k < length, whole * np.uint64(0x100000001B3) + c[:, k] + np.uint64(1), whole)
        if k < 4:
            add(whole, 1 + k, length > k)
    add(whole, 5, length > 0)
    tail = np.zeros(n, dtype=np.uint64)
    rows = np.arange(n)
    for k in range(4):
        tail = tail * np.uint64(257) + c[rows, np.maximum(length - 1 - k, 0)] + np.uint64(1)
        add(tail, 6 + k, length > k)
    two = c[:, :-1] * np.uint64(257) + c[:, 1:]
    three = two[:, :-1] * np.uint64(257) + c[:, 2:]
    for gram, size, kind in ((two, 2, 10), (three, 3, 11)):
        for k in range(gram.shape[1]):
            add(gram[:, k], kind, where[0, k] + size <= length)
    return np.stack(out, axis=1), np.stack(has, axis=1)


@dataclass
class Chain:
    """Labels and weights: emissions by slot, transitions, first label. Emissions are means over a word's features, times `sharpness`."""

    labels: list[str]
    emit: np.ndarray
    move: np.ndarray
    first: np.ndarray
    sharpness: float = 8.0
    lexicon: Lexicon = field(default_factory=lambda: NO_LEXICON)

    def emissions(self, chars: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Log scores of words, in blocks to bound memory."""
        out = np.empty((len(chars), len(self.labels)), dtype=np.float32)
        for a in range(0, len(chars), 1 << 15):
            slots, has = features(chars[a : a + (1 << 15)], length[a : a + (1 << 15)], self.lexicon)
            total = np.zeros((len(slots), len(self.labels)), dtype=np.float32)
            for k in range(slots.shape[1]):
                total += np.where(has[:, k, None], self.emit[slots[:, k]], 0)
            out[a : a + (1 << 15)] = self.sharpness * total / np.maximum(has.sum(axis=1), 1)[:, None]
        return out

    def marginals(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label probabilities of every word, given log scores and the places where texts' words begin (and end)."""
        n, m = scores.shape
        if n == 0:
            return np.zeros((0, m))
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).astype(np.float64)
        a = np.exp(self.move - self.move.max())
        start = np.exp(self.first - self.first.max())
        counts = np.diff(first)
        parts = -(-counts // SEGMENT)
        text = np.repeat(np.arange(len(counts)), parts)
        lead = np.concatenate([[0], np.cumsum(parts)])
        number = np.arange(len(text)) - lead[text]
        begin = first[text] + number * SEGMENT
        size = np.minimum(SEGMENT, first[text + 1] - begin)
        steps = int(size.max())
        padded = np.ones((steps, len(text), m))
        for t in range(steps):
            on = size > t
            padded[t, on] = e[begin[on] + t]
        # the transfer matrix of each segment, without the move into the next
        through = np.zeros((len(text), m, m))
        through[:, np.arange(m), np.arange(m)] = padded[0]
        for t in range(1, steps):
            on = np.flatnonzero(size > t)
            step = (through[on] @ a) * padded[t, on][:, None, :]
            through[on] = step / step.max(axis=(1, 2), keepdims=True)
        # along each text: what comes into a segment from the left, and into its last word from the right
        into, behind = np.tile(start, (len(text), 1)), np.ones((len(text), m))
        most = int(parts.max())
        for j in range(1, most):
            at = np.flatnonzero(number == j)
            v = np.einsum("si,sij->sj", into[at - 1], through[at - 1]) @ a
            into[at] = v / v.max(axis=1, keepdims=True)
        for j in range(most - 2, -1, -1):
            at = np.flatnonzero((number == j) & (parts[text] > j + 1))
            v = np.einsum("sij,sj->si", through[at + 1], behind[at + 1]) @ a.T
            behind[at] = v / v.max(axis=1, keepdims=True)
        # inside the segments
        forward = np.empty((steps, len(text), m))
        v = into * padded[0]
        forward[0] = v / v.sum(axis=1, keepdims=True)
        for t in range(1, steps):
            v = (forward[t - 1] @ a) * padded[t]
            forward[t] = v / v.sum(axis=1, keepdims=True)
        out = np.empty((n, m))
        back = behind.copy()
        for t in range(steps - 1, -1, -1):
            on = np.flatnonzero(size > t)
            g = forward[t, on] * back[on]
            out[begin[on] + t] = g / g.sum(axis=1, keepdims=True)
            v = (padded[t, on] * back[on]) @ a.T
            back[on] = v / v.max(axis=1, keepdims=True)
        return out


def learn_lexicon(words: np.ndarray, text: np.ndarray, tag: np.ndarray, labels: int) -> Lexicon:
    """The words that LEXICON_TEXTS texts of a language have, and few texts of others."""
    order = np.lexsort((text, words))
    w, t, y = words[order], text[order], tag[order]
    once = np.concatenate([[True], (w[1:] != w[:-1]) | (t[1:] != t[:-1])]) if len(w) else np.zeros(0, dtype=bool)
    kinds, at = np.unique(w[once], return_inverse=True)
    counts = np.zeros((len(kinds), labels))
    np.add.at(counts, (at, y[once]), 1)
    best = counts.argmax(axis=1)
    most = counts.max(axis=1) if len(kinds) else np.zeros(0)
    keep = (most >= LEXICON_TEXTS) & (most >= LEXICON_SHARE * counts.sum(axis=1))
    return Lexicon(kinds[keep], best[keep])


def train(texts: list[tuple[bytes, str]], epochs: int = 6, length: int = 24, seed: int = 11) -> Chain:
    """Conditional maximum likelihood by mini-batches over stretches of words; half of the stretches switch language in the middle."""
    labels = sorted({lang for _, lang in texts}) or [UNDETERMINED]
    m = len(labels)
    chain = Chain(labels, np.zeros((SLOTS, m), dtype=np.float32), np.zeros((m, m)), np.zeros(m))
    if m < 2:
        return chain
    rng = np.random.default_rng(seed)
    chars, size, owner = [], [], []
    column = pa.array([t for t, _ in texts], pa.binary())
    for low, _, block in blocks(column, fold_ascii=True, marks=MARKS, width=WIDTH):
        at = letter_words(block)
        c, n = block.characters(at, WIDTH)
        chars.append(c), size.append(n), owner.append(block.doc[at] + low)
    chars, size, owner = (np.concatenate(x) for x in (chars, size, owner))
    tag = np.array([labels.index(lang) for _, lang in texts])[owner]
    chain.lexicon = learn_lexicon(word_names(chars, size), owner, tag, m)
    each = features(chars[:1], size[:1], chain.lexicon)
    slots, has = (np.empty((len(chars), x.shape[1]), dtype=x.dtype) for x in each)
    for k in range(0, len(chars), 1 << 15):
        slots[k : k + (1 << 15)], has[k : k + (1 << 15)] = features(chars[k : k + (1 << 15)], size[k : k + (1 << 15)], chain.lexicon)
    del chars
    # stretches of one text; runs of `length` words
    runs = [np.arange(i, i + length) for i in range(0, len(owner) - length, length) if owner[i] == owner[i + length - 1]]
    if not runs:
        runs = [np.arange(min(length, len(owner)))]
    runs = np.stack(runs)
    share = (chain.sharpness / np.maximum(has.sum(axis=1, keepdims=True), 1)).astype(np.float32)
    sums = {k: np.full(v.shape, 1e-2) for k, v in (("emit", chain.emit), ("move", chain.move), ("first", chain.first))}

    def update(name: str, gradient: np.ndarray, rate: float) -> None:
        sums[name] += gradient**2
        getattr(chain, name).__iadd__((rate * gradient / np.sqrt(sums[name])).astype(getattr(chain, name).dtype))

    for _ in range(epochs):
        order = rng.permutation(len(runs))
        for b in range(0, len(order), 128):
            words = runs[order[b : b + 128]].copy()
            mixed = rng.random(len(words)) < 0.5
            cut = length // 2
            words[mixed, cut:] = runs[rng.integers(0, len(runs), int(mixed.sum()))][:, cut:]
            flat = words.ravel()
            weight = has[flat] * share[flat]
            scores = np.einsum("nk,nkm->nm", weight, chain.emit[slots[flat]])
            first = np.arange(0, len(flat) + 1, words.shape[1])
            p, pairs = _expected(chain, scores.reshape(len(words), -1, m))
            gold = np.eye(m)[tag[words]]
            delta = (gold - p) / len(words)
            rows, cols = slots[flat].ravel(), (delta.reshape(-1, 1, m) * weight[:, :, None]).reshape(-1, m)
            unique, back = np.unique(rows, return_inverse=True)
            g = np.stack([np.bincount(back, weights=cols[:, j], minlength=len(unique)) for j in range(m)], axis=1)
            sums["emit"][unique] += g**2
            chain.emit[unique] += (0.5 * g / np.sqrt(sums["emit"][unique])).astype(np.float32)
            seen = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
            update("move", (seen - pairs) / len(words), 0.1)
            update("first", delta[:, 0].sum(axis=0), 0.1)
            del first
    return chain


def _expected(chain: Chain, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word marginals and summed pair marginals of equally long stretches (stretch, word, label)."""
    b, t, m = scores.shape
    e = np.exp(scores - scores.max(axis=2, keepdims=True))
    a = np.exp(chain.move - chain.move.max())
    f, g = np.empty_like(e), np.empty_like(e)
    v = np.exp(chain.first - chain.first.max()) * e[:, 0]
    f[:, 0] = v / v.sum(axis=1, keepdims=True)
    for k in range(1, t):
        v = (f[:, k - 1] @ a) * e[:, k]
        f[:, k] = v / v.sum(axis=1, keepdims=True)
    g[:, -1] = 1.0
    pairs = np.zeros((m, m))
    for k in range(t - 2, -1, -1):
        right = e[:, k + 1] * g[:, k + 1]
        joint = f[:, k, :, None] * a[None] * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        v = right @ a.T
        g[:, k] = v / v.max(axis=1, keepdims=True)
    p = f * g
    return p / p.sum(axis=2, keepdims=True), pairs


def letter_words(block: Block) -> np.ndarray:
    """Places of the words with a letter (ASCII, or any non-ASCII byte)."""
    if not len(block.start):
        return np.zeros(0, dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(_LETTER[block.buf])])
    return np.flatnonzero(sums[block.end] > sums[block.start])


def sample_texts(docs: DataFrame, usable: Column, doc_id: str, text: str, lang: str) -> list[tuple[bytes, str]]:
    """Stretches of about SAMPLE_ROWS labelled rows of each of the LANGS most frequent languages: those whose hash of the id is below the language's share.

    Rows are counted by language first; then each row tells by itself whether it is in the sample, and only its
    stretches leave it.
    """
    h = F.xxhash64(F.col(doc_id), F.length(text))
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGS)
    share = F.broadcast(counts.select("lang", (SAMPLE_ROWS / F.col("n")).alias("share")))  # LANGS rows
    room = F.greatest(F.length("text") - STRETCH_CHARS, F.lit(0))
    at = lambda k: F.pmod(F.xxhash64("h", F.lit(k)), room + 1).cast("int") + 1
    pieces = F.array(*[F.substring(F.col("text"), at(k), F.lit(STRETCH_CHARS)) for k in range(STRETCHES)])
    best = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text"), h.alias("h")).join(share, "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("share") * (1 << 30))
    got = best.select("lang", "h", F.explode(pieces).alias("piece")).collect()
    return [(piece.encode(), lang) for lang, _, piece in sorted(map(tuple, got))]


def identify(docs: DataFrame, chain: Chain, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score and shares (label -> mean marginal) of every whole text; with `carry`, all columns of docs in place of the id alone.

    A null text, and one without letters, is `und` with score 0 and no shares. Rows are mapped where they lie:
    null or repeated ids and equal rows stay. Only the id and the text are read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows, schema, kept, words_in = carried(docs, doc_id, text, ("lang_pred", "score", "shares"), carry)
    names = [*kept, "lang_pred", "score", "shares"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        table = TypeTable(len(own.labels))
        m = len(own.labels)
        for batch in batches:
            for low, high, block in blocks(batch.column(words_in), fold_ascii=True, marks=MARKS, width=WIDTH):
                at = letter_words(block)
                scores = table.of(block.hash[at], lambda k, at=at, block=block: own.emissions(*block.characters(at[k], WIDTH))) if len(at) else np.zeros((0, m))
                counts = np.bincount(block.doc[at], minlength=block.n)
                first = np.concatenate([[0], np.cumsum(counts)])
                p = own.marginals(scores, first)
                total = np.stack([np.bincount(block.doc[at], weights=p[:, j], minlength=block.n) for j in range(m)], axis=1)
                share = total / np.maximum(counts, 1)[:, None]
                ascii_letter = np.zeros(block.n, dtype=bool)
                known = np.flatnonzero(counts > 0)
                for d in known:  # texts whose only letters may be none
                    lead = at[first[d]]
                    ascii_letter[d] = (_LETTER[:128][np.minimum(block.buf[block.start[lead] : block.end[lead]], 127)] & (block.buf[block.start[lead] : block.end[lead]] < 128)).any() or any(
                        c.isalpha() for c in block.buf[block.offsets[d] : block.offsets[d + 1]].tobytes().decode(errors="ignore")
                    )
                pick = share.argmax(axis=1)
                named = [own.labels[k] if ok else UNDETERMINED for k, ok in zip(pick.tolist(), ascii_letter.tolist(), strict=True)]
                best = np.where(ascii_letter, share.max(axis=1), 0.0)
                shares = pa.array([list(zip(own.labels, s, strict=True)) if ok else [] for s, ok in zip(share.tolist(), ascii_letter.tolist(), strict=True)], pa.map_(pa.string(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*rows_of(batch, kept, low, high), pa.array(named, pa.string()), pa.array(np.clip(best, 0.0, 1.0)), shares], names)

    return rows.mapInArrow(tidy(run), f"{schema}, lang_pred string, score double, shares map<string,double>")


def label_words(text: str, chain: Chain) -> list[tuple[str, str, float]]:
    """(word, label, probability) of the words with letters of one text: the spans of code-switched text."""
    out = []
    for _, _, block in blocks(pa.array([text.encode()], pa.binary()), fold_ascii=True, marks=MARKS, width=WIDTH):
        at = letter_words(block)
        p = chain.marginals(chain.emissions(*block.characters(at, WIDTH)), np.array([0, len(at)]))
        for k, row in zip(at.tolist(), p, strict=True):
            out.append((block.buf[block.start[k] : block.end[k]].tobytes().decode(errors="replace"), chain.labels[int(row.argmax())], float(row.max())))
    return out


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Is crc32 of the id as text, modulo `parts`, equal to `part`? A null id has the text `null`."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null")).cast("binary")) % parts == part


def learn(docs: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Chain:
    """A chain learned from the text and lang of the usable rows. Without labelled rows every text with letters is `und`."""
    chain = train(sample_texts(docs, usable, doc_id, text, lang))
    give_back()
    return chain
