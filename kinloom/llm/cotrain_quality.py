"""Quality classification by co-training two views: what a text says, and what is known about the page.

The text view has the words themselves, hashed, and rates measured on them (capitals, symbols, repetition, lengths);
the metadata view has source, language, length class and the layout of the page in lines. Each is a logistic model.
From a bounded labelled sample and an equally bounded pool of unlabelled rows, the views teach each other over
rounds: each one's most confident rows of the pool get its label in the other's training set, weighted by how much
more often than by chance it is right when it is as confident on labelled rows kept aside. On these rows both are
calibrated too, and the combination weighs their log-odds, never against a view. Scoring is one pass over the whole
texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import carried, draw, give_back, rows_of, ship, tidy
from .string_kernel_toxicity import platt
from .textcore import Block, blocks

#: Labelled rows, and rows of the unlabelled pool, to learn from, at most.
SAMPLE_ROWS, POOL_ROWS = 4000, 4000
#: Rounds of exchange, and the share of the pool that each view labels in a round.
ROUNDS, SHARE = 5, 0.05
#: Weight of a row that a view without fault has taught, against 1 of a labelled row.
TAUGHT = 0.3
#: Log-odds from which a view is sure.
SURE = 2.0
#: Hash slots of the metadata's values, and of the words.
META_SLOTS, WORD_SLOTS = 64, 256
SYMBOLS = b"#*$%&|<>"


def _class_of(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_UPPER, _LOWER, _DIGIT = _class_of(bytes(range(65, 91))), _class_of(bytes(range(97, 123))), _class_of(b"0123456789")
_SYMBOL, _STOP, _CRY, _HIGH = _class_of(SYMBOLS), _class_of(b".,;:"), _class_of(b"!?"), _class_of(bytes(range(128, 256)))


def text_features(block: Block) -> np.ndarray:
    """(texts, 12) rates of a block of whole texts; all 0 without words."""
    n = block.n
    sums = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[block.buf])])[block.offsets]).astype(float)
    counts = block.counts.astype(float)
    w, size = np.maximum(counts, 1), np.maximum(np.diff(block.offsets), 1).astype(float)
    letters = np.maximum(sums(_UPPER) + sums(_LOWER) + sums(_HIGH), 1)
    follow = np.zeros(n)
    distinct = np.zeros(n)
    if len(block.start):
        same = (block.hash[1:] == block.hash[:-1]) & (block.doc[1:] == block.doc[:-1])
        follow = np.bincount(block.doc[1:][same], minlength=n)
        order = np.lexsort((block.hash, block.doc))
        h, d = block.hash[order], block.doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        distinct = np.bincount(d[new], minlength=n)
    length = np.bincount(block.doc, weights=(block.end - block.start), minlength=n)
    heaps = np.where(counts > 0, distinct / w, 0) * np.log1p(counts) / 8
    out = [sums(_UPPER) / letters, sums(_DIGIT) / size, sums(_SYMBOL) / w, sums(_CRY) / w, sums(_STOP) / w, follow / w, distinct / w, heaps, np.minimum(length / w, 30) / 10, np.log1p(counts) / 10, letters / size, np.minimum(sums(_class_of(b"\n")) / w, 1)]
    f = np.stack(out, axis=1)
    f[counts == 0] = 0
    return f


def expand(x: np.ndarray) -> np.ndarray:
    """Features with square roots and squares, so that a linear model can bend."""
    return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)


def word_features(block: Block) -> np.ndarray:
    """(texts, WORD_SLOTS) square roots of the words' shares by hash slot."""
    out = np.zeros((block.n, WORD_SLOTS))
    np.add.at(out, (block.doc, (block.hash & np.uint64(WORD_SLOTS - 1)).astype(np.int64)), 1)
    return np.sqrt(out / np.maximum(block.counts, 1)[:, None])


def layout_features(block: Block) -> np.ndarray:
    """(texts, 5) how a page is laid out: its lines, their mean and largest length, the shares of short and of blank ones."""
    breaks = np.flatnonzero(block.buf == 10)
    length = np.sort(np.concatenate([breaks, block.offsets[1:]])) - np.sort(np.concatenate([breaks + 1, block.offsets[:-1]]))
    lines = np.bincount(np.searchsorted(block.offsets, breaks, side="right") - 1, minlength=block.n) + 1
    first = np.cumsum(lines) - lines
    mean = lambda x: np.add.reduceat(x.astype(float), first) / lines
    out = [np.log1p(lines) / 8, np.log1p(mean(length)) / 8, np.log1p(np.maximum.reduceat(length, first)) / 10, mean(length < 40), mean(length == 0)] if block.n else [np.zeros(0)] * 5
    return np.stack(out, axis=1)


def text_view(block: Block) -> np.ndarray:
    return np.concatenate([expand(text_features(block)), word_features(block)], axis=1)


def meta_view(rows: list[tuple[str | None, str | None, int | None]], layout: np.ndarray) -> np.ndarray:
    return np.concatenate([meta_features(rows), expand(layout)], axis=1)


def meta_features(rows: list[tuple[str | None, str | None, int | None]]) -> np.ndarray:
    """(rows, META_SLOTS) indicators of source, language and length class; null is a value of its own."""
    out = np.zeros((len(rows), META_SLOTS))
    for k, (source, lang, n) in enumerate(rows):
        for name in (f"s{source}", f"l{lang}", f"n{-1 if n is None else int(np.log2(max(n, 0) + 1))}"):
            out[k, crc32(name.encode()) % META_SLOTS] = 1
    return out


@dataclass
class Logistic:
    """A shrunk logistic model over standardised features."""

    ridge: float = 1.0
    mean: np.ndarray = field(default=None)
    scale: np.ndarray = field(default=None)
    weights: np.ndarray = field(default=None)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(x)) if weight is None else weight
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        a = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        w, shrink = np.zeros(a.shape[1]), np.full(a.shape[1], self.ridge)
        shrink[-1] = 1e-3
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            step = np.linalg.solve((a * (weight * p * (1 - p) + 1e-9)[:, None]).T @ a + np.diag(shrink), a.T @ (weight * (p - y)) + shrink * w)
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        self.weights = w
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)


@dataclass
class Views:
    """Both models, the calibration of each, and the weights of their log-odds."""

    text: Logistic | None = None
    meta: Logistic | None = None
    of_text: tuple[float, float] = (1.0, 0.0)
    of_meta: tuple[float, float] = (1.0, 0.0)
    blend: tuple[float, float, float] = (1.0, 0.0, 0.0)
    #: What was taught: (round, teacher, rows labelled 0, rows labelled 1, weight of a 0, weight of a 1).
    taught: list[tuple[int, str, int, int, float, float]] = field(default_factory=list)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) probabilities of good quality; 0.5 if nothing was learned."""
        if self.text is None:
            half = np.full(len(text), 0.5)
            return half, half, half
        curve = lambda v: 1 / (1 + np.exp(-np.clip(v, -30, 30)))
        a = self.of_text[0] * self.text.margin(text) + self.of_text[1]
        b = self.of_meta[0] * self.meta.margin(meta) + self.of_meta[1]
        return curve(self.blend[0] * a + self.blend[1] * b + self.blend[2]), curve(a), curve(b)


def trust(p: np.ndarray, label: np.ndarray, share: float, value: int) -> float:
    """How much more often than by chance a view is right on the `share` of rows that it holds most surely to be `value`: 0 by chance, 1 always. Of what few rows show, a standard error is taken off."""
    order = np.argsort(p if value == 0 else -p, kind="stable")[: max(1, int(np.ceil(share * len(p))))]
    chance = float(np.mean(label == value))
    right = (float(np.sum(label[order] == value)) + 1) / (len(order) + 2)
    return max(0.0, (right - float(np.sqrt(right * (1 - right) / len(order))) - chance) / max(1 - chance, 1e-9))


def blended(a: np.ndarray, b: np.ndarray, target: np.ndarray) -> tuple[float, float, float]:
    """Weights of two log-odds and their offset; a view that would weigh against its own log-odds is left out."""
    on = [0, 1]
    while on:
        model = Logistic(ridge=1.0).fit(np.column_stack([a, b])[:, on], target)
        w = model.weights[:-1] / model.scale
        if (w >= 0).all():
            full = dict(zip(on, w.tolist(), strict=True))
            return full.get(0, 0.0), full.get(1, 0.0), float(model.weights[-1] - w @ model.mean)
        on.pop(int(w.argmin()))
    return 1.0, 0.0, 0.0


def cotrain(text: np.ndarray, meta: np.ndarray, label: np.ndarray, pool_text: np.ndarray, pool_meta: np.ndarray, rounds: int = ROUNDS) -> Views:
    """Views learned from labelled rows and a pool; every fourth labelled row is kept aside for trust and calibration."""
    if len(label) < 8 or label.min() == label.max():
        return Views()
    aside = np.arange(len(label)) % 4 == 0
    if label[aside].min() == label[aside].max() or label[~aside].min() == label[~aside].max():
        aside = np.zeros(len(label), dtype=bool)
    held = aside if aside.any() else np.ones(len(label), dtype=bool)
    every = {"text": text, "meta": meta}
    pool, y = {"text": pool_text, "meta": pool_meta}, label[~aside].astype(float)
    given = {v: np.full(len(pool_text), np.nan) for v in every}
    weight = {v: np.zeros(len(pool_text)) for v in every}
    rate = y.mean()
    views = Views()

    def model(view: str) -> Logistic:
        has = ~np.isnan(given[view])
        return Logistic().fit(np.concatenate([every[view][~aside], pool[view][has]]), np.concatenate([y, given[view][has]]), np.concatenate([np.ones(len(y)), weight[view][has]]))

    for turn in range(rounds if len(pool_text) else 0):
        models = {v: model(v) for v in given}
        for teacher, pupil in (("text", "meta"), ("meta", "text")):
            p = models[teacher].margin(pool[teacher])
            sure = models[teacher].margin(every[teacher][held])
            free = np.flatnonzero(np.isnan(given[pupil]))
            order = free[np.argsort(p[free], kind="stable")]
            many = SHARE * len(p)
            low, high = order[: int(many * (1 - rate))], order[len(order) - int(many * rate) :]
            # rows of whose contrary the pupil is sure itself are not taught
            own = models[pupil].margin(pool[pupil])
            low, high = low[own[low] < SURE], high[own[high] > -SURE]
            worth = [trust(sure, label[held], SHARE * (turn + 1) * share, v) for v, share in ((0, 1 - rate), (1, rate))]
            for rows, value in ((low, 0), (high, 1)):
                if worth[value] > 0:
                    given[pupil][rows], weight[pupil][rows] = float(value), TAUGHT * worth[value]
            views.taught.append((turn, teacher, len(low) if worth[0] > 0 else 0, len(high) if worth[1] > 0 else 0, *worth))
    views.text, views.meta = model("text"), model("meta")
    target = label[held].astype(float)
    views.of_text, views.of_meta = platt(views.text.margin(text[held]), target), platt(views.meta.margin(meta[held]), target)
    views.blend = blended(views.of_text[0] * views.text.margin(text[held]) + views.of_text[1], views.of_meta[0] * views.meta.margin(meta[held]) + views.of_meta[1], target)
    return views


_META = "source string, lang string, n_chars long"


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    have = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(name)
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"), have("source", "string"), have("lang", "string"), have("n_chars", "long"))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Views:
    """Views learned from SAMPLE_ROWS usable labelled rows and POOL_ROWS others at most, those with the smallest hashes of their id.

    Null ids, labels and texts take no part in learning.
    """
    ship(docs.sparkSession)
    marked = labels.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1)).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).where(usable)
    few = draw(marked, "doc_id", SAMPLE_ROWS)
    names = draw(docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id")), "doc_id", POOL_ROWS, seed=1)
    asked = few.unionByName(names.withColumn("y", F.lit(None).cast("int"))).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = _rows(docs, doc_id, text).where("text IS NOT NULL").join(F.broadcast(asked), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in blocks(batch.column("text")):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ("doc_id", "source", "lang", "n_chars", "y")] + [pa.array(list(f), pa.list_(pa.float32())) for f in (text_view(block).astype(np.float32), layout_features(block).astype(np.float32))], ["doc_id", "source", "lang", "n_chars", "y", "f", "layout"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.mapInArrow(tidy(run), f"doc_id {kind}, {_META}, y int, f array<float>, layout array<float>").toArrow()  # features of the sample's rows
    if not len(got):
        return Views()
    got = got.sort_by([("doc_id", "ascending"), ("n_chars", "ascending")])
    wide = lambda c: got[c].combine_chunks().flatten().to_numpy().reshape(len(got), -1).astype(float)
    x = wide("f")
    m = meta_view(list(zip(*[got[c].to_pylist() for c in ("source", "lang", "n_chars")], strict=True)), wide("layout"))
    y = got["y"].fill_null(-1).to_numpy()
    views = cotrain(x[y >= 0], m[y >= 0], y[y >= 0], x[y < 0], m[y < 0])
    del got, x, m
    give_back()
    return views


def score(docs: DataFrame, views: Views, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, score, text_score, meta_score and kept of every row; with `carry`, all columns of docs in place of the id alone.

    A null text or one without words scores 0 and is not kept. Rows are mapped where they lie; null or repeated
    ids and equal rows stay. Columns other than id, text, source, lang and n_chars are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(views)
    made = ("score", "text_score", "meta_score", "kept")
    have = lambda name, kind: (F.col(name) if name in docs.columns else F.lit(None)).cast(kind).alias(f"_{name}")
    clash = ("_source", "_lang", "_n_chars")
    rows, schema, kept, words_in = carried(docs.drop(*clash).select("*", have("source", "string"), have("lang", "string"), have("n_chars", "long")), doc_id, text, made, carry)
    kept = [c for c in kept if c not in clash]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in kept)
    if not carry:
        rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias(words_in), have("source", "string"), have("lang", "string"), have("n_chars", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for low, high, block in blocks(batch.column(words_in)):
                meta = meta_view(list(zip(*[batch.column(c).slice(low, high - low).to_pylist() for c in clash], strict=True)), layout_features(block))
                both, a, b = own.scores(text_view(block), meta)
                both = np.where(block.counts > 0, both, 0.0)
                yield pa.RecordBatch.from_arrays([*rows_of(batch, kept, low, high), *[pa.array(v) for v in (both, a, b, both >= threshold)]], [*kept, *made])

    return rows.mapInArrow(tidy(run), f"{schema}, score double, text_score double, meta_score double, kept boolean")
