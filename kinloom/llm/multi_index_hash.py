"""Nearest neighbours by inner product with multi-index hashing over learned rotated binary codes.

A rotation learned on a bounded sample (principal axes, then alternating sign and Procrustes steps) turns the
directions of vectors into codes of 64 bits; Hamming distance follows the angle. A code is cut into substrings, and
each substring has an index of its own. If two codes differ in at most m * (a + 1) - 1 of their bits, one of their m
substrings differs in at most a: probing every index within a retrieves every code within that radius. Only codes
within the radius are reranked, by the inner product of the original vectors in double precision. A query's radius
grows until codes beyond it are unlikely (by a stated number of standard deviations) to be nearer than its k-th
found; as the inner product also grows with a row's norm, rows have their radius by bands of norms.

Every row is indexed. Index and queries are dealt into blocks and each pair of blocks is a task, so that no task
holds more than a block of each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, draw, ship, shuffle_partitions
from .components import salted_join

#: Bits of a code and of a substring.
BITS, PART = 64, 16
#: Rows on which the rotation is fitted, at most.
SAMPLE = 8192
#: Standard deviations of the Hamming distance that the radius reaches beyond the k-th found.
REACH = 1.5
#: Rows of a block of the index, and of the queries.
INDEX_BLOCK, QUERY_BLOCK = 16_384, 4_096


@dataclass(frozen=True)
class Coder:
    """Vectors to codes: signs of their rotated directions."""

    axes: np.ndarray

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.axes > 0, axis=1, bitorder="little").view(np.uint16).reshape(len(x), BITS // PART)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def fit(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> Coder:
    """A coder learned from a sample; fewer dimensions than bits are filled up by random directions."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    unit = sample / norms(sample)[:, None] if len(sample) else np.eye(d)[:1]
    _, _, vt = np.linalg.svd(unit, full_matrices=False)
    axes = vt[: min(BITS, len(vt))].T
    if axes.shape[1] < BITS:
        axes = np.column_stack([axes, rng.normal(size=(d, BITS - axes.shape[1])) / math.sqrt(d)])
    projected = unit @ axes
    rotation = np.linalg.qr(rng.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        signs = np.where(projected @ rotation > 0, 1.0, -1.0)
        u, _, wt = np.linalg.svd(projected.T @ signs)
        rotation = u @ wt
    return Coder(axes @ rotation)


class SubstringIndexes:
    """For each substring of the codes, the values that occur and the rows of each, one value's after another's."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.whole = np.ascontiguousarray(codes).view(np.uint64).ravel()
        self.values, self.of_row, self.rows, self.first = [], [], [], []
        for s in range(codes.shape[1]):
            values, back = np.unique(codes[:, s], return_inverse=True)
            self.values.append(values)
            self.of_row.append(back)
            self.rows.append(np.argsort(back, kind="stable"))
            self.first.append(np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(values)))]))

    def probe(self, queries: np.ndarray, a: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, bits) of all codes within m * (a + 1) - 1 bits: the rows of every value within a bits in any index, then the whole distance."""
        m = queries.shape[1]
        found = np.zeros((len(queries), len(self.codes)), dtype=bool)
        for s in range(m):
            near = np.bitwise_count(queries[:, s][:, None] ^ self.values[s][None, :]) <= a
            if near.mean() > 0.02:  # of many values, all rows' are looked up
                found |= near[:, self.of_row[s]]
            else:
                q, v = np.nonzero(near)
                size = self.first[s][v + 1] - self.first[s][v]
                ends = np.cumsum(size)
                at = np.repeat(self.first[s][v] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
                found[np.repeat(q, size), self.rows[s][at]] = True
        q, r = np.nonzero(found)
        bits = np.bitwise_count(np.ascontiguousarray(queries).view(np.uint64).ravel()[q] ^ self.whole[r])
        ok = bits <= m * (a + 1) - 1
        return q[ok], r[ok], bits[ok]

    def distances(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(queries, rows) bits of the closest substring, at which probing finds a row, and of the whole code. The bits of each value that occurs in an index are counted once for all its rows."""
        least = np.full((len(queries), len(self.codes)), PART, dtype=np.uint8)
        whole = np.zeros_like(least)
        for s in range(queries.shape[1]):
            bits = np.bitwise_count(queries[:, s][:, None] ^ self.values[s][None, :])[:, self.of_row[s]]
            np.minimum(least, bits, out=least)
            whole += bits
        return least, whole


def needed_radius(similarity: np.ndarray, reach: float) -> np.ndarray:
    """Bits up to which codes have to be looked at, if the k-th found has this cosine."""
    p = np.arccos(np.clip(similarity, -1.0, 1.0)) / math.pi
    return BITS * p + reach * np.sqrt(BITS * p * (1 - p))


#: Queries that probe at once.
QUERIES_AT_ONCE = 128


def search_block(coder: Coder, reach: float, k: int, qid: np.ndarray, q: np.ndarray, xid: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, row, score) of each query's k best found in a block, ties to the smaller id, and how many inner products that took.

    Probing goes on bit by bit: in each round every index is probed one bit further, and codes that come within the
    radius are reranked. A query is done when its k-th found asks for no wider radius. All rows that tie with the
    k-th are kept until ids decide.
    """
    index = SubstringIndexes(coder.codes(x))
    codes = coder.codes(q)
    size = norms(x)
    # rows by bands of an eighth of an octave of their norms; each band has the radius of its largest norm
    step, band = np.unique(np.ceil(8 * np.log2(size / size.max()) - 1e-9), return_inverse=True)
    largest = size.max() * 2.0 ** (step / 8)
    m = codes.shape[1]
    out, scored = [], 0
    for begin in range(0, len(q), QUERIES_AT_ONCE):
        least, bits = index.distances(codes[begin : begin + QUERIES_AT_ONCE])
        for at in range(len(bits)):
            v = q[begin + at]
            length = np.sqrt(v @ v)
            slack = 1e-12 * length * largest.max()
            found, score = np.zeros(0, dtype=np.int64), np.zeros(0)
            radius, before = np.full(len(step), float(BITS)), -1
            for a in range(PART + 1):
                if radius.max() <= before:
                    break
                upto = m * (a + 1) - 1
                near = np.flatnonzero((bits[at] > before) & (bits[at] <= upto) & (least[at] <= a))
                near = near[bits[at, near] <= radius[band[near]]]
                before = upto
                if not len(near):
                    continue
                scored += len(near)
                found, score = np.concatenate([found, near]), np.concatenate([score, x[near] @ v])
                if len(score) >= k:
                    kth = np.partition(score, len(score) - k)[len(score) - k]
                    keep = score >= kth - slack
                    found, score = found[keep], score[keep]
                    ratio = kth / (length * largest)
                    radius = np.where(ratio > 1 + 1e-9, -1.0, needed_radius(ratio, reach))
            exact = (v * x[found]).sum(axis=1)  # the same sum for a pair, whatever else was asked
            best = np.lexsort((xid[found], -exact))[:k]
            out.append((np.full(len(best), qid[begin + at]), xid[found[best]], exact[best]))
    return *(np.concatenate(c) for c in zip(*out, strict=True)), scored


def _sound(embedding: Column, size: int | None = None) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    ok = embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, finite) & F.exists(embedding, lambda v: v != 0)
    return ok & (F.size(embedding) == size) if size else ok


def search(vectors: DataFrame, queries: Column, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", reach: float = REACH, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that meets `queries`, among all rows but those of its own id.

    Rows whose id is null, and whose vector is null, zero, or holds null or non-finite components, take no part,
    nor do those of another length than most. Rows with one vector are searched once: of a vector only the k + 1
    smallest ids can be among anyone's nearest. With fewer candidates all are returned; an empty table gives no
    rows. The rotation is fitted on the `sample` rows with the smallest hashes.
    """
    spark = vectors.sparkSession
    ship(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"), queries.alias("is_query"))
    sizes = rows.where(F.col("vec_id").isNotNull() & _sound(F.col("v"))).groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").head(1)
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0]["d"]
    rows = rows.where(F.col("vec_id").isNotNull() & _sound(F.col("v"), d)).select("vec_id", F.transform("v", lambda x: x + 0.0).alias("v"), "is_query")
    copies = Window.partitionBy("v").orderBy("vec_id")
    index = cut(rows.select("vec_id", "v").withColumn("_k", F.row_number().over(copies)).where(F.col("_k") <= k + 1).drop("_k"))
    asked = cut(rows.where("is_query").select("vec_id", "v").distinct())
    leads = cut(asked.groupBy("v").agg(F.min("vec_id").alias("lead")))
    some = draw(index, "vec_id", sample).select("v").toPandas()["v"]
    coder = fit(np.stack(some.to_numpy()) if len(some) else np.zeros((0, d)))

    p = shuffle_partitions(spark)
    index_blocks = max(math.ceil(index.count() / INDEX_BLOCK), math.ceil(math.sqrt(p)))
    query_blocks = max(math.ceil(leads.count() / QUERY_BLOCK), math.ceil(p / index_blocks))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = leads.select(every(index_blocks).alias("ib"), block("lead", query_blocks).alias("qb"), F.col("lead").alias("id"), "v")
    right = index.select(block("vec_id", index_blocks).alias("ib"), every(query_blocks).alias("qb"), F.col("vec_id").alias("id"), "v")

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        flat = column.combine_chunks()
        return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), d)

    def run(asked_rows: pa.Table, index_rows: pa.Table) -> pa.Table:
        names = ["lead", "vec_id", "score"]
        if not len(asked_rows) or not len(index_rows):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        found = search_block(coder, reach, k + 1, asked_rows["id"].to_numpy(), matrix(asked_rows["v"]), index_rows["id"].to_numpy(), matrix(index_rows["v"]))
        return pa.table([pa.array(c) for c in found[:3]], names)

    cells = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInArrow(run, "lead long, vec_id long, score double")
    best = Window.partitionBy("lead").orderBy(F.desc("score"), "vec_id")
    of_lead = cells.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= k + 1)
    lists = of_lead.groupBy("lead").agg(F.array_sort(F.collect_list(F.struct(F.col("_k"), "vec_id", "score"))).alias("near"))
    named = salted_join(asked, leads, "v", "vec_id").select(F.col("vec_id").alias("query_id"), "lead")
    own = salted_join(named, lists, "lead", "query_id").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("p", "x")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
