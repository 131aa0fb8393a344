"""Best-fit packing planned on the histogram of lengths.

Texts are tokenized and cut into pieces in one pass; the pieces (ids, places and a checksum, no texts) are
written to the shared folder. Only the count of each length, `capacity` numbers at most, goes to the driver.
There best-fit decreasing runs over counts: bins in the same state are one entry with a multiplicity, so the
plan's size depends on the capacity and not on the number of documents. The plan says, for each length, which
ranks take which slots; every piece gets its rank within its length and joins its slot.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, model, ship, tidy
from .hash_tree import slots
from .textcore import Block, RaggedTable, blocks, gather, mix

#: Word types, and pieces of letters, whose ids a worker keeps.
TYPES_KEPT, PIECES_KEPT = 1_500_000, 200_000
PIECE_SCHEMA = "piece int, start long, length long, ids_crc32 long"


class ChunkTokenizer:
    """Ids by the tokenizers library, remembered for each word with the white space in front.

    In a byte-level pre-tokenization no piece goes on past a white space character between two others, so a
    text's ids are those of its words, each with the one character in front of it, one after another. A text
    with longer gaps, with white space at an end, with a word that begins or ends in other white space, or with
    a special token is encoded whole. Of a word of letters before marks the library encodes the two pieces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        self.marks = tuple(c for c in map(chr, range(33, 127)) if not c.isalnum())
        self.types = RaggedTable((np.uint32,), TYPES_KEPT)
        self.pieces: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def _split(self, word: str) -> tuple[str, str]:
        """Letters (with what stands in front) and the marks behind them, or the word and nothing."""
        base = word.rstrip("".join(self.marks))
        return (base, word[len(base) :]) if base and base[-1] not in " \n" and base.lstrip(" \n").isalpha() and base.isprintable() else (word, "")

    def learn(self, words: list[str]) -> list[list[int] | None]:
        """Ids of words with the character in front; None for those that can't stand alone."""
        parts: list[tuple[str, str] | None] = []
        for w in words:
            bare = w[1:] if w[:1] in " \n\t\r\x0b\x0c" else w
            fits = bare and not bare[0].isspace() and not bare[-1].isspace() and not any(s in w for s in self.special)
            parts.append(self._split(w) if fits else None)
        if len(self.pieces) > PIECES_KEPT:
            self.pieces.clear()
        new = list({x for p in parts if p for x in p if x}.difference(self.pieces))
        for x, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.pieces[x] = e.ids
        self.pieces[""] = []
        get = self.pieces.__getitem__
        return [None if p is None else get(p[0]) + get(p[1]) if p[1] else get(p[0]) for p in parts]

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of a binary column."""
        for _, _, block in blocks(column):
            yield from self._encode(block)

    def _encode(self, block: Block) -> Iterator[np.ndarray]:
        start, end, first = block.start, block.end, block.first
        head = np.zeros(len(start), dtype=bool)
        head[first[:-1][block.counts > 0]] = True
        before = np.where(head, np.uint8(0), block.buf[np.maximum(start - 1, 0)]) if len(start) else np.zeros(0, dtype=np.uint8)
        raw = block.buf.tobytes()

        def make(at: np.ndarray) -> tuple[list]:
            return (self.learn([raw[s - (not h) : e].decode() for s, e, h in zip(start[at].tolist(), end[at].tolist(), head[at].tolist(), strict=True)]),)

        ((place, length),) = self.types.of(block.hash ^ mix(before.astype(np.uint64) + np.uint64(7)), make)
        gap = np.where(head, start - block.offsets[block.doc] + 1, start - np.concatenate([[0], end[:-1]])) if len(start) else start
        odd = np.zeros(block.n, dtype=bool)
        odd[block.doc[(gap != 1) | (length < 0)]] = True
        some = np.flatnonzero(block.counts > 0)
        odd[some] |= end[first[some + 1] - 1] != block.offsets[some + 1]
        odd |= (block.counts == 0) & (np.diff(block.offsets) > 0)
        size = np.maximum(length, 0).astype(np.int64)
        ids = gather(self.types.pool[0], place, size)
        ends = np.concatenate([[0], np.cumsum(size)])[first]
        for k in range(block.n):
            if odd[k]:
                yield np.array(self.whole(raw[block.offsets[k] : block.offsets[k + 1]].decode()), dtype="<u4")
            else:
                yield ids[ends[k] : ends[k + 1]]


def tokenizer(path: str) -> ChunkTokenizer:
    """The worker's own, kept over its tasks."""
    return model(ChunkTokenizer, path)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and `end_id`, cut into pieces of `capacity`, the first being the shorter one.

    A null text counts as empty and has the end id alone.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    end = np.array([end_id], dtype="<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(vocabulary)
        for batch in batches:
            rows, cols = [], ([], [], [], [])
            for k, ids in enumerate(own.encode(batch.column(1))):
                raw = np.concatenate([ids, end]).astype("<u4").tobytes()
                total = len(raw) // 4
                begin, stop, number = 0, total % capacity or min(total, capacity), 0
                while begin < total:
                    rows.append(k)
                    for col, v in zip(cols, (number, begin, stop - begin, zlib.crc32(raw[4 * begin : 4 * stop])), strict=True):
                        col.append(v)
                    begin, stop, number = stop, stop + capacity, number + 1
            out = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run, own_model=True), f"doc_id {kind}, {PIECE_SCHEMA}")


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, sequence of the first rank, offset) of every slot, by best-fit decreasing over counts.

    `states` has for each remaining room a list of (bins, contents); bins in one entry were filled alike.
    """
    states: dict[int, list[tuple[int, tuple]]] = {}
    rooms: list[int] = []

    def put(room: int, bins: int, contents: tuple) -> None:
        if room not in states:
            bisect.insort(rooms, room)
            states[room] = []
        states[room].append((bins, contents))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                room, bins, contents = capacity, -(-left // (capacity // length)), ()
            else:
                room = rooms[at]
                bins, contents = states[room].pop()
                if not states[room]:
                    del states[room], rooms[at]
            each = room // length
            full, rest = min(bins, left // each), 0
            if full:
                put(room - each * length, full, (*contents, (length, each)))
                left -= full * each
            if full < bins and 0 < left < each:
                rest = 1
                put(room - left * length, 1, (*contents, (length, left)))
                left = 0
            if contents and bins - full - rest:
                put(room, bins - full - rest, contents)
    rank, sequence, out = dict.fromkeys(histogram, 0), 0, []
    for room in rooms:
        for bins, contents in states[room]:
            offset = 0
            for length, times in contents:
                for _ in range(times):
                    out.append((length, rank[length], rank[length] + bins, sequence, offset))
                    rank[length] += bins
                    offset += length
            sequence += bins
    return out


def pack(cut_pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds sequence_id and offset to pieces that can be read again cheaply (a checkpoint or a table). No pieces give no rows."""
    spark = cut_pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots_of = spark.createDataFrame(plan(histogram, capacity), "length long, rank_from long, rank_to long, sequence_from long, offset long")
    order = cut_pieces.withColumn("_order", F.shiftrightunsigned(F.xxhash64("doc_id", "piece", "ids_crc32"), 4))
    ranked = slots(order, "length", "_order", ("doc_id", "piece", "ids_crc32"), "_rank_in").drop("_order")
    joined = ranked.join(F.broadcast(slots_of.withColumnRenamed("length", "_length")), (F.col("length") == F.col("_length")) & (F.col("_rank_in") >= F.col("rank_from")) & (F.col("_rank_in") < F.col("rank_to")))
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("_rank_in") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 1024, end_id: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every piece of every document with its sequence and offset.

    Null texts are documents of the end id alone; null and repeated ids and equal rows are pieces like others.
    The broadcast plan has a size bound by the capacity.
    """
    return pack(cut(pieces(docs, vocabulary, capacity, end_id, doc_id, text)), capacity)
