"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word the last token of its encoding is unique: the one token that is a suffix of the
prefix and can stand behind the last token of what is left. A suffix automaton over the vocabulary yields the
tokens that end at each place, longest first; a pair test tells whether two tokens stay apart under the merge
order; the last token of every prefix is stored, and following these back from the end gives the exact ids.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import model, ship, tidy
from .textcore import Block, RaggedTable, blocks, gather

#: Chunks between white space (in array pools), and pieces, whose encodings a worker keeps.
CHUNKS_KEPT, PIECES_KEPT = 1_500_000, 500_000
#: Characters before which a word of ASCII letters is cut: each starts a piece of its own kind.
MARKS = b".,!?;:"
#: First character whose class is left to the library.
BEYOND_LATIN = "\u0250"
#: The pieces of a chunk under the vocabulary's own pre-tokenization (fixed values of the file format).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class SuffixAutomaton:
    """Of a set of words over small integers. `token[state]` is the word a state stands for, or -1; `up[state]` the next shorter suffix that is a word."""

    def __init__(self, words: list[tuple[list[int], int]]):
        step: list[dict[int, int]] = [{}]
        link, length, token = [-1], [0], [-1]

        def state(size: int, moves: dict[int, int], to: int) -> int:
            step.append(moves), link.append(to), length.append(size), token.append(-1)
            return len(link) - 1

        def divide(p: int, sym: int, q: int) -> int:
            """A state for the strings of q up to one longer than p."""
            twin = state(length[p] + 1, dict(step[q]), link[q])
            link[q] = twin
            while p >= 0 and step[p].get(sym) == q:
                step[p][sym] = twin
                p = link[p]
            return twin

        def extend(last: int, sym: int) -> int:
            q = step[last].get(sym)
            if q is not None:
                return q if length[q] == length[last] + 1 else divide(last, sym, q)
            new, p = state(length[last] + 1, {}, 0), last
            while p >= 0 and sym not in step[p]:
                step[p][sym] = new
                p = link[p]
            if p >= 0:
                q = step[p][sym]
                link[new] = q if length[q] == length[p] + 1 else divide(p, sym, q)
            return new

        for syms, name in words:
            at = 0
            for sym in syms:
                at = extend(at, sym)
            token[at] = name
        up = [0] * len(link)
        for v in sorted(range(1, len(link)), key=length.__getitem__):
            up[v] = link[v] if token[link[v]] >= 0 else up[link[v]]
        self.link, self.length, self.token, self.up = link, length, token, up
        self.moves = {v << 10 | sym: to for v, moves in enumerate(step) for sym, to in moves.items()}


class WordEncoder:
    """Encodes words (as base symbols) under a merge list."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        self.name = {i: t for t, i in vocab.items()}
        letters = byte_letters()
        self.inner = [vocab[letters[b]] for b in range(256)]
        self.final = [vocab[letters[b] + end] for b in range(256)]
        self.base = {t: k for k, t in enumerate(dict.fromkeys(self.inner + self.final))}
        self.inner_sym, self.final_sym = [self.base[t] for t in self.inner], [self.base[t] for t in self.final]
        self.pair: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.pair.setdefault((x, y), rank)
            self.made.setdefault(z, (x, y, rank))
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.apart: dict[int, bool] = {}
        self.symbols: dict[int, list[int]] = {t: [k] for t, k in self.base.items()}
        for t in self.made:
            self._spell(t)
        whole = [t for t in self.made if self._whole(t)]
        self.automaton = SuffixAutomaton([(self.symbols[t], t) for t in whole])
        self.single = list(self.base)

    def _spell(self, t: int) -> list[int]:
        if t not in self.symbols:
            x, y, _ = self.made[t]
            self.symbols[t] = self._spell(x) + self._spell(y)
        return self.symbols[t]

    def _edge(self, t: int, right: bool) -> list[tuple[int, int]]:
        """(part, rank at which it is merged into the next) from a token inwards along its edge."""
        kept = self._right if right else self._left
        if t not in kept:
            part, until, out = t, len(self.pair), []
            while True:
                out.append((part, until))
                if part not in self.made:
                    break
                x, y, until = self.made[part]
                part = y if right else x
            kept[t] = out
        return kept[t]

    def _crossed(self, left: int, right: int, skip: tuple[int, int] | None = None) -> bool:
        """Does a merge across the border between two tokens come before what keeps it from coming? Equal ranks go to the left place."""
        for x, x_until in self._edge(left, True):
            for y, y_until in self._edge(right, False):
                rank = self.pair.get((x, y))
                if rank is not None and (x, y) != skip and rank < x_until and rank <= y_until:
                    return True
        return False

    def _whole(self, t: int) -> bool:
        """Does the token's own spelling encode as this one token? Parts are looked at too."""
        todo = [t]
        while todo:
            t = todo.pop()
            if t not in self.made:
                continue
            x, y, rank = self.made[t]
            for a, a_until in self._edge(x, True):
                for b, b_until in self._edge(y, False):
                    r = self.pair.get((a, b))
                    if r is not None and r < rank and r < a_until and r <= b_until:
                        return False
            todo += [x, y]
        return True

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece, its last byte being the end of the word."""
        syms = [self.inner_sym[b] for b in piece[:-1]]
        syms.append(self.final_sym[piece[-1]])
        auto = self.automaton
        moves, link, length, token, up, apart, single = auto.moves, auto.link, auto.length, auto.token, auto.up, self.apart, self.single
        last, size, state, matched = [-1], [0], 0, 0
        for i, sym in enumerate(syms, 1):
            to = moves.get(state << 10 | sym)
            while to is None and state:
                state = link[state]
                matched = length[state]
                to = moves.get(state << 10 | sym)
            if to is None:
                matched = 0
            else:
                state, matched = to, matched + 1
            v = state if matched == length[state] and token[state] >= 0 else up[state]
            found = -1
            while v:
                t, j = token[v], i - length[v]
                if j == 0:
                    found, n = t, i
                    break
                key = last[j] << 20 | t
                ok = apart.get(key)
                if ok is None:
                    ok = apart[key] = not self._crossed(last[j], t)
                if ok:
                    found, n = t, length[v]
                    break
                v = up[v]
            if found < 0:
                found, n = single[sym], 1
            last.append(found)
            size.append(n)
        ids, i = [], len(syms)
        while i:
            ids.append(last[i])
            i -= size[i]
        ids.reverse()
        return ids


class TextCodec:
    """Encodes and decodes whole texts under a tokenizer file with lower-cased words and end-of-word tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.words = WordEncoder(model["vocab"], merges, model["end_of_word_suffix"])
        self.names = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)))
        self.piece = regex.compile(PIECES)
        self.library = Tokenizer.from_file(path)
        self.byte_of = {c: b for b, c in byte_letters().items()}
        self.chunks = RaggedTable((np.dtype("<u4"), np.uint8), CHUNKS_KEPT)
        self.pieces: dict[str, tuple[int, ...]] = {}

    def _of_piece(self, piece: str) -> tuple[int, ...]:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= PIECES_KEPT:
                self.pieces.clear()
                self.words.apart.clear()
            ids = self.pieces[piece] = tuple(self.words.encode(piece.encode()))
        return ids

    def _plain(self, text: str) -> Iterator[int]:
        if text and max(text) >= BEYOND_LATIN:
            # which characters are letters there depends on the library's own tables, so it cuts the pieces
            for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text)):
                yield from self.words.encode(bytes(map(self.byte_of.__getitem__, piece)))
            return
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text])
        else:
            text = text.lower()
        if text.isalpha() and text.isascii():
            yield from self._of_piece(text)
            return
        for piece in self.piece.findall(text):
            yield from self._of_piece(piece)

    def chunk_ids(self, chunk: bytes) -> list[int]:
        """Ids of a chunk without ASCII white space; special tokens inside count as such."""
        text = chunk.decode("utf-8")
        if "<|" not in text:
            return list(self._plain(text))
        ids, at = [], 0
        for m in self.cut.finditer(text):
            ids += self._plain(text[at : m.start()])
            ids.append(self.special[m[0]])
            at = m.end()
        return ids + list(self._plain(text[at:]))

    def _chunk(self, chunk: bytes) -> tuple[list[int], bytes]:
        """Ids of a chunk, and their strings each with a blank behind."""
        ids = self.chunk_ids(chunk)
        return ids, "".join([self.names[i] + " " for i in ids]).encode()

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids as little-endian unsigned 32-bit integers, UTF-8 of the decoded text) of each text of a binary column; null counts as empty.

        Word types are told apart after lower-casing A-Z, as the vocabulary does; texts that may hold a special token take their own way.
        """
        for _, _, block in blocks(column, fold_ascii=True, marks=MARKS):
            raw = block.buf.tobytes()

            def make(at: np.ndarray, raw: bytes = raw, block: Block = block) -> tuple[list, list]:
                chunks = [raw[s:e] for s, e in zip(block.start[at].tolist(), block.end[at].tolist(), strict=True)]
                made = [(None, None) if b"<|" in c else self._chunk(c) for c in chunks]
                return [m[0] for m in made], [m[1] for m in made]

            found = self.chunks.of(block.hash, make) if len(block.start) else []
            special = set(block.doc[found[0][1] < 0].tolist()) if found else ()
            out = []
            for pool, (place, length) in zip(self.chunks.pool, found, strict=False):
                size = np.maximum(length, 0).astype(np.int64)
                out.append((gather(pool, place, size), np.concatenate([[0], np.cumsum(size)])[block.first]))
            if not out:
                out = [(np.zeros(0, dtype=d), np.zeros(block.n + 1, dtype=np.int64)) for d in self.chunks.dtypes]
            (ids, ids_at), (text, text_at) = out
            for k in range(block.n):
                if k in special:
                    made = [self._chunk(c) for c in raw[block.offsets[k] : block.offsets[k + 1]].split()]
                    yield np.array([i for m in made for i in m[0]], dtype="<u4"), np.frombuffer(b"".join([m[1] for m in made])[:-1], dtype=np.uint8)
                    continue
                yield ids[ids_at[k] : ids_at[k + 1]], text[text_at[k] : max(text_at[k + 1] - 1, text_at[k])]

    def decode(self, ids: list[int]) -> str:
        """The token strings with spaces between, as a tokenizer without a decoder does."""
        return " ".join(self.names[i] for i in ids)


def codec(path: str) -> TextCodec:
    """The worker's own, kept over its tasks."""
    return model(TextCodec, path)


def encode_texts(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids and decoded for every whole text.

    A null text counts as empty: no ids and an empty decoded text. Ids may be null or repeat; other columns
    are not read. Rows are mapped where they lie. The vocabulary file has to be at that path on every executor.
    """
    ship(docs.sparkSession)
    kind = docs.schema[doc_id].dataType
    fields = [("n_tokens", "long"), ("ids_sha256", "string"), ("decoded_sha256", "string")] + ([("ids", "array<long>"), ("decoded", "string")] if with_ids else [])
    schema = f"doc_id {kind.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            counts, of_ids, of_text, ids_out, text_out = [], [], [], [], []
            for ids, decoded in own.encode_column(batch.column(1)):
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(decoded).hexdigest())
                if with_ids:
                    ids_out.append(ids.tolist())
                    text_out.append(decoded.tobytes().decode())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
            if with_ids:
                columns += [pa.array(ids_out, pa.list_(pa.int64())), pa.array(text_out, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *[n for n, _ in fields]])

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(tidy(run, own_model=True), schema)
