"""Sampled segmentation into SentencePiece pieces, and decoding.

Forward filtering, backward sampling: over the lattice of all segmentations
of a text into pieces, forward sums give every prefix its total weight, and a
segmentation is drawn from the end backwards, each piece with its share of
the sum. Draws are hashes of the row's key and the place in the text, so a
row always gets the same segmentation. No piece reaches over the start of a
run of spaces or a line break, nor past ``LONGEST_CHUNK`` characters without
either, so the lattice falls into short chunks. The distinct chunks of a batch
are filtered together, position by position, and all their occurrences are
sampled together. Batches are bounded by characters, not by rows: a longer
text goes in several, each of which knows its place in the text, so the
pieces are the same however texts are batched.

The vocabulary's scores are ranks of merges, not log-probabilities: a piece's
weight is 1 / (rank + 1), to the power ``alpha``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import _mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_SPACE = "▁"
#: Stand-ins, in a text, for the space mark itself and for the character that ends a chunk here.
_MARK, _NUL = 0x10FFFE, 0x10FFFD
#: Characters of a chunk at most: longer runs without a space or line break are cut there.
LONGEST_CHUNK = 1_024
_CHUNK = re.compile(rf"\n| {{0,{LONGEST_CHUNK}}}[^ \n]{{1,{LONGEST_CHUNK}}}| {{1,{LONGEST_CHUNK}}}")
#: Bounds of a batch: characters of its distinct chunks (each takes about 200 bytes here), and chunks in all.
DISTINCT_CHARS, CHUNKS = 250_000, 250_000
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
_CODE = 1 << 20  # a piece code from here on: this character by its bytes
_U = np.uint64


class Vocabulary:
    """Pieces by id with their log weights, the ids of the 256 bytes, and what ids decode to."""

    def __init__(self, pieces: list[str], scores: list[float], byte_ids: list[int], special: list[int]):
        self.pieces, self.byte_ids, self.special = pieces, byte_ids, special
        rank = np.array(scores)
        rank = np.where(rank <= 0, -rank, 0)
        rank[rank > 1e6] = len(pieces)  # single characters have no merge: as rare as the last piece
        self.log_weight = -np.log(rank + 1.0) - np.log(np.log(len(pieces)) + 0.5772)
        drop = set(special)
        self.bytes = [b"" if i in drop else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        for b, i in enumerate(byte_ids):
            self.bytes[i] = bytes([b])

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = range(sp.get_piece_size())
        by = {int(m[1], 16): i for i in n if sp.is_byte(i) and (m := _BYTE.fullmatch(sp.id_to_piece(i)))}
        if len(by) != 256:
            raise ValueError("the vocabulary has no piece for some byte, so decoding could lose text")
        return cls([sp.id_to_piece(i) for i in n], [sp.get_score(i) for i in n], [by[b] for b in range(256)], [i for i in n if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)])

    def join(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text: pieces joined, without the space that stands before every text."""
        return self.join(ids).decode("utf-8", "surrogatepass")[1:]


class _Batch:
    """Parts of texts, as chunk numbers, and the distinct chunks in order of their numbers."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.rows, self.tokens, self.seeds, self.places = [], [], [], []
        self.chars = self.n = 0

    def add(self, row: int, seed: int, place: int, chunks: list[str]) -> None:
        before = len(self.index)
        self.tokens.append(np.fromiter([self.index.setdefault(c, len(self.index)) for c in chunks], np.int64, len(chunks)))
        self.chars += sum(map(len, islice(reversed(self.index), len(self.index) - before)))
        self.n += len(chunks)
        self.rows.append(row)
        self.seeds.append(seed)
        self.places.append(place)


class Sampler:
    """Draws segmentations for batches of texts."""

    def __init__(self, vocabulary: Vocabulary, alpha: float = 1.0, seed: int = 0):
        self.v, self.seed = vocabulary, seed
        self.weight = np.append(vocabulary.log_weight * alpha, -np.inf)  # the last: no piece
        fixed = set(vocabulary.byte_ids) | set(vocabulary.special)
        trie: dict[tuple[int, str], int] = {}
        ends: dict[int, int] = {}
        for i, p in enumerate(vocabulary.pieces):
            if i in fixed or not p:
                continue
            node = 0
            for c in p:
                node = trie.setdefault((node, c), len(trie) + 1)
            ends.setdefault(node, i)
        self.longest = max(len(vocabulary.pieces[i]) for i in ends.values())
        keys = np.array([n * (1 << 21) + ord(c) for n, c in trie], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.array(list(trie.values()), np.int64)[order]
        self.piece = np.full(len(trie) + 1, -1, np.int32)
        self.piece[list(ends)] = list(ends.values())
        self.root = np.zeros(0x110000, np.int32)
        for (n, c), to in trie.items():
            if n == 0:
                self.root[ord(c)] = to
        self.by_bytes = float(alpha * vocabulary.log_weight.min())

    def _lattice(self, flat: np.ndarray) -> np.ndarray:
        """Codes of the pieces of each length that start at each place (row = length - 1); -1 for none."""
        out = np.full((self.longest, len(flat)), -1, np.int32)
        at = np.flatnonzero(self.root[flat])
        node = self.root[flat[at]].astype(np.int64)
        for length in range(1, self.longest + 1):
            out[length - 1, at] = self.piece[node]
            at, node = at[at + length < len(flat)], node[at + length < len(flat)]
            if not len(at):
                break
            key = node * (1 << 21) + flat[at + length]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = self.keys[k] == key
            at, node = at[good], self.next[k[good]]
        alone = (out[0] < 0) & (flat > 0)
        out[0, alone] = _CODE + flat[alone]
        return out

    def __call__(self, texts: list[str | None], keys: list, distinct_chars: int = DISTINCT_CHARS, chunks: int = CHUNKS) -> Iterator[tuple[int, np.ndarray, bool]]:
        """(row, ids, same) of the texts' segmentations, in order, in as many parts as batches share a text; ``same``: the ids decode to that part."""
        batch = _Batch()
        for r, t in enumerate(texts):
            if not t:
                continue
            seed, place = xxhash.xxh3_64_intdigest(str(keys[r]), self.seed), 0
            found = _CHUNK.finditer(" " + t)
            while part := list(islice(found, 4_096)):
                if batch.index and (batch.chars >= distinct_chars or batch.n + len(part) > chunks):
                    yield from self._run(batch)
                    batch = _Batch()
                batch.add(r, seed, place, [m[0] for m in part])
                place += len(part)
        if batch.index:
            yield from self._run(batch)

    def _run(self, batch: _Batch) -> Iterator[tuple[int, np.ndarray, bool]]:
        chunks = [c.replace(_SPACE, chr(_MARK)).replace("\x00", chr(_NUL)).replace(" ", _SPACE) for c in batch.index]
        flat = np.frombuffer(("\x00".join(chunks) + "\x00").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
        pieces = self._lattice(flat)
        share = self._filter(pieces, start, size, len(flat))
        per_part = np.array([len(x) for x in batch.tokens], np.int64)
        ids, offsets = self._sample(pieces, share, np.concatenate(batch.tokens), start, size, per_part, np.array(batch.seeds, np.uint64), np.array(batch.places, np.int64))
        raw = [c.encode("utf-8", "surrogatepass") for c in batch.index]
        for r, tokens, a, b in zip(batch.rows, batch.tokens, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            part = ids[a:b]
            yield r, part, self.v.join(part.tolist()) == b"".join([raw[k] for k in tokens.tolist()])

    def _filter(self, pieces: np.ndarray, start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
        """For each place between characters: cumulative shares of the pieces that end there, by length."""
        none = len(self.weight) - 1
        total, share = np.full(n, -np.inf), np.full((n, self.longest), 2.0, np.float32)
        total[start] = 0.0
        order = np.argsort(-size, kind="stable")
        by_size, first = size[order], start[order]
        for d in range(1, int(size.max()) + 1):
            here = first[: np.searchsorted(-by_size, -d, side="right")] + d
            m = min(self.longest, d)
            v = np.empty((len(here), m))
            for length in range(1, m + 1):
                code = pieces[length - 1, here - length]
                w = self.weight[np.where(code < 0, none, np.minimum(code, none))]
                if length == 1:
                    w = np.where(code >= _CODE, self.by_bytes, w)
                v[:, length - 1] = total[here - length] + w
            top = v.max(axis=1)
            e = np.exp(v - top[:, None]).cumsum(axis=1)
            total[here] = top + np.log(e[:, -1])
            share[here, :m] = np.where(e >= e[:, -1:], 2.0, e / e[:, -1:])  # rounding never leads past the last
        return share

    def _sample(self, pieces, share, token, start, size, per_row, seeds, places) -> tuple[np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(per_row)), per_row)
        place = np.arange(len(token)) + np.repeat(places - (np.cumsum(per_row) - per_row), per_row)
        base = _mix(seeds[row] + place.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
        live, at, steps, drawn = np.arange(len(token)), start[token] + size[token], np.zeros(len(token), np.int64), []
        low = start[token]
        k = 0
        while len(live):
            u = (_mix(base[live] + _U(k * 0xD1B54A32D192ED03 % 2**64)) >> _U(11)).astype(np.float64) / 2.0**53
            length = (share[at] <= u[:, None].astype(np.float32)).sum(axis=1) + 1
            at = at - length
            drawn.append((live, pieces[length - 1, at]))
            steps[live] += 1
            go = at > low[live]
            live, at = live[go], at[go]
            k += 1
        end = np.cumsum(steps)
        out = np.empty(int(end[-1]), np.int32)
        for k, (who, code) in enumerate(drawn):
            out[end[who] - 1 - k] = code
        count = np.bincount(row, steps, len(per_row)).astype(np.int64)
        if (out >= _CODE).any():
            out, count = self._spell(out, count)
        return out, np.concatenate([[0], np.cumsum(count)])

    def _spell(self, codes: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters without a piece become the pieces of their bytes."""
        odd = np.flatnonzero(codes >= _CODE)
        chars, which = np.unique(codes[odd] - _CODE, return_inverse=True)
        real = [{_MARK: _SPACE, _NUL: "\x00"}.get(int(c), chr(int(c))).encode("utf-8", "surrogatepass") for c in chars]
        width = np.ones(len(codes), np.int64)
        width[odd] = np.array([len(b) for b in real])[which]
        out = np.repeat(codes, width)
        begin = np.cumsum(width) - width
        ids = np.array(self.v.byte_ids)
        for j in range(max(map(len, real))):
            has = np.array([j < len(b) for b in real])[which]
            value = np.array([b[j] if j < len(b) else 0 for b in real])[which]
            out[begin[odd][has] + j] = ids[value[has]]
        row = np.repeat(np.arange(len(count)), count)
        return out, np.bincount(row, width, len(count)).astype(np.int64)


#: Rows that are held at once in a task, and characters of them after which results go out.
_ROWS, _OUT_CHARS = 256, 2_000_000


def encode_sampled(docs: DataFrame, vocabulary: Vocabulary, *, key_col: str = "doc_id", text_col: str = "text", alpha: float = 1.0, seed: int = 0) -> DataFrame:
    """The columns of ``docs`` with ``pieces`` (array of ids), ``n_pieces`` and ``lossless`` put last.

    ``lossless`` says whether the ids decode to the very text; it is true for
    every text but null (a null text has null pieces, 0 of them, and null
    there). An empty text has none. Characters outside the vocabulary, and the
    vocabulary's own mark for a space, go by their bytes. Rows with equal
    keys and texts get equal pieces; a null key is a key. An empty table gives
    no rows. Very long texts are encoded whole, part by part, in memory of the
    order of their pieces. Columns of ``docs`` with the names added are
    replaced; no other name matters.
    """
    kept = [c for c in docs.columns if c not in ("pieces", "n_pieces", "lossless")]
    sent = docs.sparkSession.sparkContext.broadcast(Sampler(vocabulary, alpha, seed))

    def slices(batch: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """Slices of few rows and, but for single rows, few characters."""
        length = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_pylist()
        first = total = 0
        for at, n in enumerate(length):
            if at > first and (total + n > _OUT_CHARS or at - first >= _ROWS):
                yield batch.slice(first, at - first)
                first, total = at, 0
            total += n
        if first < len(batch):
            yield batch.slice(first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sent.value
        for batch in batches:
            for part in slices(batch, batch.schema.get_field_index(text_col)):
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                ids, count, same = [], np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
                for r, found, good in sampler(texts, part.column(part.schema.get_field_index(key_col)).to_pylist()):
                    ids.append(found)
                    count[r] += len(found)
                    same[r] &= good
                nulls = np.array([t is None for t in texts], bool)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                cols = [pa.ListArray.from_arrays(offsets, flat, mask=pa.array(nulls)), pa.array(count), pa.array(same, pa.bool_(), mask=nulls)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "pieces", "n_pieces", "lossless"])

    src = docs.select(*kept).withColumn(text_col, F.col(text_col).cast("string"))
    added = [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("lossless", T.BooleanType())]
    return src.mapInArrow(run, T.StructType([*src.schema.fields, *added]))


def decode_pieces(encoded: DataFrame, vocabulary: Vocabulary, *, pieces_col: str = "pieces", text_col: str = "text") -> DataFrame:
    """The rows with ``text_col`` decoded from ``pieces_col``; null pieces give null, none the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(pieces_col)
            text = pa.array([None if x is None else vocabulary.decode(x) for x in batch.column(k).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, text_col])

    src = encoded.drop(text_col)
    return src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField(text_col, T.StringType())]))
