"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into the pieces of the vocabulary's pattern; every distinct piece is encoded once a batch,
all pieces of a length class together: a matrix holds one piece a row, one token a column. In each
round every row finds its leftmost pair of least rank (a hashed pair table gives the ranks of all
pairs at once), merges it, and rows are compacted; rows that have no pair left leave. A piece longer
than LONG bytes takes a heap of the same pairs instead, which is exact too and not quadratic.

A worker remembers what it has encoded: the stretches between single spaces of ordinary text, and the pieces of other
texts (indented code, scripts without spaces), each of at most KEPT characters and REMEMBERED of them at a time, so
what it holds is bounded in bytes. Longer ones are encoded anew.

Defined results: a null text is the empty text and has no tokens; texts of any length are encoded whole, in slices of
several texts, never of a part of one; decoding gives back the encoded bytes; repeated rows are rows of their own, with
the same ids; an empty table gives an empty result; other columns pass through, and the operator's own take the place
of columns of the same name.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import making_room, ship
from .kernels import Grown, HashMap, edges_of, gather, in_slices

#: Bytes of a piece up to which it goes into a matrix.
LONG = 256
#: Distinct stretches of text that a worker remembers, then it starts anew; and their characters at most.
REMEMBERED, KEPT = 700_000, 48
_CLASSES = (2, 3, 4, 5, 6, 8, 10, 12, 16, 24, 32, 64, 128, LONG)
_NONE = 1 << 40
#: A space with white space on both sides.
_AMID = regex.compile(r"\s \s")


class Codec:
    """Encoder and decoder of one rank file."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values()) + 1
        by_id = [b""] * size
        for token, rank in self.ranks.items():
            by_id[rank] = token
        self.lengths = np.fromiter(map(len, by_id), np.int64, size)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.of_byte = np.fromiter((self.ranks[bytes([b])] for b in range(256)), np.uint32, 256)
        pairs = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        self.table = HashMap()
        self.table.insert(np.fromiter((a << 32 | b for a, b in pairs), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int64, len(pairs)))
        self._forget()

    def _forget(self) -> None:
        #: Stretches cut at their pieces, and single pieces, by number; what each number's ids are.
        self.seen: dict[str, int] = {}
        self.seen_pieces: dict[str, int] = {}
        self.ids, self.starts_of, self.lengths_of = Grown(np.uint32), Grown(np.int64), Grown(np.int64)

    def _matrix(self, rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces of up to width bytes, and how many each has."""
        n = len(rows)
        size = np.fromiter(map(len, rows), np.int64, n)
        raw = np.frombuffer(b"".join(rows), np.uint8)
        out = np.zeros((n, width), np.uint32)
        out[np.arange(width) < size[:, None]] = self.of_byte[raw]
        live = np.arange(n)
        tokens, left = out.copy(), size.copy()
        columns = np.arange(width - 1)
        while len(live):
            rank = self.table.get((tokens[:, :-1].astype(np.uint64) << np.uint64(32)) | tokens[:, 1:])
            rank[rank < 0] = _NONE
            rank[columns[: rank.shape[1]] >= (left - 1)[:, None]] = _NONE
            at = rank.argmin(1)  # the leftmost of the least
            best = rank[np.arange(len(live)), at]
            go = best != _NONE
            done = ~go
            out[live[done], : tokens.shape[1]] = tokens[done]
            size[live[done]] = left[done]
            live, tokens, left, at, best = live[go], tokens[go], left[go] - 1, at[go], best[go]
            if len(live):
                tokens[np.arange(len(live)), at] = best
                wide = int(left.max())
                shift = np.arange(wide)[None, :] > at[:, None]
                tokens = np.take_along_axis(tokens, np.minimum(np.arange(wide)[None, :] + shift, tokens.shape[1] - 1), 1)
                if wide == 1:
                    out[live, :1], size[live] = tokens, 1
                    break
        return out, size

    def _heap(self, piece: bytes) -> list[int]:
        """One long piece: the same merges in the same order, found by a heap."""
        token = [int(x) for x in self.of_byte[np.frombuffer(piece, np.uint8)]]
        n, get = len(token), self.pairs.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, k, token[k], token[k + 1]) for k in range(n - 1) if (r := get((token[k], token[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            j = after[k]
            if token[k] != a or j >= n or token[j] != b:
                continue
            token[k], token[j], after[k] = rank, -1, after[j]
            if after[j] < n:
                before[after[j]] = k
                if (r := get((rank, token[after[j]]))) is not None:
                    heapq.heappush(heap, (r, k, rank, token[after[j]]))
            if before[k] >= 0 and (r := get((token[before[k]], rank))) is not None:
                heapq.heappush(heap, (r, before[k], token[before[k]], rank))
        return [t for t in token if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat tokens and the number of tokens of each piece."""
        n = len(pieces)
        counts = np.zeros(n, np.int64)
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, n)
        counts[whole >= 0] = 1
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        rest = np.flatnonzero((whole < 0) & (sizes > 0))
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # piece, its tokens so far, flat tokens
        low = 0
        for width in _CLASSES:
            mine = rest[(sizes[rest] > low) & (sizes[rest] <= width)]
            low = width
            for k in range(0, len(mine), 1 << 15):
                some = mine[k : k + (1 << 15)]
                tokens, got = self._matrix([pieces[x] for x in some], width)
                counts[some] = got
                parts.append((some, got, tokens[np.arange(width) < got[:, None]]))
        for x in rest[sizes[rest] > LONG]:
            tokens = self._heap(pieces[x])
            counts[x] = len(tokens)
            parts.append((np.array([x]), np.array([len(tokens)]), np.array(tokens, np.uint32)))
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])) if n else np.zeros(0, np.int64)
        flat = np.zeros(int(counts.sum()), np.uint32)
        one = whole >= 0
        flat[starts[one]] = whole[one]
        for some, got, tokens in parts:
            ends = np.cumsum(got)
            flat[np.repeat(starts[some] - (ends - got), got) + np.arange(len(tokens))] = tokens
        return flat, counts

    def _learn(self, found: list[list[str]]) -> None:
        """Encode the pieces of stretches not seen before."""
        distinct = dict.fromkeys(p for ps in found for p in ps)
        order = {p: k for k, p in enumerate(distinct)}
        flat, counts = self.encode_pieces([p.encode() for p in distinct])
        starts = np.cumsum(counts) - counts
        index = np.fromiter((order[p] for ps in found for p in ps), np.int64)
        many = np.fromiter(map(len, found), np.int64, len(found))
        ends = np.concatenate(([0], np.cumsum(counts[index])))
        edges = np.concatenate(([0], np.cumsum(many)))
        lengths = ends[edges[1:]] - ends[edges[:-1]]
        self.starts_of.add(self.ids.size + np.cumsum(lengths) - lengths)
        self.lengths_of.add(lengths)
        self.ids.add(gather(starts[index], counts[index], flat))

    def _numbers(self, stretches: list[list[str]], known: dict[str, int], cut: bool) -> list[np.ndarray]:
        """The numbers of each text's stretches, learned where they are new."""
        new = [*set().union(*stretches).difference(known)]
        if new:
            known.update(zip(new, range(self.lengths_of.size, self.lengths_of.size + len(new)), strict=True))
            self._learn([self.pattern.findall(c) for c in new] if cut else [[c] for c in new])
        return [np.fromiter(map(known.__getitem__, c), np.int64, len(c)) for c in stretches]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat token ids of the texts and the number of each text's."""
        if len(self.seen) + len(self.seen_pieces) > REMEMBERED:
            self._forget()
        # Pieces never reach over a single space that has no white space on one of its sides: there a text can be cut
        # first, and most stretches have been seen before. Other texts, and long stretches, are cut into their pieces.
        plain: list[list[str]] = []
        pieces: list[list[str]] = []
        for t in texts:
            cut: list[str] = []
            if t and not _AMID.search(t):
                head, *tail = t.split(" ")
                cut = [head, *map(" ".__add__, tail)] if head else [*map(" ".__add__, tail)]
                if max(map(len, cut)) > KEPT:
                    cut = []
            plain.append(cut)
            pieces.append([] if cut or not t else self.pattern.findall(t))
        rows = self._numbers(plain, self.seen, True)
        long: dict[str, int] = {}
        if any(pieces):
            short = self._numbers([[p for p in ps if len(p) <= KEPT] for ps in pieces], self.seen_pieces, False)
            held = self.ids.size, self.lengths_of.size
            others = self._numbers([[p for p in ps if len(p) > KEPT] for ps in pieces], long, False)
            for k, ps in enumerate(pieces):
                if ps:
                    rows[k] = np.zeros(len(ps), np.int64)
                    is_long = np.fromiter((len(p) > KEPT for p in ps), bool, len(ps))
                    rows[k][~is_long], rows[k][is_long] = short[k], others[k]
        index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        lengths = self.lengths_of.held[index]
        edges = edges_of(lengths)[edges_of(np.fromiter(map(len, rows), np.int64, len(rows)))]
        out = gather(self.starts_of.held[index], lengths, self.ids.held)
        if long:  # encoded for these texts only
            self.ids.size, self.lengths_of.size = held
            self.starts_of.size = held[1]
        return out, np.diff(edges)

    def decode(self, ids: np.ndarray) -> bytes:
        return gather(self.starts[ids], self.lengths[ids], self.flat).tobytes()


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec of a rank file."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """df with `ids` (the token ids as little-endian unsigned 32-bit integers, packed) in place of the text.

    decoded: also the column `decoded`, the bytes that those ids decode to.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            at, n = 0, batch.num_rows
            rest = batch.drop_columns([text_col])
            for texts in in_slices(_texts(batch, text_col)):
                flat, counts = own.encode(texts)
                edges = edges_of(counts)
                rows = [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
                columns = [*rest.slice(at, len(texts)).columns, pa.array([r.astype("<u4").tobytes() for r in rows], pa.binary())]
                if decoded:
                    columns.append(pa.array([own.decode(r) for r in rows], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, "ids", *["decoded"] * decoded])
                at += len(texts)
            assert at == n

    ship(df.sparkSession)
    df = making_room(df, ["ids", *["decoded"] * decoded], keep=(text_col,))
    kept = T.StructType([f for f in df.schema.fields if f.name != text_col])
    return df.mapInArrow(kernel, T.StructType([*kept.fields, T.StructField("ids", T.BinaryType()), *[T.StructField("decoded", T.BinaryType())] * decoded]))


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """df with the column `decoded`: the bytes of packed ids (null: no bytes)."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            out = pa.array([own.decode(np.frombuffer(x or b"", "<u4")) for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "decoded"])

    ship(df.sparkSession)
    df = making_room(df, ["decoded"], keep=(ids_col,))
    return df.mapInArrow(kernel, T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())]))
