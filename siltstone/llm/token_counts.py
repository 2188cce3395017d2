"""Exact token counts at every prefix of a text, by dynamic programming over a BPE piece model.

The encoding of a prefix ends in exactly one piece, and a piece may follow another if and only if the two,
joined, are encoded as those two again. So the last piece of the prefix [0, i) is the one piece w
ending at i for which (last piece of [0, i - len(w)), w) is such a pair, and its count is one more than
that prefix's. The table of counts answers how many tokens a prefix has and which prefix fits a
budget, without encoding anything again.

No piece holds a space mark after another character, so the table of a text is its words' tables, each
added to the count before it. Words recur, and a worker keeps their whole tables, a byte an entry: totals, the
counts at every prefix and the prefix that fits a budget are all read from them. Where only totals are asked for, it
keeps the last entry of each table, by word, so a text is one look at each of its words. Words of more than KEPT characters
have their tables made for the texts at hand and not kept, and a batch's texts become strings a slice at a time, so what a
worker holds is bounded in bytes: two workers share an executor with its JVM, whose heap earlier steps have filled.

Defined results: a null text is the empty text and has 0 tokens; special strings in a text are ordinary
text; texts and words of any length are counted whole, words of up to the widest matrix many at a time, longer ones
character by character; repeated rows are rows of their own; an empty table gives an empty result; other columns pass
through, and the operator's own take the place of columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import making_room, ship
from .kernels import Grown, HashMap, edges_of, give_back, text_slices

#: Bytes of words and tables that a worker keeps, then it starts anew; about what a word takes beside its characters and entries; and a kept word's characters at most.
REMEMBERED, A_WORD, KEPT = 32 << 20, 140, 64
#: Pairs of pieces whose order a worker remembers; then it starts anew.
PAIRS = 1_000_000
_CLASSES = (8, 12, 16, 24, 64, 256)
_BASE = 0x9E3779B97F4A7C15
#: The mark of a space inside pieces.
MARK = "▁"
_WORDS = re.compile(" +[^ ]*")
#: The score of what doesn't merge.
_NONE = float("-inf")


class _Counts(dict):
    """Counts of words; one that is missing is taken over from earlier ones, or counts 0 and is put down."""

    def __init__(self, earlier: dict[str, int]) -> None:
        self.earlier, self.new, self.chars = earlier, [], 0

    def __missing__(self, word: str) -> int:
        count = self.earlier.get(word)
        if count is None:
            self.new.append(word)
            return 0
        self[word] = count
        self.chars += len(word)
        return count


class PrefixCounter:
    """Prefix token counts under a sentencepiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))]
        #: Pieces, spaces for marks, and their scores: the higher merges first.
        self.scores = {model.id_to_piece(k).replace(MARK, " "): model.get_score(k) for k in normal}
        if any(" " in p.lstrip(" ") for p in self.scores):
            raise ValueError("a piece has a space mark after another character; words can't be told apart")
        self.longest = max(map(len, self.scores))
        self.ids = {p: k for k, p in enumerate(self.scores)}
        self.pieces = list(self.scores)
        #: How each piece comes about: of every merge its score, and the first and the last symbol after it.
        self.steps: list[list[tuple[float, str, str]]] = []
        same = {p: p for p in self.pieces}
        for p in self.pieces:
            symbols, steps = self._merge([*p])
            self.steps.append([(s, same.get(a, a), same.get(b, b)) for s, a, b in steps])
            if symbols != [p]:  # a piece that its own text isn't encoded to never occurs
                del self.ids[p]
        # Of each beginning of a piece: 2 * (its own piece's number + 1), or 0, and 1 if a longer piece begins so.
        begins = {p[:k]: 1 for p in self.ids for k in range(1, len(p))}
        for p, k in self.ids.items():
            begins[p] = begins.get(p, 0) + 2 * (k + 1)
        self.by_hash = HashMap(18)
        self.by_hash.insert(np.array([self._hash(p) for p in begins], np.uint64), np.fromiter(begins.values(), np.int64, len(begins)))
        self._forget_pairs()
        self._forget()

    def _forget_pairs(self) -> None:
        self.follows: dict[int, bool] = {}
        self.pairs = HashMap(18)

    def _forget(self) -> None:
        #: Words by number; where each number's table starts, its length; the tables, and of each entry over 255 the place and the count.
        self.seen: dict[str, int] = {}
        self.starts, self.sizes, self.entries = Grown(np.int64), Grown(np.int64), Grown(np.uint8)
        self.large: dict[int, int] = {}
        self.late: list[str] = []  # words too long to keep
        #: Tokens of words, without their first space, whose tables nobody asked for; and of those met before, in half the room each.
        self.whole = _Counts({})

    @staticmethod
    def _hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _BASE + ord(c) + 1) % 2**64
        return h

    def _merge(self, symbols: list[str]) -> tuple[list[str], list[tuple[float, str, str]]]:
        """Encode a short text: the best-scored, then leftmost, pair merges until none is left; and each merge's score, first and last symbol."""
        score, steps = self.scores.get, []
        found = [score(a + b, _NONE) for a, b in pairwise(symbols)]
        while found and (best := max(found)) > _NONE:
            k = found.index(best)
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
            del found[k]
            if k:
                found[k - 1] = score(symbols[k - 1] + symbols[k], _NONE)
            if k < len(found):
                found[k] = score(symbols[k] + symbols[k + 1], _NONE)
            steps.append((best, symbols[0], symbols[-1]))
        return symbols, steps

    def _pair(self, a: int, b: int) -> bool:
        """Whether two pieces, joined, are encoded as those two: no merge across them is the best one, or the leftmost best, before both are whole."""
        score, end = self.scores.get, (_NONE, "", "")
        left, right = iter(self.steps[a]), iter(self.steps[b])
        last, first = self.pieces[a][-1], self.pieces[b][0]
        mine, other = next(left, end), next(right, end)
        across = score(last + first, _NONE)
        while True:
            if across > mine[0] and across >= other[0]:
                return False
            if mine[0] >= other[0]:
                if mine is end:
                    return True
                if mine[2] is not last:
                    last = mine[2]
                    across = score(last + first, _NONE)
                mine = next(left, end)
            else:
                if other[1] is not first:
                    first = other[1]
                    across = score(last + first, _NONE)
                other = next(right, end)

    def table(self, word: str) -> np.ndarray:
        """Token counts of the prefixes of 1, 2, ... characters of a word."""
        ids, follows, longest = self.ids, self.follows, self.longest
        n = len(word)
        last, count = [-1] * (n + 1), [0] * (n + 1)
        for i in range(1, n + 1):
            for j in range(i - longest if i > longest else 0, i):
                piece = ids.get(word[j:i])
                if piece is None:
                    continue
                before = last[j]
                if before < 0:  # the start, or a character of bytes, which merges with nothing
                    ok = True
                else:
                    ok = follows.get(before << 20 | piece)
                    if ok is None:
                        if len(follows) >= PAIRS:
                            follows.clear()
                        ok = follows[before << 20 | piece] = self._pair(before, piece)
                if ok:
                    last[i], count[i] = piece, count[j] + 1
                    break
            else:  # a character that is no piece: one token for each of its bytes
                last[i], count[i] = -1, count[i - 1] + len(word[i - 1].encode("utf-8", "surrogatepass"))
        return np.array(count[1:], np.int64)

    def _may_follow(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece can stand after the one before it."""
        keys = (before.astype(np.uint64) << np.uint64(20)) | piece.astype(np.uint64)
        found = self.pairs.get(keys)
        if (found < 0).any():
            if self.pairs.count > PAIRS:
                self._forget_pairs()
                found = self.pairs.get(keys)
            new = np.unique(keys[found < 0])
            ok = np.fromiter((self._pair(int(k) >> 20, int(k) & 0xFFFFF) for k in new), np.int64, len(new))
            self.pairs.insert(new, ok)
            found = self.pairs.get(keys)
        return found > 0

    def _hits(self, codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """(start in the flat text, length, piece) of every piece inside the words; a start is followed only as far as some piece begins so."""
        start, stop = np.arange(len(codes), dtype=np.int32), np.repeat(edges_of(size)[1:].astype(np.int32), size)
        sums, hits = codes + np.uint64(1), []
        for k in range(1, self.longest + 1):
            found = self.by_hash.get(sums)
            own = np.flatnonzero(found > 1)
            hits.append((start[own], np.full(len(own), k, np.int16), ((found[own] >> 1) - 1).astype(np.int32)))
            on = np.flatnonzero((found > 0) & (found & 1 > 0) & (start + np.int32(k) < stop))
            if not len(on):
                break
            start, stop = start[on], stop[on]
            sums = sums[on] * np.uint64(_BASE) + codes[start + k] + np.uint64(1)
        return tuple(np.concatenate(x) for x in zip(*hits, strict=True))

    def tables(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
        """(flat, sizes): the tables of words of up to width characters, all at once, place by place."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.repeat(np.arange(n, dtype=np.int32), size)
        place = np.arange(len(codes), dtype=np.int32) - np.repeat(edges_of(size)[:-1].astype(np.int32), size)
        at = place * np.int32(n) + word  # the tables' order: place by place, all words
        start, length, piece = self._hits(codes, size)
        end = place[start].astype(np.int16) + length
        order = np.argsort(end, kind="stable")
        start, piece = start[order], piece[order]
        parts = np.searchsorted(end[order], np.arange(1, width + 2).astype(np.int16))
        row, origin = word[start], at[start]
        last = np.full((width + 1) * n, -1, np.int32)
        count = np.zeros((width + 1, n), np.int32)
        flat = count.reshape(-1)
        in_bytes = np.zeros((width, n), np.int8)
        in_bytes.reshape(-1)[at] = 1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF)
        for i in range(1, width + 1):
            np.add(count[i - 1], in_bytes[i - 1], out=count[i])  # where no piece ends: one token for each of the character's bytes
            r, j, p = (x[parts[i - 1] : parts[i]] for x in (row, origin, piece))
            before = last[j]
            ok = before < 0
            ask = np.flatnonzero(~ok)
            if len(ask):
                ok[ask] = self._may_follow(before[ask], p[ask])
            r, j = r[ok], j[ok]
            last[i * n : (i + 1) * n][r] = p[ok]
            count[i][r] = flat[j] + 1
        return flat[at + np.int32(n)].astype(np.int64), size

    def words(self, text: str) -> list[str]:
        """The words of a text, spaces in front; the model puts one before the text."""
        if not text:
            return []
        text = f" {text.replace(MARK, ' ')}"
        return _WORDS.findall(text) if "  " in text or text[-1] == " " else [*map(" ".__add__, text[1:].split(" "))]

    def _keys(self, text: str) -> list[str]:
        """The words of a text, each without its first space."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        return [w[1:] for w in _WORDS.findall(f" {text}")] if "  " in text or text[0] == " " else text.split(" ")

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The numbers of each text's words, learned where they are new."""
        if self.whole or self.whole.earlier:
            self.whole = _Counts({})
        if new := set().union(*texts).difference(self.seen):
            ordered = sorted(new, key=len)
            self.late += [w for w in ordered if len(w) > KEPT]
            self.learn(ordered)
        return [np.fromiter(map(self.seen.__getitem__, words), np.int64, len(words)) for words in texts]

    def _learned(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(flat, sizes) of the tables of words in ascending order of length, some at a time."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        low = 0
        for width in (*_CLASSES, None):
            end = len(words) if width is None else int(np.searchsorted(sizes, width, "right"))
            step = 1 if width is None else max(1, (1 << 18) // width)
            for k in range(low, end, step):
                part = words[k : min(k + step, end)]
                yield (self.table(part[0]), sizes[k : k + 1]) if width is None else self.tables(part, width)
            low = end

    def learn(self, words: list[str]) -> None:
        """Tables of words not seen before, in ascending order of length."""
        self.seen.update(zip(words, range(self.sizes.size, self.sizes.size + len(words)), strict=True))
        for flat, own in self._learned(words):
            self.starts.add(self.entries.size + edges_of(own)[:-1])
            self.sizes.add(own)
            for at in np.flatnonzero(flat > 255).tolist():
                self.large[self.entries.size + at] = int(flat[at])
            self.entries.add(np.minimum(flat, 255).astype(np.uint8))

    def totals(self, texts: list[str]) -> list[int]:
        """The numbers of tokens of whole texts, where no prefix is asked for: words' totals are kept and not their tables. Words' numbers given out before end here."""
        if self.seen:
            self._forget()
        known, new, out, lacking = self.whole, self.whole.new, [], []
        for k, text in enumerate(texts):
            before = len(new)
            out.append(sum(map(known.__getitem__, self._keys(text))))
            if len(new) > before:
                lacking.append((k, before, len(new)))
        if new:
            ordered = sorted(set(new), key=len)
            counts = [flat[edges_of(own)[1:] - 1] for flat, own in self._learned([*map(" ".__add__, ordered)])]
            known.update(zip(ordered, np.concatenate(counts).tolist(), strict=True))
            for k, low, high in lacking:
                out[k] += sum(map(known.__getitem__, new[low:high]))
            new.clear()
            while ordered and len(ordered[-1]) >= KEPT:  # with its space too long to keep
                del known[ordered.pop()]
            known.chars += sum(map(len, ordered))
        held = len(known) * A_WORD + 2 * known.chars
        if held > REMEMBERED // 2:  # a single text may fill more than there is room for
            self.whole, known.earlier = _Counts(known if held <= REMEMBERED * 3 // 4 else {}), {}
        return out

    def let_go(self) -> None:
        """Drop the tables of long words and of what was learned after them, or all where there are too many; numbers given out before end here."""
        if len(self.seen) * A_WORD + 2 * self.entries.size > REMEMBERED:
            self._forget()
        elif self.late:
            first = min(self.seen[w] for w in self.late)
            at = int(self.starts.held[first])
            self.seen = {w: k for w, k in self.seen.items() if k < first}
            self.large = {k: v for k, v in self.large.items() if k < at}
            self.starts.size, self.sizes.size, self.entries.size, self.late = first, first, at, []

    def counts_of(self, numbers: np.ndarray) -> np.ndarray:
        """The numbers of tokens of words."""
        at = self.starts.held[numbers] + self.sizes.held[numbers] - 1
        return self._full(self.entries.held[at].astype(np.int64), at)

    def _full(self, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in np.flatnonzero(counts == 255).tolist() if self.large else []:
            counts[k] = self.large.get(int(at[k]), 255)
        return counts

    def prefix_table(self, numbers: np.ndarray) -> np.ndarray:
        """Counts at the ends of 1, 2, ... characters of the words, one after another, from the kept tables."""
        sizes = self.sizes.held[numbers]
        at = np.repeat(self.starts.held[numbers] - edges_of(sizes)[:-1], sizes) + np.arange(int(sizes.sum()))
        inside = self._full(self.entries.held[at].astype(np.int64), at)
        return inside + np.repeat(edges_of(self.counts_of(numbers))[:-1], sizes)

    def prefixes(self, text: str) -> np.ndarray:
        """Token counts of the text's prefixes of 0, 1, ... characters."""
        words = self.words(text)
        if not words:
            return np.zeros(1, np.int64)
        # The table starts with the space that the model puts in front: no prefix of the text has it alone.
        return np.concatenate((np.zeros(1, np.int64), self.prefix_table(self.numbers([words])[0])[1:]))

    def count(self, text: str) -> int:
        return int(self.counts_of(self.numbers([self.words(text)])[0]).sum())

    def fits(self, numbers: np.ndarray, budget: int) -> int:
        """Characters of the longest prefix of a text of at most budget tokens, all of whose own prefixes fit too."""
        if not len(numbers):
            return 0
        sizes = self.sizes.held[numbers]
        before = edges_of(self.counts_of(numbers))
        ends = edges_of(sizes)
        # A prefix that ends inside a word has at most 4 tokens a character more than the words before: most of the text is passed over.
        first = int(np.argmax(np.append(before[:-1] + 4 * sizes > budget, True)))
        over = np.flatnonzero(before[first] + self.prefix_table(numbers[first:]) > budget)
        return max(0, int(ends[first]) + int(over[0]) - 1) if len(over) else int(ends[-1]) - 1


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """The worker's counter of a model."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def count_tokens(df: DataFrame, path: str, text_col: str = "text", budget: int | None = None, prefixes: bool = False) -> DataFrame:
    """df without the text, with n_bytes (UTF-8) and n_tokens.

    budget: also `fits_chars`, the characters of the text that the budget holds. prefixes: also
    `prefix_tokens`, the counts at all prefixes, from the empty one on.
    """
    ship(df.sparkSession)
    df = making_room(df, ["n_bytes", "n_tokens", *["fits_chars"] * (budget is not None), *["prefix_tokens"] * prefixes], keep=(text_col,))
    kept = [f for f in df.schema.fields if f.name != text_col]
    added = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    added += [T.StructField("fits_chars", T.LongType())] * (budget is not None) + [T.StructField("prefix_tokens", T.ArrayType(T.LongType()))] * prefixes

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, tables = counter(path), budget is not None or prefixes
        for batch in batches:
            rest = batch.drop_columns([text_col])
            at = 0
            for texts in text_slices(batch.column(batch.schema.get_field_index(text_col))):
                numbers = own.numbers([own.words(t) for t in texts]) if tables else []
                n_tokens = [int(own.counts_of(x).sum()) for x in numbers] if tables else own.totals(texts)
                fits = [] if budget is None else [own.fits(x, budget) for x in numbers]
                columns = [*rest.slice(at, len(texts)).columns, pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64())]
                columns += [pa.array(fits, pa.int64())] * (budget is not None)
                if prefixes:
                    columns.append(pa.array([own.prefixes(t).tolist() for t in texts], pa.list_(pa.int64())))
                own.let_go()
                yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, *(f.name for f in added)])
                at += len(texts)
        give_back()

    return df.mapInArrow(kernel, T.StructType([*kept, *added]))
