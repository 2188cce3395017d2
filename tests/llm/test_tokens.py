"""Byte-level BPE and token counts against the public libraries."""

import base64
import hashlib
import random
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
sentencepiece = pytest.importorskip("sentencepiece")

from siltstone.llm import bpe, kernels, token_counts  # noqa: E402

RANKS, PIECES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def odd_texts(n, seed):
    rnd = random.Random(seed)
    bits = ["a", "b", " ", "\n", "\t", "\xa0", ".", "é", "漢", "🙂", "1", "'s", "$", "the", "er", "  ", "▁", "<s>", "\r", ","]
    return ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40))) for _ in range(n)]


def test_encode_equals_the_library(library):
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    texts = [*odd_texts(3000, 1), "", "z" * 900, "ab" * 500 + " " * 300 + "x", "a \n b", "<|endoftext|>\x00"]
    flat, counts = codec.encode(texts)
    edges = np.concatenate(([0], np.cumsum(counts)))
    for t, a, b in zip(texts, edges[:-1], edges[1:], strict=True):
        assert flat[a:b].tolist() == library.encode_ordinary(t), t
        assert codec.decode(flat[a:b]) == t.encode()


ODD_SHAPES = [
    "def f(x):\n    if x:\n        return  x  # two\n\n\n    return  [x,\t x ]\n" * 40, "漢字かな交じり文" * 300, "語" * 700 + " " + "word " * 50, "x" * 3000 + " y " * 10, " ".join(["of the"] * 400),
    "z" * 70 + " " + "q" * 300 + "\n  " + "é" * 90,
]


def test_indented_code_and_texts_without_spaces(library, pieces):
    codec, own = bpe.Codec(RANKS, public_tokenizers.PATTERN), token_counts.PrefixCounter(PIECES)
    for _ in range(2):
        flat, counts = codec.encode(ODD_SHAPES)
        edges = np.concatenate(([0], np.cumsum(counts)))
        for t, a, b in zip(ODD_SHAPES, edges[:-1], edges[1:], strict=True):
            assert flat[a:b].tolist() == library.encode_ordinary(t)
        for t in ODD_SHAPES:
            assert own.count(t) == len(pieces.encode(t))
        own.let_go()
        # What stays in a worker's memory is short.
        assert max(map(len, {**codec.seen, **codec.seen_pieces})) <= bpe.KEPT and max(map(len, own.seen)) <= token_counts.KEPT
        assert codec.lengths_of.size == len(codec.seen) + len(codec.seen_pieces) and own.sizes.size == len(own.seen)


def test_long_words_have_whole_tables(pieces):
    own = token_counts.PrefixCounter(PIECES)
    t = "ab" * 200 + " " + "é漢" * 150 + " the"
    assert own.prefixes(t).tolist() == [len(pieces.encode(t[:k])) for k in range(len(t) + 1)]


def test_a_full_pair_memory_starts_anew(pieces, monkeypatch):
    monkeypatch.setattr(token_counts, "PAIRS", 20)
    own = token_counts.PrefixCounter(PIECES)
    for t in odd_texts(80, 9):
        assert own.count(t) == len(pieces.encode(t))


def test_a_worker_keeps_words_and_pairs_within_bytes(pieces):
    """What stays between slices is bounded in bytes, not in words, and pairs are held once."""
    own, rnd = token_counts.PrefixCounter(PIECES), random.Random(5)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(12)) for _ in range(320_000)]
    for k in range(0, len(words), 40_000):
        own.numbers([own.words(" ".join(words[k : k + 40_000]))])
        own.let_go()
    assert sum(map(sys.getsizeof, own.seen)) + sys.getsizeof(own.seen) + own.entries.room.nbytes + own.starts.room.nbytes + own.sizes.room.nbytes < 48 << 20
    assert not own.follows
    assert own.count(words[0]) == len(pieces.encode(words[0]))


def test_texts_become_strings_a_slice_at_a_time():
    texts = ["é" * 700, None, "", "x" * 5000, *["word " * 20] * 300]
    column = pa.array(["skipped", *texts]).slice(1)
    got = list(kernels.text_slices(column, 2000))
    assert [t for part in got for t in part] == [t or "" for t in texts]
    assert all(len(part) == 1 or sum(len(t.encode()) for t in part) <= 2000 for part in got)
    assert list(kernels.text_slices(pa.array([], pa.string()))) == []


def test_a_full_memory_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    for t in odd_texts(60, 2):
        assert codec.encode([t])[0].tolist() == library.encode_ordinary(t)


def test_op1_on_hard_rows(hard, nothing, library):
    got = bpe.encode(hard, RANKS, public_tokenizers.PATTERN, decoded=True)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "score", "labels", "ids", "decoded"]  # the clashing ids made room
    want = Counter((r.doc_id, tuple(library.encode_ordinary(r.text or "")), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in hard.collect())
    assert want == Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist()), hashlib.sha256(bytes(r.decoded)).hexdigest()) for r in got.collect())
    again = bpe.decode(got.drop("decoded"), RANKS, public_tokenizers.PATTERN)
    assert Counter(bytes(r.decoded) for r in again.collect()) == Counter((r.text or "").encode() for r in hard.collect())
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_prefix_counts_equal_the_library(pieces):
    own = token_counts.PrefixCounter(PIECES)
    for t in odd_texts(400, 3):
        assert own.prefixes(t).tolist() == [len(pieces.encode(t[:k])) for k in range(len(t) + 1)], t
        assert own.count(t) == len(pieces.encode(t))


def test_budgets_without_encoding_again():
    own = token_counts.PrefixCounter(PIECES)
    for t in [*odd_texts(200, 4), "the end of it all " * 30]:
        table = own.prefixes(t)
        for budget in (0, 1, 3, 17, 10_000):
            k = own.fits(own.numbers([own.words(t)])[0], budget)
            assert table[: k + 1].max() <= budget
            assert k == len(t) or table[k + 1] > budget


def test_op2_on_hard_rows(hard, nothing, pieces):
    got = token_counts.count_tokens(hard, PIECES, budget=64, prefixes=True).collect()
    want = Counter((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in hard.collect())
    assert want == Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got)
    assert all(r.prefix_tokens[-1] == r.n_tokens and r.prefix_tokens[r.fits_chars] <= 64 for r in got)
    assert token_counts.count_tokens(nothing, PIECES).count() == 0


def test_totals_equal_the_library(pieces, monkeypatch):
    texts = [*odd_texts(600, 11), *ODD_SHAPES, "", " ", "  a", "a ", "▁a", "a  b ", "<s> </s>", "x" * 62 + " " + "y" * 63 + " " + "z" * 64]
    want = [len(pieces.encode(t)) for t in texts]
    own = token_counts.PrefixCounter(PIECES)
    assert own.totals(texts) == want and own.totals(texts) == want and own.totals([]) == []
    assert not own.seen and not own.entries.size  # no tables where only totals are asked for
    assert max(map(len, own.whole)) < token_counts.KEPT and not own.whole.new
    assert [own.count(t) for t in texts] == want and not own.whole  # one kind of memory at a time
    for most in (2000, 40_000):
        monkeypatch.setattr(token_counts, "REMEMBERED", most)
        own = token_counts.PrefixCounter(PIECES)
        assert [n for k in range(0, len(texts), 5) for n in own.totals(texts[k : k + 5])] == want


def test_words_of_totals_are_kept_within_bytes(pieces):
    own, rnd = token_counts.PrefixCounter(PIECES), random.Random(5)
    words = ["".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(12)) for _ in range(320_000)]
    for k in range(0, len(words), 20_000):
        own.totals([" ".join(["often", *words[k : k + 20_000]])])
        kept = own.whole, own.whole.earlier
        assert sum(sum(map(sys.getsizeof, d)) + sys.getsizeof(d) for d in kept) < 48 << 20
        assert "often" in own.whole or "often" in own.whole.earlier  # a full memory keeps what was met lately
    assert own.totals([words[0], words[-1]]) == [len(pieces.encode(w)) for w in (words[0], words[-1])]


def test_new_words_are_looked_through_once(pieces, monkeypatch):
    """A start is followed as far as some piece begins so, not to the longest piece's length, and no place beyond a word's end is looked at."""
    own, rnd = token_counts.PrefixCounter(PIECES), random.Random(6)
    asked = []
    get = kernels.HashMap.get
    monkeypatch.setattr(kernels.HashMap, "get", lambda self, keys: (asked.append(keys.size if self is own.by_hash else 0), get(self, keys))[1])
    words = [" " + "".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(rnd.randrange(6, 24))) for _ in range(4000)]
    assert [int(own.counts_of(x).sum()) for x in own.numbers([[w] for w in words])] == [len(pieces.encode(w[1:])) for w in words]
    assert sum(asked) < 6 * sum(map(len, words))


def test_pairs_are_encoded_as_the_library_does(pieces):
    own, rnd = token_counts.PrefixCounter(PIECES), random.Random(7)
    usual = [k for k in own.ids.values() if not own.pieces[k].startswith(" ")]
    for _ in range(20_000):
        a, b = rnd.choice(usual), rnd.choice(usual)
        left, right = own.pieces[a], own.pieces[b]
        symbols = [*left, *right]
        while found := [(-own.scores[x], k) for k in range(len(symbols) - 1) if (x := symbols[k] + symbols[k + 1]) in own.scores]:
            k = min(found)[1]
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        assert own._pair(a, b) == (symbols == [left, right]), (left, right)


def test_lengths_for_packing_on_hard_rows(hard, pieces):
    got = token_counts.count_tokens(hard, PIECES).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == Counter((r.doc_id, len((r.text or "").encode()), len(pieces.encode(r.text or ""))) for r in hard.collect())
