"""The registered opN_ queries over a small folder, against plain Python and the public libraries."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import packing, quality, queries

public_tokenizers = pytest.importorskip("public_tokenizers")


def prose(rnd, words):
    out = ["".join(rnd.choice("an the re tion of ba lo mi est und que la".split()) for _ in range(rnd.randrange(1, 4))) for _ in range(words)]
    return " ".join(w.capitalize() + "." if k % 11 == 10 else w for k, w in enumerate(out))


def held(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """documents and labels: texts of both qualities, copies, near copies, nulls, odd characters, a long one."""
    rnd = random.Random(21)
    rows = []
    for k in range(260):
        words = prose(rnd, rnd.randrange(0, 120)).split()
        rows.append((k, " ".join(words) if k % 4 else " ".join(w + rnd.choice(["&&&", "###", "$$$"]) for w in words)))
    base = rows[7][1].split() + prose(rnd, 80).split()
    rows += [(300, " ".join(base)), (301, " ".join(["other", *base[1:]])), (302, " ".join(base)), (303, None), (304, ""), (305, "漢字 é🙂  \n\n def f(x):\n    return  x"), (306, prose(rnd, 6000))]
    path = tmp_path_factory.mktemp("tables")
    docs = spark.createDataFrame([(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i, _ in rows if i < 260 and i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), dict(rows)


def of(spark, folder, query):
    return {r.doc_id: r for r in query(spark, folder[0]).collect()}


def test_op1(spark, folder):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = of(spark, folder, queries.op1_byte_bpe)
    for i, t in folder[1].items():
        ids = np.array(library.encode_ordinary(t or ""), "<u4")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())


def test_op2_and_op3(spark, folder):
    model = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    counts = {i: len(model.encode(t or "")) for i, t in folder[1].items()}
    got = of(spark, folder, queries.op2_token_counts)
    assert {i: (r.n_bytes, r.n_tokens, r.over_limit) for i, r in got.items()} == {i: (len((t or "").encode()), counts[i], counts[i] > 4096) for i, t in folder[1].items()}
    assert got[306].over_limit and len(model.encode(folder[1][306][: got[306].fits_chars])) <= 4096 < len(model.encode(folder[1][306][: got[306].fits_chars + 1]))
    packed = of(spark, folder, queries.op3_packing)
    assert {i: r.length for i, r in packed.items()} == {i: n + 1 for i, n in counts.items()}
    longest, batches = defaultdict(int), Counter()
    for r in packed.values():
        longest[r.bucket] = max(longest[r.bucket], r.length)
        batches[r.batch] += r.padded_length
    assert all(r.padded_length == longest[r.bucket] for r in packed.values()) and max(batches.values()) <= packing.BUDGET


def python_statistics(text):
    """The classifier's ten statistics by their definitions."""
    t = text or ""
    rx = pytest.importorskip("regex")
    words, lines = rx.split(r"[ \t\n\x0b\f\r]+", t), t.split("\n")
    count = lambda p: len(rx.findall(p, t))
    share = lambda a, b: a / b if b else 0.0
    function = rf"(?i)(?<![\p{{L}}])(?:{'|'.join(quality.FUNCTION_WORDS)})(?![\p{{L}}])"
    return {
        "log_chars": math.log1p(len(t)), "upper": share(count(r"\p{Lu}"), len(t)), "digits": share(count(r"\p{Nd}"), len(t)), "symbols": share(count(r"[^\p{L}\p{N}\s.,;:'\"?()-]"), len(t)),
        "stops": share(count(r"[.,;:?]"), len(t)), "word_chars": share(len(t), len(words)), "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines)),
        "line_words": share(len(words), len(lines)), "function_words": share(count(function), len(words)),
    }


def test_op5(spark, folder):
    """Statistics, rules and scores worked out again in Python, and the held-out rows told apart."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = queries.quality_model(spark, folder[0], docs)
    measured, at = quality.with_statistics(docs, "text")
    for r in measured.collect():
        want = python_statistics(folder[1][r.doc_id])
        for k, v in want.items():
            assert math.isclose(r[at[k]], v, rel_tol=1e-9, abs_tol=1e-12), (r.doc_id, k)
    got = of(spark, folder, queries.op5_quality)
    assert set(got) == set(folder[1]) and model.rules
    for i, t in folder[1].items():
        s = python_statistics(t)
        z = model.bias + sum(r.weight for r in model.rules if all((s[k] > x) == above for k, x, above in r.parts))
        assert math.isclose(got[i].score, 1 / (1 + math.exp(-z)), rel_tol=1e-9) and got[i].predicted == int(got[i].score >= 0.3) and got[i].held_out == held(i, 5)
    unseen = [i for i in got if i < 260 and i % 3 and held(i, 5) and len(folder[1][i]) > 100]
    assert sum(got[i].predicted == int(i % 4 != 0) for i in unseen) >= 0.9 * len(unseen)


def test_op5_never_learns_from_held_out_labels(spark, folder, tmp_path):
    """Turning the held-out labels round changes nothing."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet")
    labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - quality, quality) as quality", "toxic").write.parquet(f"{tmp_path}/labels.parquet")
    assert queries.quality_model(spark, str(tmp_path), docs) == queries.quality_model(spark, folder[0], docs)


def test_op8(spark, folder):
    got = of(spark, folder, queries.op8_lm_scoring)
    tokens = {i: [w for w in re.split("[ \t\n\x0b\f\r]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if w] + [None] for i, t in folder[1].items()}
    counts = Counter(w for i, ws in tokens.items() if not held(i, 10) for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held(i, 10), len(ws), sum(w in counts for w in ws), n) and math.isclose(got[i].base_score, base, rel_tol=1e-9)


def test_op9(spark, folder):
    got = of(spark, folder, queries.op9_sharding)
    assert {i: (r.size, r.text_crc32, r.law, r.grown_shard) for i, r in got.items()} == {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "rows", None) for i, t in folder[1].items()}
    slots = defaultdict(list)
    for r in got.values():
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_op10_equals_its_sql(spark, folder):
    import duckdb

    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder[0]}/documents.parquet/*.parquet'")
    sql = queries.oracle_sql()["op10_exact_dedup"]
    got = queries.op10_exact_dedup(spark, folder[0])
    want = db.sql(sql)
    order = sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_pipeline(rows, model):
    """What each stage keeps of rows (doc_id, text, ...), by definition: multisets of (doc_id, text)."""
    def score(t):
        s = python_statistics(t)
        return 1 / (1 + math.exp(-model.bias - sum(r.weight for r in model.rules if all((s[k] > x) == above for k, x, above in r.parts))))

    good = [r for r in rows if score(r[1]) >= queries.GOOD]
    groups = defaultdict(list)
    for r in good:
        groups[r[1] or ""].append(r)
    single = [max(g, key=lambda r: -1 if r[0] is None else r[0]) for g in groups.values()]
    sets, classes = [shingles(r[1]) for r in single], list(range(len(single)))

    def find(x):
        while classes[x] != x:
            x = classes[x]
        return x

    for a in range(len(single)):
        for b in range(a):
            if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
                p, q = find(a), find(b)
                classes[max(p, q)] = min(p, q)
    near = defaultdict(list)
    for k, r in enumerate(single):
        near[find(k)].append(r)
    return good, groups, list(near.values())


def test_pipeline_equals_brute_force(spark, folder, hard, tmp_path):
    """All four stages on rows with null and repeated ids, one id with two texts, repeated rows, null and empty texts."""
    import corpus_pipeline

    fields = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    odd = [(301, "quite another text of the same id as a near copy has it"), (301, folder[1][301]), (None, "no id here at all"), (None, "no id here at all"), (None, folder[1][300]), (7, folder[1][300].replace("other", "Other"))]
    docs = docs.unionByName(spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)).unionByName(hard.select(*fields).filter("length(text) < 20000 or text is null"))
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.read.parquet(f"{folder[0]}/labels.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = queries.quality_model(spark, str(tmp_path), docs)
    good, groups, near = brute_pipeline(rows, model)
    kept, now = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == fields
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [(r.doc_id, r.text) for r in now.collect()]
    assert Counter(kept["quality"]) == Counter(good)
    assert Counter(t or "" for _, t in kept["exact_dedup"]) == Counter(dict.fromkeys(groups, 1))
    assert all((i, t) in groups[t or ""] and i == max((x for x, _ in groups[t or ""] if x is not None), default=None) for i, t in kept["exact_dedup"])
    of_text = {t or "": k for k, rs in enumerate(near) for _, t in rs}
    assert Counter(of_text[t or ""] for _, t in kept["near_dedup"]) == Counter(range(len(near)))
    least = lambda rs: min(rs, key=lambda r: (r[0] is None, r[0] or 0))[0]
    assert all(i == least(near[of_text[t or ""]]) for i, t in kept["near_dedup"])
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed) == Counter(i for i, _ in kept["near_dedup"])


def test_pipeline_of_an_empty_table(spark, folder, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
