"""Quality classifier, language model, license scan and the pipeline against held-out rows and brute force."""

import glob
import math
import random
import re
import time
from collections import Counter, defaultdict

import pytest

from siltstone.llm import kneser_ney, licenses, quality


@pytest.fixture(scope="module")
def judged(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice(["an", "the", "re", "of", "lo", "mi"]) for _ in range(rnd.randrange(1, 4)))
    rows = []
    for k in range(600):
        words = [word() for _ in range(rnd.randrange(20, 200))]
        good = k % 4 != 0
        rows.append((k, " ".join(words) if good else " ".join(w + rnd.choice(["&&&", "###", "$$$"]) for w in words), int(good)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_classifier_on_held_out_rows(judged, hard, nothing, spark):
    labels = judged.select("doc_id", "quality")
    model = quality.fit(judged.drop("quality"), labels.filter("doc_id % 5 != 0"))
    got = quality.score(judged, model).filter("doc_id % 5 = 0").collect()
    assert all((r.score >= 0.3) == bool(r.quality) for r in got)
    assert 0 < len(model.rules) < 200
    rows = quality.score(hard, model)
    assert rows.count() == hard.count() and rows.filter("score is null or score < 0 or score > 1").count() == 0
    assert rows.columns == ["doc_id", "text", "lang", "source", "n_chars", "labels", "ids", "score"]
    assert quality.score(nothing, model).count() == 0


def test_classifier_without_two_classes(judged, nothing):
    labels = judged.select("doc_id", "quality")
    one = quality.fit(judged, labels.filter("quality = 1"))
    assert not one.rules and quality.score(judged, one).filter("score < 0.9").count() == 0
    none = quality.fit(nothing, labels.limit(0))
    assert not none.rules and abs(none.bias) < 1e-12


def brute_scores(rows, held):
    tok = lambda t: [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", bytes((t or "").encode()).translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))] + [None]
    texts = [(r, tok(r.text)) for r in rows]
    uni, bi = Counter(), Counter()
    for r, t in texts:
        if not held(r):
            uni.update(t)
            bi.update(zip([0, *t[:-1]], t, strict=True))
    n, v = sum(uni.values()), len(uni)

    def discounts(counts):
        c = Counter(counts)
        if min(c[1], c[2], c[3], c[4]) == 0:
            return [0, 0.5, 1.0, 1.5]
        y = c[1] / (c[1] + 2 * c[2])
        return [0, *(max(0, k - (k + 1) * y * c[k + 1] / c[k]) for k in (1, 2, 3))]

    after = Counter(b for _, b in bi)
    d, dw = discounts(bi.values()), discounts(after.values())
    follow, total = defaultdict(Counter), Counter()
    for (a, _), c in bi.items():
        follow[a][min(c, 3)] += 1
        total[a] += c
    rest = sum(dw[min(c, 3)] for c in after.values()) / len(bi) if bi else 1.0

    def p(a, b):
        one = max(after[b] - dw[min(after[b], 3)], 0) / max(1, len(bi)) + rest / (v + 1)
        if not total[a]:
            return one
        return max(bi[a, b] - d[min(bi[a, b], 3)], 0) / total[a] + sum(d[k] * c for k, c in follow[a].items()) / total[a] * one

    for r, t in texts:
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        yield r.doc_id, len(t), sum(uni[w] > 0 for w in t), base, sum(math.log10(p(a, b)) for a, b in zip([0, *t[:-1]], t, strict=True))


def close(a, b):
    return a[:3] == b[:3] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[3:], b[3:], strict=True))


def test_language_model_equals_brute_force(unique, nothing):
    held = lambda r: r.doc_id % 3 == 0
    model = kneser_ney.train(unique.filter("doc_id % 3 != 0"))
    got = {r.doc_id: (r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in kneser_ney.score(unique, model).collect()}
    for want in brute_scores(unique.collect(), held):
        assert close(got[want[0]], want), want
    assert kneser_ney.score(nothing, model).count() == 0


def brute_model(texts, order):
    """p(words before, word) by the recursive definition; texts are lists of words that end in None, 0 is the start."""
    counts = [Counter() for _ in range(order)]
    for t in texts:
        padded = [0, *t]
        for k in range(1, order + 1):
            counts[k - 1].update(tuple(padded[i - k + 1 : i + 1]) for i in range(max(1, k - 1), len(padded)))
    total, v = sum(counts[0].values()), len(counts[0])
    for k in range(order - 1, 0, -1):
        before = Counter(g[1:] for g in counts[k])
        counts[k - 1] = Counter({g: c if g[0] == 0 else before[g] for g, c in counts[k - 1].items()})

    def discounts(c):
        c = Counter(c)
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0
        return [0, *(max(0, k - (k + 1) * y * c[k + 1] / c[k]) for k in (1, 2, 3))] if min(c[1], c[2], c[3], c[4]) else [0, 0.5, 1.0, 1.5]

    d = [discounts(c.values()) for c in counts]
    follow = [defaultdict(list) for _ in counts]
    for table, c in zip(follow, counts, strict=True):
        for g, n in c.items():
            table[g[:-1]].append(n)

    def p(before, w):
        k = len(before)
        lower = 1 / (v + 1) if not k else p(before[1:], w)
        found = follow[k].get(before)
        if not found:
            return lower
        n = counts[k][(*before, w)]
        return max(n - d[k][min(n, 3)], 0) / sum(found) + sum(d[k][min(x, 3)] for x in found) / sum(found) * lower

    return p, total


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_of_any_order_equals_brute_force(spark, order):
    rnd = random.Random(order)
    word = lambda: rnd.choice("a a a b b c d e f g".split() + ["x" + str(rnd.randrange(30))])
    rows = [(k, " ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 10, 40])))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    model = kneser_ney.train(docs.filter("doc_id % 4 > 0"), order=order)
    p, total = brute_model([[*t.split(), None] for k, t in rows if k % 4], order)
    assert model.train == total
    for r in kneser_ney.score(docs.withColumnRenamed("text", "t").selectExpr("doc_id", "t as text", "t"), model).collect():
        t = [0, *r.t.split(), None]
        want = sum(math.log10(p(tuple(t[max(0, i - order + 1) : i]), t[i])) for i in range(1, len(t)))
        assert math.isclose(r.score, want, rel_tol=1e-9), r


def test_counts_beyond_a_byte_and_many_shards(spark, monkeypatch):
    """Counts of 255 and more, and more shards than shuffle partitions, change nothing."""
    monkeypatch.setattr(kneser_ney, "SHARD_BYTES", 1000)
    rnd = random.Random(2)
    rows = [(k, " ".join(rnd.choice("the the the of of a b c d".split()) for _ in range(rnd.randrange(0, 60)))) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = kneser_ney.train(docs, order=3)
    assert model.shards > 20
    p, total = brute_model([[*t.split(), None] for _, t in rows], 3)
    assert model.train == total
    texts = dict(rows)
    for r in kneser_ney.score(docs.filter("doc_id % 9 = 0"), model).collect():
        t = [0, *texts[r.doc_id].split(), None]
        assert math.isclose(r.score, sum(math.log10(p(tuple(t[max(0, i - 2) : i]), t[i])) for i in range(1, len(t))), rel_tol=1e-9)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_language_model_in_passes(spark, monkeypatch, order):
    """Each pass counts its own shards' part of the text, takes a part of the disk, and the model is the same."""
    rnd = random.Random(order)
    words = "a a a b b c d e f g".split() + [f"x{k}" for k in range(200)]
    docs = spark.createDataFrame([(k, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 2, 40, 300])))) for k in range(600)], "doc_id long, text string").repartition(4)
    names, files, real = [], [], kneser_ney.written

    def measured(df, name):
        held, out = shuffle_files(spark), real(df, name)
        names.append(name)
        for _ in range(50):  # Spark deletes them beside the next job
            if not (left := shuffle_files(spark) - held):
                break
            time.sleep(0.2)
        files.extend(left)
        return out

    monkeypatch.setattr(kneser_ney, "written", measured)
    whole = kneser_ney.train(docs, order=order)
    monkeypatch.setattr(kneser_ney, "PASS_BYTES", 10_000)
    parts = kneser_ney.train(docs, order=order)
    assert sum(name.startswith("lm-blocks-") and name[10:].isdigit() for name in names) == 1 + kneser_ney.PASSES
    assert parts.shards % kneser_ney.PASSES == 0
    assert (whole.words, whole.train, whole.pairs, whole.discounts, whole.word_discounts) == (parts.words, parts.train, parts.pairs, parts.discounts, parts.word_discounts)
    score = lambda model: {r.doc_id: (r.n_known, r.base_score, r.score) for r in kneser_ney.score(docs, model).collect()}
    got, want = score(parts), score(whole)
    assert all(g[0] == w[0] and math.isclose(g[2], w[2], rel_tol=1e-9) for g, w in ((got[k], want[k]) for k in want)) and len(got) == 600
    # A pass's shuffle files are gone when it has ended.
    assert not files


def shuffle_files(spark):
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0]
    return set(glob.glob(f"{local}/**/shuffle_*.data", recursive=True))


def test_language_model_query_knows_two_words_of_context(spark, tmp_path):
    from siltstone.llm import queries

    rows = [(k, t) for k, t in enumerate(["a b c", "d b e"] * 200)] + [(1000, "a b c"), (1001, "a b e")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in queries.op8_lm_scoring(spark, str(tmp_path)).collect()}
    assert got[1000] > got[1001] + 1


def test_language_model_without_training_text(nothing, hard):
    got = kneser_ney.score(hard, kneser_ney.train(nothing))
    assert got.count() == hard.count() and got.filter("abs(score) > 1e-9 or abs(base_score) > 1e-9 or n_known != 0").count() == 0


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = [(k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in found]
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in found}))


def test_license_scan(spark, hard, nothing):
    got = licenses.scan(hard).collect()
    want = Counter((r.doc_id, *brute_base(r.text)) for r in hard.collect())
    assert want == Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got)
    assert licenses.scan(nothing).count() == 0
    cases = [
        ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"), ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
        ("x y Licensed under CC BY-NC 4.0. z", "cc-by,cc-by-nc"), ("The license of the public bus.", ""), ("cc then by", ""), (None, ""),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "mit"),
    ]
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id long, text string")).collect()
    assert [r.labels for r in sorted(rows, key=lambda r: r.doc_id)] == [label for _, label in cases]
    assert all(0 <= r.score <= 1 for r in rows)
    assert set(licenses.scan(hard).columns) >= {"doc_id", "lang", "labels", "score"}


def brute_licenses(rows, notices=licenses.NOTICES):
    """(doc_id, labels of verified alignments, best share) by trying every alignment of every template."""
    low = lambda t: re.findall(licenses.WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    texts, known = [(r.doc_id, low(r.text)) for r in rows], licenses.templates(notices)
    idf = {w: math.log((len(texts) + 1) / (sum(w in t for _, t in texts) + 0.5)) for k in known for w in k.words}
    for i, words in texts:
        found, best = set(), 0.0
        for k in known:
            rare = sorted(dict.fromkeys(k.words), key=lambda w, k=k: (-idf[w], k.words.index(w)))[: licenses.INDEXED]
            whole = sum(idf[w] for w in rare[: licenses.ANCHORS])
            anchors = [w for w in rare if w in words][: licenses.ANCHORS]
            for at in range(-len(k.words), len(words)):
                share = sum(idf[w] / whole for p, w in enumerate(k.words) if w in anchors and 0 <= at + p < len(words) and words[at + p] == w)
                first = at + k.key_at
                if share >= licenses.SHARE - 1e-9 and first >= 0 and tuple(words[first : first + len(k.key)]) == k.key:
                    found.add(k.label)
                    best = max(best, share)
        yield i, ",".join(sorted(found)), min(1.0, best)


def test_license_alignments_equal_brute_force(spark):
    rnd = random.Random(8)
    filler = "the of and to a in software use copy any this work public version terms is".split()
    rows = [(0, None), (1, "")]
    for k in range(2, 120):
        words = [rnd.choice(filler) for _ in range(rnd.randrange(0, 30))]
        for _, notice, _ in rnd.sample(licenses.NOTICES, rnd.randrange(0, 3)):
            some = notice.split()
            for _ in range(rnd.randrange(0, 4)):
                some[rnd.randrange(len(some))] = rnd.choice(["other", "the", "software"])
            words += some + [rnd.choice(filler) for _ in range(rnd.randrange(0, 9))]
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = {r.doc_id: set(filter(None, r.base_labels.split(","))) for r in licenses.scan(docs).collect()}
    got = {r.doc_id: (r.labels, r.score, r.best) for r in licenses.scan(docs).collect()}
    for i, labels, best in brute_licenses(docs.collect()):
        assert got[i][0] == ",".join(sorted(base[i] | set(filter(None, labels.split(","))))), i
        assert math.isclose(got[i][1], best, abs_tol=1e-8) and (got[i][2] is None) == (best == 0), i


def test_pipeline_stages(spark, judged, hard, tmp_path):
    import corpus_pipeline

    docs = judged.drop("quality").selectExpr("*", "'en' as lang", "'s' as source", "length(text) as n_chars").unionByName(hard.filter("doc_id is not null").drop("score", "labels", "ids").selectExpr("doc_id + 10000 as doc_id", "text", "lang", "source", "n_chars"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    judged.selectExpr("doc_id", "quality", "0 as toxic").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, rows, str(tmp_path))
        assert kept.columns == rows.columns, name
        kept.write.parquet(f"{tmp_path}/{name}")
        before, rows = rows, spark.read.parquet(f"{tmp_path}/{name}")
        assert rows.count() < before.count()
    assert rows.filter("text like '%&&&%'").count() == 0
    assert rows.count() == rows.selectExpr("coalesce(text, '') as t").distinct().count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == rows.count()
