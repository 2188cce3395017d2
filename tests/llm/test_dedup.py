"""Exact dedup, sharding, packing, near join and fingerprints against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siltstone.llm import exact_dedup, fingerprints, kernels, near_join, packing, sharding
from siltstone.llm.components import components


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(hard, nothing, keep):
    rows = hard.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    got = exact_dedup.exact_groups(hard, keep=keep).collect()
    assert len(got) == len(rows)
    by = {hashlib.sha256(t.encode()).hexdigest(): t for t in groups}
    assert all(r.keep_id == best[by[r.text_sha256]] and r.group_size == len(groups[by[r.text_sha256]]) for r in got)
    assert Counter(by[r.text_sha256] for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.exact_groups(nothing).count() == 0
    left = exact_dedup.exact_distinct(hard, keep=keep)
    assert left.columns == hard.columns
    assert Counter((r.text or "") for r in left.collect()) == Counter(dict.fromkeys(groups, 1))


def test_hot_texts_are_split_and_put_together(spark):
    rows = [(k, "the same text" if k % 3 else f"text {k}") for k in range(6000)]
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest")
    hot = got.filter("group_size > 1").agg({"keep_id": "max", "group_size": "min", "kept": "count"}).first()
    assert (hot["max(keep_id)"], hot["min(group_size)"], hot["count(kept)"]) == (5999, 4000, 4000)
    assert got.filter("kept").count() == 2001
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in exact_dedup.exact_distinct(docs, keep="largest").collect()}
    assert kept == {5999} | set(range(0, 6000, 3))


def test_shards_hold_equal_counts(hard, nothing, spark):
    got = sharding.shard_rows(hard).collect()
    n = hard.count()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in hard.collect())
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1 and sum(counts.values()) == n
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    assert sharding.shard_rows(nothing).count() == 0
    copies = spark.createDataFrame([(k, "hot" if k < 900 else f"t{k}") for k in range(2000)], "doc_id long, text string")
    counts = Counter(r.shard for r in sharding.shard_rows(copies).collect())
    assert set(counts.values()) == {125}


def test_slack_keeps_most_rows_in_place_when_a_shard_is_added():
    counts = {(u, 0): 3 for u in range(0, sharding.PLACES, 7)}
    where = lambda shards: {(u, c, k): s for u, c, a, b, s, _ in sharding.place(counts, shards, slack=0.25) for k in range(a, b)}
    before, after = where(16), where(17)
    assert before.keys() == after.keys()
    load = Counter(before.values())
    assert max(load.values()) <= 1.25 * len(before) / 16 + 1
    assert sum(before[k] != after[k] for k in before) < 0.35 * len(before)


def test_equal_texts_share_a_shard_but_at_its_end(spark):
    rows = [(k, f"text {k % 700}") for k in range(2100)]
    shards = defaultdict(set)
    for r in sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        shards[r.text_crc32].add(r.shard)
    assert len(shards) == 700 and sum(len(s) == 1 for s in shards.values()) >= 0.85 * 700


def test_grid_costs_at_most_its_step(spark):
    from pyspark.sql import functions as F

    rnd = np.random.default_rng(5)
    for low, high in ((1, 60_000), (513, 700), (4000, 4100)):
        sizes = rnd.integers(low, high, 400)
        exact = packing.best_boundaries(*np.unique(sizes, return_counts=True), 4)
        least = sum(exact[np.searchsorted(exact, n)] for n in sizes)
        rows = packing.pack(spark.createDataFrame([(k, int(n)) for k, n in enumerate(sizes)], "doc_id long, size long"), F.col("size"), buckets=4)
        assert least <= rows.agg(F.sum("padded_length")).first()[0] <= least * (1 + 1 / packing.STEPS)


def test_best_boundaries_are_optimal():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        m, k = int(rnd.integers(1, 9)), int(rnd.integers(1, 5))
        lengths = np.sort(rnd.choice(40, m, replace=False) + 1)
        counts = rnd.integers(1, 9, m)
        cost = lambda bounds, lengths=lengths, counts=counts: sum(int(c) * min(b for b in bounds if b >= n) for n, c in zip(lengths, counts, strict=True))
        best = min(cost([lengths[j] for j in range(m) if mask >> j & 1] + [lengths[-1]]) for mask in range(1 << m) if bin(mask | 1 << (m - 1)).count("1") <= k)
        assert cost(packing.best_boundaries(lengths, counts, k)) == best


def test_packing_keeps_every_row_within_the_budget(hard, nothing):
    from pyspark.sql import functions as F

    got = packing.pack(hard, F.length("text"), buckets=4, budget=2000).collect()
    assert Counter((r.doc_id, r.length) for r in got) == Counter((r.doc_id, len(r.text or "")) for r in hard.collect())
    assert all(r.length <= r.padded_length for r in got)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch].append(r)
    for rows in batches.values():
        assert len({r.bucket for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(len(rows)))
        assert len(rows) == 1 or len(rows) * rows[0].padded_length <= 2000
    assert len({r.padded_length for r in got}) <= 4
    assert packing.pack(nothing, F.length("text")).count() == 0


def test_grid_never_shortens(spark):
    from pyspark.sql import functions as F

    rows = spark.range(0, 200_000, 37).withColumn("cell", packing.grid(F.col("id")))
    assert rows.filter("cell < id or cell > id * 1.02 + 1").count() == 0


def shingles(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or "")).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows, threshold=0.8):
    sets = {r.doc_id: shingles(r.text) for r in rows}
    root, links = {i: i for i in sets}, Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= threshold * len(x | y) > 0:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (find(i), links[i]) for i in ids}


def brute_rows(texts, threshold=0.8):
    """(class, links) of each row: rows are told apart by their places, not by ids."""
    sets = [shingles(t) for t in texts]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            if x == sets[b] or len(x & sets[b]) >= threshold * len(x | sets[b]) > 0:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return [(find(k), links[k]) for k in range(len(sets))]


def classes_of(rows):
    """Rows by class."""
    out = defaultdict(list)
    for r, (c, _) in zip(rows, brute_rows([r.text for r in rows]), strict=True):
        out[c].append(r)
    return [*out.values()]


@pytest.mark.parametrize("options", [{}, {"small": 2, "block": 3, "filter_bytes": 0}])
def test_near_classes_equal_brute_force(unique, nothing, options):
    want = brute(unique.collect())
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_join.near_classes(unique, **options).collect()}
    assert got == want
    if not options:
        assert near_join.near_classes(nothing).count() == 0
        assert near_join.near_distinct(nothing).count() == 0


def test_near_rows_with_null_and_repeated_ids(spark, hard):
    rows = [(3, "totally different words here now ok"), (1, "a b c d e f g"), (1, "a b c d e f g"), (3, "A b c d e f g"), (None, "x y z"), (None, "x y z"), (2, "x y z"), (5, None), (5, ""), (5, "a b c d e f g"), (None, "alone"), (7, "q r"), (7, "Q r")]
    odd = hard.select("*").limit(0).unionByName(spark.createDataFrame([(k, t, "en", "s", 1, 0.5, "m", "i") for k, t in rows], hard.schema)).unionByName(hard)
    found = odd.collect()
    links = Counter((r.doc_id, n) for r, (_, n) in zip(found, brute_rows([r.text for r in found]), strict=True))
    assert Counter((r.doc_id, r.n_links) for r in near_join.near_classes(odd).collect()) == links
    left = near_join.near_distinct(odd)
    assert left.columns == odd.columns
    kept = left.collect()
    one_each = lambda rs: {min((r.doc_id is None, r.doc_id or 0) for r in rs)}
    classes = classes_of(found)
    where = {shingles(r.text): k for k, rs in enumerate(classes) for r in rs}
    assert Counter(where[shingles(r.text)] for r in kept) == Counter(range(len(classes)))
    assert all({(r.doc_id is None, r.doc_id or 0)} == one_each(classes[where[shingles(r.text)]]) and r in found for r in kept)


def test_wanted_ids_filter_and_join_agree(spark):
    docs = spark.range(40_000).selectExpr("if(id % 50 = 0, null, id) as id", "'t' as text")
    ids = spark.createDataFrame([(k,) for k in range(0, 40_000, 37)] + [(None,)], "doc_id long")
    want = docs.filter("id is null or id % 37 = 0").count()
    assert near_join.among(docs, ids, "id", most=0).count() == want
    near = near_join.among(docs, ids, "id")
    assert near.filter("id is null or id % 37 = 0").count() == want and near.count() < want + 0.05 * 40_000
    assert near.columns == docs.columns


def test_recall_on_a_test_table(spark):
    from pathlib import Path

    folder = "/root/testdata/sf0.01"
    if not Path(f"{folder}/documents.parquet").exists():
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    holds, sets = defaultdict(list), {r.doc_id: shingles(r.text) for r in rows}
    for i, s in sets.items():
        for x in s:
            holds[x].append(i)
    links = Counter()
    for i, s in sets.items():
        both = Counter(j for x in s for j in holds[x] if j > i)
        for j, n in both.items():
            if n * 5 >= 4 * (len(s) + len(sets[j]) - n):
                links.update((i, j))
    got = {r.doc_id: r.n_links for r in near_join.near_classes(docs).collect()}
    empty = sum(not s for s in sets.values())
    want = {i: links[i] if s else empty - 1 for i, s in sets.items()}
    assert sum(min(got[i], want[i]) for i in want) >= 0.999 * sum(want.values()) and all(got[i] <= want[i] for i in want)


def test_bands_reach_their_recall():
    bands, rows = near_join.choose_bands(0.8, 0.9995)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9995 and 1 - (1 - 0.4**rows) ** bands <= 0.2


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints_of_edited_texts(unique, nothing, hard):
    rows = sorted(unique.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in fingerprints.compare_with_next(unique).collect()}
    assert set(got) == {r.doc_id for r in rows}
    same = {}
    for k, r in enumerate(rows):
        own, following = r.text or "", rows[(k + 1) % len(rows)].text or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        g = got[r.doc_id]
        assert (g.n_chars, g.edited_sha256) == (len(own), hashlib.sha256(edited.encode()).hexdigest())
        assert same.setdefault(own, g.fingerprint) == g.fingerprint
        assert all(0 <= x <= 1 for x in (g.near_edited, g.near_next, g.resemblance_edited, g.resemblance_next))
        if own == following:
            assert g.near_next == 1
        true = shingles(own), shingles(edited)
        if true[0] and len(true[0]) < fingerprints.FLOOR and len(true[1]) < fingerprints.FLOOR:  # complete sketches are exact
            assert abs(g.resemblance_edited - len(true[0] & true[1]) / len(true[0] | true[1])) < 1e-9
    assert fingerprints.compare_with_next(nothing).count() == 0
    assert fingerprints.compare_with_next(hard).count() == hard.count()
    assert fingerprints.fingerprint(hard, name="score").columns == ["doc_id", "text", "lang", "source", "n_chars", "labels", "ids", "score"]


def python_sketch(text, fraction=fingerprints.FRACTION, floor=fingerprints.FLOOR):
    """The retained hashes of one text, by the definition, from hashes of single words."""
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[ \t\n\x0b\x0c\r]+", words) if w]
    one = fingerprints.hasher(fingerprints.SPACES)
    mixed, step, most = lambda x: int(kernels.mix(np.array([x % 2**64], np.uint64))[0]), 0x9E3779B97F4A7C15, 2**64
    hashes = {w: int(one(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))[0][0]) for w in set(words)}
    found = set()
    for k in range(max(1, len(words) - 4) if words else 0):
        some = words[k : k + 5]
        h = len(some)
        for w in some:
            h = mixed((h * step + hashes[w]) % most)
        found.add(h >> 32)
    ordered = sorted(found)
    return ordered[: max(floor, sum(h < int(fraction * 2**32) for h in ordered))]


def test_fingerprints_equal_the_definition(unique):
    for r in fingerprints.compare_with_next(unique).collect():
        t = unique.filter(f"doc_id = {r.doc_id}").first().text if r.doc_id % 9 == 0 else False
        if t is not False and len(t or "") < 5000:
            assert fingerprints.from_text(r.fingerprint).tolist() == python_sketch(t)


def test_any_ids_and_many_null_ids(spark):
    texts = [f"w{k} " * (k % 7 + 1) for k in range(300)]
    by_name = [(f"doc-{k * 37 % 300:03}", t) for k, t in enumerate(texts)]
    got = {r.doc_id: r.edited_sha256 for r in fingerprints.compare_with_next(spark.createDataFrame(by_name, "doc_id string, text string").repartition(3)).collect()}
    rows = sorted(by_name)
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + rows[(k + 1) % 300][1][:half]).encode()).hexdigest()
    some = spark.createDataFrame([(None if k % 3 else k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    placed = fingerprints.with_next(some).selectExpr("doc_id", "halo", "spark_partition_id() as p").filter("halo = 0")
    assert placed.count() == 300 and placed.filter("doc_id is null").select("p").distinct().count() >= 2
    assert fingerprints.compare_with_next(some).count() == 300


def test_likeness_errors_are_as_stated(spark):
    """Containment against the true shingle sets, within four standard errors and the floor's few hashes."""
    rnd = random.Random(3)
    for n in (20, 90, 400, 3000):
        for share in (0.0, 0.3, 0.8, 1.0):
            words = [f"w{rnd.randrange(10**9)}" for _ in range(n)]
            other = words[: int(n * share)] + [f"v{rnd.randrange(10**9)}" for _ in range(n - int(n * share))]
            a, b = shingles(" ".join(words)), shingles(" ".join(other))
            x, y = fingerprints.sketches([" ".join(words).encode(), " ".join(other).encode()])
            true = len(a & b) / min(len(a), len(b))
            k = max(min(n, fingerprints.FLOOR), n * fingerprints.FRACTION)
            assert abs(fingerprints.likeness(x, y)[0] - true) <= 4 * (true * (1 - true) / k) ** 0.5 + 1e-9


def test_sketches_merge():
    a, b = (" ".join(f"w{k}" for k in range(n, n + 3000)).encode() for n in (0, 2900))
    x, y = fingerprints.sketches([a, b])
    both = fingerprints.merge(x, y)
    assert set(both.tolist()) >= set(x.tolist()) | set(y.tolist())
    assert fingerprints.likeness(x, both)[0] == 1


def test_packing_pads_to_the_longest_row_of_a_bucket(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(11)
    docs = spark.createDataFrame([(k, rnd.randrange(1, 90_000)) for k in range(3000)], "doc_id long, size long")
    longest = defaultdict(int)
    got = packing.pack(docs, F.col("size")).collect()
    for r in got:
        longest[r.bucket] = max(longest[r.bucket], r.length)
    assert len(got) == 3000 and all(r.padded_length == longest[r.bucket] for r in got)
