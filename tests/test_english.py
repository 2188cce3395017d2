"""Stems, matches and cover density."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.functions import english
from siltstone.operators import rank

STEMS = (
    "caresses:caress ponies:poni ties:tie cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss "
    "fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope formaliti:formal "
    "triplicate:triplic formative:format electrical:electr goodness:good revival:reviv allowance:allow inference:infer adjustable:adjust replacement:replac adoption:adopt communism:communism effective:effect probate:probat "
    "rate:rate cease:ceas controll:control roll:roll"
)


@pytest.mark.parametrize("pair", STEMS.split())
def test_stems(pair):
    word, want = pair.split(":")
    assert english.stem(word) == want


def test_covers():
    assert english.covers(["a", "b"], ["a", "b"]) == pytest.approx(0.1)
    assert english.covers("cach x redi cach".split(), ["cach", "redi"]) == pytest.approx(0.1 / 2 + 0.1)
    assert english.covers(["a"], ["a", "b"]) == 0


def test_search(spark):
    rows = [(1, "The caches were slow"), (2, "caching is hard, says the cache team"), (3, "redis cache"), (4, None), (5, "cache, then at length, redis")]
    docs = spark.createDataFrame(rows, "chunk_id long, content string")
    found = lambda q: {r.chunk_id for r in docs.select("chunk_id", english.lexemes(F.col("content")).alias("s")).filter(english.matches(F.col("s"), q)).collect()}
    assert found("cached") == {1, 2, 3, 5} and found("the") == set() and found("cache -redis") == {1, 2} and found("slow or redis") == {1, 3, 5}
    assert found('"redis caching"') == {3} and found('"caches were slow"') == {1}
    assert [r.chunk_id for r in rank.english_topk(docs, "redis caches", 5).orderBy("rank").collect()] == [3, 5]


def test_words_begin_as_their_stems():
    rnd = random.Random(7)
    ends = [r.partition(":")[0] for r in f"{english.STEP_2} {english.STEP_3} {english.STEP_4} ogi li ative ion ied ies sses s us eedly eed ingly edly ing ed y ying ll e".split()]
    words = [r.split(":")[0] for r in english.WHOLE.split()] + english.LEFT_BY_STEP_1.split() + [p.split(":")[0] for p in STEMS.split()]
    words += ["".join(rnd.choice("abeilnoistyz") for _ in range(rnd.randrange(7))) + "".join(rnd.choice(ends) for _ in range(rnd.randrange(4))) for _ in range(50_000)]
    assert [w for w in words if not w.startswith(english.could_begin(english.stem(w)))] == []


def test_a_search_keeps_places_of_the_named_stems_alone(spark, monkeypatch):
    monkeypatch.setattr(english, "STRETCH", 16)
    rnd = random.Random(4)
    some = "the cache caching of redis slow slowly İng café 7 x1 ,".split() + ["\n\n", "K"]
    texts = [None, "", "the", *(" ".join(rnd.choice(some) for _ in range(rnd.randrange(60))) for _ in range(60))]
    queries = ["cached", "the", "", "redis -slow", '"the cache" or "redis of slow"', "caches redis or slow", '-"of the" cache', "-redis"]
    for t in texts:
        assert list(english.words_of(t or "")) == re.findall("[a-z0-9]+", (t or "").lower())
    docs = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, content string").repartition(2)
    stems = docs.select("chunk_id", english.lexemes(F.col("content")).alias("s")).cache()
    for q in queries:
        # Stems as a column, matched by its array functions, and covers of each alternative.
        found = stems.filter(english.matches(F.col("s"), q)).collect()
        wanted = [list(dict.fromkeys(w for ok, words in alternative if ok for w in words if w)) for alternative in english.terms(q)]
        want = sorted((-max((english.covers(r.s, w) for w in wanted if w), default=0.0), r.chunk_id) for r in found)
        assert [(-r.score, r.chunk_id) for r in rank.english_topk(docs, q, 99).orderBy("rank").collect()] == want
    plan = rank.english_topk(docs, "redis", 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "array<string>" not in plan and "lexemes" not in plan
