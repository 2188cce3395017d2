"""Quality classifier: a sparse rule ensemble compiled into column expressions.

Statistics of each whole text are built-in column expressions. On labelled rows, small boosted trees are
grown over them; every path from a root is a conjunctive rule. A logistic regression with an L1 penalty
weighs the rules and drops most. What is left compiles into one Spark expression: scoring is a scan.

Only statistics of the text are inputs: no label, language, source or id. Fitting uses a bounded sample
of labelled rows (SAMPLE, the least hashes of the id); only their statistics reach the driver.

Defined results: a null text is the empty text, whose statistics are 0; texts of any length are read whole; rows without a
label, or with a null one, are never learned from; repeated rows are scored alike and learned from as often as
they are labelled; with labels of one class only, or none, every score is the smoothed share of label 1; an empty table
gives an empty result; other columns pass through, and the score takes the place of a column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, making_room, whole_text

#: Labelled rows that a model is fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, LEAST, PENALTY = 24, 3, 64, 0.3, 10, 0.0005
#: Common function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is it that for with was on as are be this by an or from der die das und ist nicht ein eine von mit den zu auf "
    "le la les des et un une que qui dans pour par est sur el los las y en de del no se con una para su"
).split()


def _statistics(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Named statistics of a text; all are shares or means, so texts of any length compare."""
    share = lambda part, whole: F.coalesce(part / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))
    chars = F.length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "log_chars": F.log1p(chars.cast("double")),
        "upper": share(count(r"\p{Lu}"), chars),
        "digits": share(count(r"\p{Nd}"), chars),
        "symbols": share(count(r"[^\p{L}\p{N}\s.,;:'\"?()-]"), chars),
        "stops": share(count(r"[.,;:?]"), chars),
        "word_chars": share(chars, F.size(words)),
        "distinct_words": share(F.size(F.array_distinct(words)), F.size(words)),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(F.size(words), F.size(lines)),
        "function_words": share(count(rf"(?i)(?<![\p{{L}}])(?:{'|'.join(FUNCTION_WORDS)})(?![\p{{L}}])"), F.size(words)),
    }


#: The statistics' names.
STATISTICS = ["log_chars", "upper", "digits", "symbols", "stops", "word_chars", "distinct_words", "distinct_lines", "line_words", "function_words"]


def with_statistics(docs: DataFrame, text_col: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with each text's statistics, and the names of their columns.

    A model names each statistic in many rules. They come out of a generator of one row, which the optimizer
    neither folds into those rules nor pushes filters through: each is worked out once a text.
    """
    words, lines = fresh_name(docs, "words"), fresh_name(docs, "lines")
    at = {k: fresh_name(docs, f"stat_{k}") for k in STATISTICS}
    text = whole_text(text_col)
    cut = docs.withColumns({words: F.split(text, r"\s+"), lines: F.split(text, r"\n")})
    found = _statistics(text, F.col(words), F.col(lines))
    return cut.select(*[F.col(f"`{c}`") for c in docs.columns], F.inline(F.array(F.struct(*[found[k].alias(at[k]) for k in STATISTICS])))), at


@dataclass
class Rule:
    """All of its (statistic, threshold, above) hold."""

    parts: tuple[tuple[str, float, bool], ...]
    weight: float = 0.0

    def holds(self, columns: dict[str, Column]) -> Column:
        return reduce(Column.__and__, [columns[s] > t if above else columns[s] <= t for s, t, above in self.parts])


@dataclass
class Model:
    bias: float
    rules: list[Rule] = field(default_factory=list)

    def score(self, columns: dict[str, Column]) -> Column:
        total = reduce(Column.__add__, [F.when(r.holds(columns), r.weight).otherwise(0.0) for r in self.rules], F.lit(self.bias))
        return 1.0 / (1.0 + F.exp(-total))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def grow_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Rule]:
    """The paths of boosted trees of DEPTH levels, each once."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    cell = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], 1)
    z = np.full(len(y), np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    found: dict[tuple, Rule] = {}
    for _ in range(TREES):
        p = _sigmoid(z)
        gradient, curve = y - p, p * (1 - p) + 1e-6
        nodes = [((), np.arange(len(y)))]
        for level in range(DEPTH + 1):
            after = []
            for path, rows in nodes:
                best = (1e-6, 0, 0)
                g, h = gradient[rows].sum(), curve[rows].sum()
                if level < DEPTH and len(rows) >= 2 * LEAST:
                    for k, c in enumerate(cuts):
                        if not len(c):
                            continue
                        gs, hs, ns = (np.cumsum(np.bincount(cell[rows, k], v, len(c) + 1))[:-1] for v in (gradient[rows], curve[rows], None))
                        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                        gain[(ns < LEAST) | (len(rows) - ns < LEAST)] = 0
                        if gain.max() > best[0]:
                            best = (gain.max(), k, int(gain.argmax()))
                if best[0] <= 1e-6:
                    z[rows] += RATE * g / (h + 1)
                    continue
                _, k, at = best
                low = cell[rows, k] <= at
                for above, some in ((False, rows[low]), (True, rows[~low])):
                    step = (*path, (names[k], float(cuts[k][at]), above))
                    found.setdefault(tuple(sorted(step)), Rule(tuple(sorted(step))))
                    after.append((step, some))
            nodes = after
    return list(found.values())


def weigh(hits: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on the weights, by accelerated proximal gradient steps."""
    n, m = hits.shape
    scale = np.maximum(hits.std(0), 0.02)
    mean = hits.mean(0)
    a = (hits - mean) / scale
    rate = 4 / (np.linalg.norm(a, 2) ** 2 / n + 1)
    bias = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    w, v, b, c, t = np.zeros(m), np.zeros(m), bias, bias, 1.0
    for _ in range(steps):
        r = _sigmoid(a @ v + c) - y
        new = v - rate * (a.T @ r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        fresh = c - rate * r.mean()
        u = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / u * (new - w), fresh + (t - 1) / u * (fresh - b)
        w, b, t = new, fresh, u
    return b - float((w / scale) @ mean), w / scale


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model from the labelled rows of docs; hold rows out by leaving them out of labels."""
    some = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_of"), F.col(label_col).cast("int").alias("_label"))
    some = some.orderBy(F.xxhash64("_of"), "_of", "_label").limit(sample)  # the broadcast holds this many rows at most
    rows = docs.select(F.col(id_col).alias("_id"), whole_text(text_col).alias("_text")).join(F.broadcast(some), F.col("_id") == F.col("_of"))
    measured, at = with_statistics(rows, "_text")
    got = measured.select("_id", "_label", *[F.col(at[k]).alias(k) for k in STATISTICS]).orderBy("_id", "_label", *STATISTICS).limit(sample).collect()
    y = np.array([r["_label"] for r in got], float)
    if len(y) == 0 or y.min() == y.max():
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    names = STATISTICS
    x = np.array([[r[k] for k in names] for r in got], float)
    rules = grow_rules(x, y, names)
    if not rules:
        return Model(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    column = {k: x[:, i] for i, k in enumerate(names)}
    hits = np.stack([np.logical_and.reduce([column[s] > t if above else column[s] <= t for s, t, above in r.parts]) for r in rules], 1).astype(float)
    bias, weights = weigh(hits, y)
    return Model(bias, [Rule(r.parts, float(w)) for r, w in zip(rules, weights, strict=True) if abs(w) > 1e-4])


def score(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with the model's score of each whole text, 0 to 1."""
    docs = making_room(docs, [name], keep=(text_col,))
    measured, at = with_statistics(docs, text_col)
    return measured.withColumn(name, model.score({k: F.col(c) for k, c in at.items()})).drop(*at.values())
