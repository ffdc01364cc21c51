"""Quality classifier: a sparse rule ensemble over text statistics, scored by Spark column expressions.

Statistics of whole texts are plain numbers (``STATISTICS``). Boosted trees of depth ``DEPTH`` are grown on a bounded
sample of labelled rows; each path from a root to an inner node or leaf is a conjunctive rule. A logistic model with a
lasso penalty weighs the rules, most weights become zero, and what is left compiles into one Column:
``1 / (1 + exp(-(bias + sum of weights of the rules that hold)))``.

Only the fit uses a sample: about ``SAMPLE_ROWS`` labelled rows of the training folds, chosen by the hash of the id (never over four
times as many). Scores cover every row. Without labelled rows every score is 0.5; with one class only, the smoothed share of that class.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import at_most, bounded_sample, fold, materialize, per_text

SAMPLE_ROWS = 20_000
TREES = 24
DEPTH = 3
RATE = 0.3
BINS = 32
LEAST_ROWS = 10
PENALTY = 0.002
STEPS = 600
FOLDS, HELD = 5, 0
THRESHOLD = 0.3

STATISTICS = [
    "log_bytes", "log_words", "log_lines", "mean_word", "long_words", "short_words", "upper", "digit", "symbol", "bar", "bang", "comma_stop", "high_bytes",
    "distinct_far", "distinct_near", "repeated_lines", "words_per_line", "top_byte",
]

_CLASS = np.zeros((256, 8))
for _i, _chars in enumerate((range(65, 91), range(48, 58), b"#$%&*+<=>@\\^_`{}~[]/", b"|", b"!?", b".,;:", range(128, 256), [*range(97, 123), *range(65, 91), *range(128, 256)])):
    _CLASS[list(_chars), _i] = 1
#: Names of the columns of statistics begin with this.
PREFIX = "__s_"
#: Words of the stretches over which shares of distinct words are taken, so that they do not fall with length.
NEAR, FAR = 64, 320


def statistics_of(text: bytes) -> list[float]:
    """The statistics of one text; an empty text has zeros."""
    words = text.lower().split()
    if not words:
        return [0.0] * len(STATISTICS)
    bytes_, n = len(text), len(words)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, digit, symbol, bar, bang, stops, high, letters = (histogram @ _CLASS).tolist()
    sizes = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in text.split(b"\n") if x]
    near = sum(len(set(words[i : i + NEAR])) for i in range(0, n, NEAR))
    far = sum(len(set(words[i : i + FAR])) for i in range(0, n, FAR))
    return [
        float(np.log1p(bytes_)), float(np.log1p(n)), float(np.log1p(len(lines))), float(sizes.mean()), float((sizes >= 8).mean()), float((sizes <= 3).mean()),
        upper / max(letters, 1), digit / bytes_, symbol / bytes_, bar / bytes_, bang / bytes_, stops / n, high / bytes_,
        far / n, near / n, 1 - sum(map(len, set(lines))) / max(1, sum(map(len, lines))), n / max(1, len(lines)), int(histogram[33:].max()) / bytes_,
    ]


def with_statistics(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` plus one double per statistic, for every whole text (null: empty)."""

    def make():
        def apply(texts):
            columns = np.array([statistics_of(t) for t in texts]).reshape(len(texts), len(STATISTICS)).T
            return dict(zip([f"{PREFIX}{s}" for s in STATISTICS], columns, strict=True))

        return apply

    return per_text(docs, ", ".join(f"{PREFIX}{s} double" for s in STATISTICS), make, keep, text_col)


#: A condition: (statistic, whether values up to the bound fit (else those above), bound).
Condition = tuple[str, bool, float]


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self) -> Column:
        """The probability of label 1 over the columns of statistics."""
        total = F.lit(self.bias)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for name, low, bound in conditions:
                c = F.col(f"{PREFIX}{name}")
                holds = holds & ((c <= bound) if low else (c > bound))
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _holds(x: np.ndarray, conditions: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, low, bound in conditions:
        c = x[:, STATISTICS.index(name)]
        out &= (c <= bound) if low else (c > bound)
    return out


def _grow(binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, depth: int, out: np.ndarray, rules: list) -> None:
    """Split where the gain is largest; record each path and write leaf values into ``out``."""
    g, h = gradient[rows], hessian[rows]
    best = (1e-6, -1, -1)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        whole = g.sum() ** 2 / (h.sum() + 1)
        for j, own in enumerate(cuts):
            if not len(own):
                continue
            b = binned[rows, j]
            gs, hs, ns = (np.bincount(b, w, len(own) + 1).cumsum()[:-1] for w in (g, h, None))
            gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
            gain[(ns < LEAST_ROWS) | (len(rows) - ns < LEAST_ROWS)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], j, k)
    if path:
        rules.append(path)
    if best[1] < 0:
        out[rows] += RATE * g.sum() / (h.sum() + 1)
        return
    _, j, k = best
    left = binned[rows, j] <= k
    for side, low in ((left, True), (~left, False)):
        _grow(binned, cuts, gradient, hessian, rows[side], (*path, (STATISTICS[j], low, float(cuts[j][k]))), depth - 1, out, rules)


def _simplify(path: tuple[Condition, ...]) -> tuple[Condition, ...]:
    """One bound for each statistic and side."""
    kept: dict[tuple[str, bool], float] = {}
    for name, low, bound in path:
        old = kept.get((name, low))
        kept[name, low] = bound if old is None else (min if low else max)(old, bound)
    return tuple(sorted((n, low, b) for (n, low), b in kept.items()))


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 0) -> RuleEnsemble:
    """Boosted trees for the rules, then proximal gradient descent on the lasso logistic loss."""
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if len(y) == 0 or y.min() == y.max():
        return RuleEnsemble(bias, [])
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    margin, rules = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        pick = np.flatnonzero(rng.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        _grow(binned, cuts, y - p, p * (1 - p), pick, (), DEPTH, step, rules)
        margin += step
    paths = sorted({_simplify(r) for r in rules})
    if not paths:
        return RuleEnsemble(bias, [])
    design = np.stack([_holds(x, p) for p in paths], axis=1).astype(float)
    _, first = np.unique(design, axis=1, return_index=True)  # equal columns once
    paths, design = [paths[i] for i in sorted(first)], design[:, sorted(first)]
    mean, scale = design.mean(0), np.maximum(design.std(0), 0.05)
    z = (design - mean) / scale
    rate = 4 / np.linalg.norm(z, 2) ** 2 * len(y)
    w = prev = np.zeros(z.shape[1])
    b, prev_b, t = bias, bias, 1.0
    for _ in range(STEPS):
        following = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = w + (t - 1) / following * (w - prev), b + (t - 1) / following * (b - prev_b)
        error = 1 / (1 + np.exp(-(z @ look + look_b))) - y
        prev, prev_b, t = w, b, following
        w = look - rate * (z.T @ error) / len(y)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * PENALTY, 0)
        b = look_b - min(rate, 4.0) * error.mean()
    weights = w / scale
    return RuleEnsemble(float(b - weights @ mean), [(p, float(v)) for p, v in zip(paths, weights, strict=True) if v])


def fit(statistics: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = FOLDS, held: int = HELD) -> RuleEnsemble:
    """Rules from the labelled rows whose fold is not ``held``. Null labels and ids do not count."""
    known = labels.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{label_col}`").cast("double").alias("__y")).where("__id is not null and __y is not null")
    known = bounded_sample(known.where(fold("__id", folds) != held), "__id", SAMPLE_ROWS)
    columns = [f"{PREFIX}{s}" for s in STATISTICS]
    joined = statistics.join(known, F.col(id_col) == F.col("__id")).select("__id", *columns, "__y")
    sample = at_most(joined, 4 * SAMPLE_ROWS).toPandas().sort_values(["__id", *columns, "__y"])  # over SAMPLE_ROWS only if ids repeat
    return fit_rules(sample[columns].to_numpy(float), (sample["__y"].to_numpy(float) >= 0.5).astype(float))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted) for every row; repeated rows get equal scores, null texts the empty text's."""
    statistics = materialize(with_statistics(docs, [id_col], text_col), "quality")
    model = fit(statistics, labels, id_col, label_col)
    scored = statistics.select(F.col(id_col), (fold(id_col, FOLDS) == HELD).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
