"""Toxic passages as maximum-scoring segments of token log-odds.

Every token gets the log-odds of its strongest feature (the word, or its first four or five letters) between toxic and
other documents, under an informative Dirichlet prior taken from both together. Tokens without a significant feature cost
a fixed amount. One linear scan then finds every maximal scoring segment of a text. Segment scores are put on a common
scale by extreme-value statistics: with lambda the positive root of E[exp(lambda s)] = 1 over the tokens of other documents
and K fitted to a quantile of their best segments' scores (documents without a positive one count as the lowest), a segment
of score S in a text of n tokens has the E-value K n exp(-lambda S). The evidence of a document is the sum of the logarithms
by which its significant segments pass E = 1, and a logistic curve fitted on the labelled rows turns it into a score.

What fitting reads and keeps, all parameters of `fit`: at most `rows` labelled rows (`TRAIN_ROWS`), the least by a hash of
the id, one row an id (of rows with one id the least by a hash of the text); of those that have an equal least 5-word
shingle, copies as a rule, and of those without words, only the one of least id, since copies would make every word of theirs
look telling; features in at least `least_count` of these documents, with log-odds at least `least_z` deviations from 0,
and of these at most `features`, the strongest. The rows are written once, so all passes of the fit see the same. Counts are
made in Spark; at most `features` of them, and two numbers a row, come to the driver. Scoring covers whole texts.

Edge cases: null and empty texts have no evidence and get the score of none; with no labels, or with one class only, every
score is the part of toxic labels (0 without any); an id labelled both 0 and 1 counts as 1; null labels and null ids are not
learned from; repeated rows get equal scores; equally strong features are taken in the order of their names, and of a token's
equally strong ones the word comes first; very long texts and words are read whole; input columns named like an output column
(toxicity, toxic_starts, toxic_ends, toxic_margins) are replaced, all others are kept.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.session import work_table
from llm.textkernel import Words, encode, shingles

TRAIN_ROWS = 20_000
FEATURES = 50_000
LEAST_COUNT = 4
LEAST_Z = 2.4
#: The prior weighs this part of all counts.
PRIOR = 0.1
HIGHEST = 6.0
NEUTRAL = -0.7
_TOKEN = re.compile(r"[^\W\d_]+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def features(token: str) -> list[str]:
    """The word itself and, of longer ones, how they begin."""
    out = ["=" + token]
    if len(token) > 5:
        out.append("^" + token[:5])
    if len(token) > 4:
        out.append("^" + token[:4])
    return out


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as (start, end, score), by the linear-time scan over cumulative sums.

    A candidate keeps the sums before and after it and a link to the latest candidate that begins lower. A new positive
    score is joined to the latest candidate that begins lower, if that ends lower, and so on; following links skips, once
    and for all, those that begin higher. Where none begins lower, no later score can reach the candidates so far: they
    are final.
    """
    out: list[tuple[int, int, float]] = []
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, link
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        start, low, keep = i, before, len(found)
        k = keep - 1
        while True:
            while k >= 0 and found[k][2] >= low:
                k = found[k][4]
            if k < 0 or found[k][3] >= total:
                break
            start, low, keep, k = found[k][0], found[k][2], k, found[k][4]
        del found[keep:]
        if k < 0:
            out += [(a, b, after - base) for a, b, base, after, _ in found]
            found.clear()
        found.append((start, i + 1, low, total, k))
    return out + [(a, b, after - base) for a, b, base, after, _ in found]


def least_shingle(texts: pd.Series) -> pd.Series:
    """The least shingle hash of a text; 0 without words."""
    words = Words([encode(t) for t in texts])
    h, text, _ = shingles(words)
    out = np.zeros(len(texts), np.uint64)
    if len(h):
        first = np.flatnonzero(np.diff(text, prepend=-1))
        out[text[first]] = np.minimum.reduceat(h, first)
    return pd.Series(out.astype(np.int64))


@dataclass
class Model:
    """Token scores and their calibration."""

    table: dict[str, float] = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    weight: float = 0.0
    bias: float = 0.0
    floor: float = 0.0
    memo: dict[str, float] = field(default_factory=dict)

    def token(self, t: str) -> float:
        s = self.memo.get(t)
        if s is None:
            s = max((self.table[f] for f in features(t) if f in self.table), key=abs, default=NEUTRAL)
            if len(self.memo) > 300_000:
                self.memo.clear()
            if len(t) <= 64:
                self.memo[t] = s
        return s

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]], list[float]]:
        words = tokens(text)
        scores = list(map(self.token, words))
        return len(words), maximal_segments(scores) if scores and max(scores) > 0 else [], scores

    def margin(self, n: int, score: float) -> float:
        """-log of the E-value of a segment; positive where it is significant."""
        return self.lam * score - self.log_k - math.log(max(n, 1))

    def evidence(self, n: int, segments: list[tuple[int, int, float]]) -> float:
        return math.log1p(sum(max(0.0, self.margin(n, s)) for _, _, s in segments))

    def probability(self, evidence: float) -> float:
        if not self.table:
            return self.floor
        return 1.0 / (1.0 + math.exp(-max(-50.0, min(50.0, self.bias + self.weight * evidence))))

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability, and the significant segments with their margins."""
        n, segments, _ = self.scan(text)
        return self.probability(self.evidence(n, segments)), [(a, b, m) for a, b, s in segments if (m := self.margin(n, s)) > 0]


def _log_odds(counts: pd.DataFrame, n1: float, n0: float, least_z: float = LEAST_Z) -> dict[str, float]:
    """Log-odds of each feature with a Dirichlet prior in proportion to its frequency in both classes; weak ones are left out."""
    total = n1 + n0
    y1, y0 = counts["toxic"].to_numpy(float), counts["other"].to_numpy(float)
    weight = PRIOR * total
    a = weight * (y1 + y0) / total
    d = np.log((y1 + a) / (n1 + weight - y1 - a)) - np.log((y0 + a) / (n0 + weight - y0 - a))
    z = d / np.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    return {f: float(min(HIGHEST, max(-HIGHEST, s))) for f, s, k in zip(counts["feature"], d, z, strict=True) if abs(k) >= least_z}


def _log_k(best: np.ndarray, without: int) -> float:
    """log K from lambda S - log n of the best segments, of which `without` more documents have none.

    A Gumbel variable of scale 1 has its quantile q at log K - log(-log q); the median is taken, or, where more than half of
    the documents have no segment, the middle of those that have one.
    """
    n = len(best) + without
    if not len(best):
        return 0.0
    q = max(0.5, (1 + without / n) / 2)
    at = np.concatenate((np.full(without, -np.inf), np.sort(best)))[min(n - 1, int(q * n))]
    return float(at + math.log(-math.log(q)))


def _root(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E[exp(x s)] = 1, for scores of negative mean; 1 where there is none."""
    if not len(values) or values.max() <= 0 or (values * weights).sum() >= 0:
        return 1.0
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    while (p * np.exp(high * values)).sum() < 1 and high < 50:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * values)).sum() < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weight and bias by Newton's method with a little shrinkage; each feature value once with its counts would do as well."""
    w = np.zeros(2)
    design = np.column_stack([x, np.ones(len(x))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (p - y) + np.array([1e-2, 0]) * w
        hess = (design * (p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(text, y) of at most `rows` documents, none of which is a copy of another."""
    marked = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    sample = F.broadcast(marked.sort(F.xxhash64(F.lit(10), "id"), "id").limit(rows))  # at most `rows` ids and labels
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(sample, "id")
    known = known.withColumns({"least": F.pandas_udf(least_shingle, "long")(F.col("text")), "h": F.xxhash64("text")})
    known = work_table(known.groupBy("id").agg(F.min_by(F.struct("text", "y", "least"), F.struct("h", "text")).alias("r")).select("id", "r.*"), "labelled")
    first = known.groupBy("least").agg(F.min("id").alias("id")).select("id")  # at most `rows` ids
    return known.join(F.broadcast(first), "id", "left_semi").select("text", "y")


def fit(docs: DataFrame, labels: DataFrame, *, id_col="doc_id", text_col="text", label_col="toxic", rows: int = TRAIN_ROWS, features_kept: int = FEATURES, least_count: int = LEAST_COUNT, least_z: float = LEAST_Z) -> Model:
    """A model from the rows of docs that labels mark with 0 or 1."""
    known = _labelled(docs, labels, id_col, text_col, label_col, rows)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for batch in batches:
            for text, y in zip(batch["text"], batch["y"], strict=True):
                # Once a document: a document is the unit of evidence, and a few long ones must not carry a feature.
                sums[int(y)].update({f for t in set(tokens(text)) for f in features(t)})
            if sum(map(len, sums.values())) > 500_000:
                yield out(sums)
        yield out(sums)

    def out(sums: dict[int, Counter]) -> pd.DataFrame:
        rows = [(f, y, n) for y, c in sums.items() for f, n in c.items()]
        for c in sums.values():
            c.clear()
        return pd.DataFrame(rows, columns=["feature", "y", "n"])

    counts = known.mapInPandas(count, "feature string, y int, n long").groupBy("feature").agg(F.sum(F.expr("if(y = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(y = 0, n, 0)")).alias("other"))
    counts = work_table(counts, "features")
    sizes = counts.agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")).first()
    n1, n0 = float(sizes["a"] or 0), float(sizes["b"] or 0)
    if not n1 or not n0:
        seen = known.agg(F.avg("y")).first()[0]
        return Model(floor=float(seen or 0.0))
    strength = F.abs(F.log((F.col("toxic") + 0.5) / F.lit(n1)) - F.log((F.col("other") + 0.5) / F.lit(n0))) * F.sqrt(F.col("toxic") + F.col("other"))
    top = counts.filter(F.col("toxic") + F.col("other") >= least_count).sort(strength.desc(), "feature").limit(features_kept).toPandas()
    model = Model(table=_log_odds(top, n1, n0, least_z))
    plain = Model(table=model.table)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, y in zip(batch["text"], batch["y"], strict=True):
                n, segments, scores = plain.scan(text)
                kinds = Counter(round(s, 1) for s in scores)
                out.append((int(y), n, [s for _, _, s in segments], list(kinds), [float(c) for c in kinds.values()]))
            yield pd.DataFrame(out, columns=["y", "n", "segments", "kinds", "times"])

    seen = work_table(known.mapInPandas(measure, "y int, n long, segments array<double>, kinds array<double>, times array<double>"), "measured")
    kinds = seen.filter("y = 0").select(F.explode(F.arrays_zip("kinds", "times")).alias("k")).groupBy("k.kinds").agg(F.sum("k.times").alias("n")).toPandas().sort_values("kinds")  # tenths between the extremes
    model.lam = _root(kinds["kinds"].to_numpy(float), kinds["n"].to_numpy(float))
    # With G = lambda * best - log n a Gumbel variable of scale 1.
    best = seen.filter("y = 0 and n > 0").select("n", F.array_max("segments").alias("s")).toPandas()
    has = best["s"].notna()
    model.log_k = _log_k(model.lam * best["s"][has].to_numpy(float) - np.log(best["n"][has].to_numpy(float)), int((~has).sum()))
    margin = f"greatest(0D, {model.lam!r}D * s - ({model.log_k!r}D) - ln(greatest(n, 1)))"
    x = seen.select("y", F.expr(f"log1p(aggregate(array_sort(segments), 0D, (a, s) -> a + {margin}))").alias("x")).toPandas().sort_values(["x", "y"])
    model.weight, model.bias = _logistic(x["x"].to_numpy(float), x["y"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, *, text_col="text", keep=None) -> DataFrame:
    """The columns `keep` of docs (all by default) with toxicity and, of each significant segment, its first token
    (toxic_starts), the token after its last (toxic_ends) and its margin (toxic_margins)."""
    own = ["toxicity", "toxic_starts", "toxic_ends", "toxic_margins"]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]
    model.memo.clear()  # it would travel with the plan

    @F.pandas_udf("toxicity double, toxic_starts array<int>, toxic_ends array<int>, toxic_margins array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for t in batch:
                p, spans = model.score(t if isinstance(t, str) else None)
                rows.append((p, *([x[k] for x in spans] for k in range(3))))
            yield pd.DataFrame(rows, columns=own)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), run(F.col(text_col)).alias("own"))
    return packed.select("row.*", "own.*")
