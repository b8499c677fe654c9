"""Language identification by rank-order profiles.

A profile is the list of a text's most frequent letter n-grams (one to three letters, words padded with a blank), by
falling count and, among equals, rising code. A document is compared with the profile of every language by the
out-of-place distance: the sum, over the document's n-grams, of how far each stands from its place in the language's
profile, or of the largest distance where the language hasn't got it. The nearest language wins; ties go to the name that
comes first.

Fitting reads a bounded sample of labelled rows (`per_language` rows of each language, the least by a hash of the id), so
what reaches the driver is bounded by languages x profile size. Prediction reads whole texts, one at a time.

Edge cases: null texts and texts without a letter are `und` with score 0; with nothing to learn from, every text is `und`;
null ids and null languages are not learned from; repeated rows get equal answers; an empty table gives an empty result; very
long texts are counted whole; input columns named lang_pred or score are replaced, all others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
PER_LANGUAGE = 1500
PROFILE = 400
_BITS = np.uint64(21)


def _letters() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


_cache: dict[str, np.ndarray] = {}


def letter_table() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = _letters()
    return _cache["letters"]


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes of a text and their counts. A code packs up to three code points; a blank pads words."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if not text:
        return none
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letter_table()[points]
    if not letter.any():
        return none
    points = np.where(letter, points, np.uint32(32))
    points = np.concatenate(([32], points, [32])).astype(np.uint64)
    blank = points == 32
    points = points[~(blank & np.concatenate(([False], blank[:-1])))]  # runs of blanks become one
    two = (points[:-1] << _BITS) | points[1:]
    three = (two[:-1] << _BITS) | points[2:]
    middle = points[1:-1] == 32
    return np.unique(np.concatenate((points[points != 32], two, three[~middle])), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, most: int) -> np.ndarray:
    """The `most` most frequent codes in profile order."""
    if len(codes) > 4 * most:
        least = np.partition(counts, len(counts) - most)[len(counts) - most]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))][:most]


class Profiles:
    """The profiles of all languages, laid out for lookup by code."""

    def __init__(self, profiles: dict[str, np.ndarray], size: int = PROFILE):
        self.size = size
        self.names = sorted(profiles)
        self.codes = np.unique(np.concatenate([profiles[n] for n in self.names])) if self.names else np.zeros(0, np.uint64)
        self.ranks = np.full((len(self.codes) + 1, len(self.names)), -1, np.int32)
        for k, name in enumerate(self.names):
            self.ranks[np.searchsorted(self.codes, profiles[name]), k] = np.arange(len(profiles[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and score: how much of the largest distance the document stays below the runner-up's distance."""
        codes = ranked(*grams(text), self.size)
        if not len(codes) or not self.names:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        at = np.where(self.codes[at] == codes, at, len(self.codes))
        ranks = self.ranks[at]
        places = np.arange(len(codes))[:, None]
        far = np.where(ranks < 0, self.size, np.abs(ranks - places)).sum(axis=0)
        best = int(np.argmin(far))
        return self.names[best], float(1.0 - far[best] / (self.size * len(codes)))


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", lang_col="lang", per_language: int = PER_LANGUAGE, size: int = PROFILE) -> Profiles:
    """Profiles from the rows of docs whose language isn't null.

    The sample bound is `per_language` rows a language, chosen by a hash of the id; only ids and languages are ranked, and
    the rank limit is applied before the shuffle, so one language may hold any part of the rows. Counts are added up in
    Spark, and only each language's `size` most frequent n-grams come to the driver.
    """
    ids = docs.filter(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    # In two steps: the least of each of 64 parts of a language, then the least of those.
    order = [F.xxhash64(F.lit(17), "id"), F.col("id")]
    ids = ids.withColumn("part", F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(64)))
    sample = ids
    for by in (["lang", "part"], ["lang"]):
        sample = sample.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("n") <= per_language)
    sample = sample.select("id").distinct()
    texts = docs.filter(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(sample) if sample.count() <= 1_000_000 else sample, "id", "left_semi")
    # Of rows with one id and language the least by a hash of the text: ids may repeat, the bound is on rows.
    texts = texts.groupBy("id", "lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, group in batch.groupby("lang"):
                found = [grams(t) for t in group["text"]]
                codes, inverse = np.unique(np.concatenate([c for c, _ in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([n for _, n in found]), len(codes)) if len(codes) else np.zeros(0)
                yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": counts.astype(np.int64)})

    total = texts.mapInPandas(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= size)
    profiles: dict[str, list] = {}
    for lang, code, _ in sorted(((r["lang"], r["code"], r["r"]) for r in top.select("lang", "code", "r").collect()), key=lambda x: (x[0], x[2])):
        profiles.setdefault(lang, []).append(code)
    return Profiles({k: np.array(v, np.int64).astype(np.uint64) for k, v in profiles.items()}, size)


def identify(docs: DataFrame, profiles: Profiles, *, text_col="text", keep=None) -> DataFrame:
    """The columns `keep` of docs (all by default) with lang_pred and score."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    schema = "lang_pred string, score double"

    @F.pandas_udf(schema)
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([profiles.predict(t) for t in texts], columns=["lang_pred", "score"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), predict.asNondeterministic()(F.col(text_col)).alias("own"))  # a filter on its result must not run it again
    return packed.select("row.*", "own.*")
