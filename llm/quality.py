"""Quality rules as a short-circuit cascade.

Each rule looks at the statistics of a text and rejects it or not. On a sample the cascade measures, for every rule, what
it costs and what part of the texts it rejects; rules then run in falling order of rejection per cost, and a text leaves
at the first rule that rejects it. The order decides only what is spent: a text is kept when no rule rejects it.

The statistics count words (runs of bytes other than space and tab to carriage return) over whole texts.

Cost is the time the rules take on an executor, so their order, and which of several rules that reject a text is named, may
differ from run to run; what is kept doesn't. Rules of equal rejection per cost (ties) run in the order in which they are listed.

Edge cases: null and empty texts have no words and fail the base rule; repeated rows get equal answers; an empty table
gives an empty result (the cascade then keeps the order in which the rules are listed); very long texts are read whole;
input columns named like an output column are replaced, all others are kept.
"""

from __future__ import annotations

import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = bytes([0x20, *range(0x09, 0x0E)])
_NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
SAMPLE_ROWS = 500


class Text:
    """A text with its statistics, each computed when first asked for."""

    def __init__(self, text: str | None):
        self.raw = (text or "").encode("utf-8", "surrogatepass")
        self.words = self.raw.split()
        self._known: dict[str, int] = {}

    def __getattr__(self, name: str) -> int:
        known = self.__dict__["_known"]
        if name not in known:
            known[name] = _STATISTICS[name](self)
        return known[name]


def _dup_lines(t: Text) -> int:
    lines = [x for x in t.raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def _repeat_words(t: Text) -> int:
    """Words that lie in a 3-word window found at least twice in the text, its first place included."""
    w = t.words
    windows = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered, until = 0, 0
    for i, x in enumerate(windows):
        if count[x] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


_STATISTICS: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": lambda t: len(t.raw.translate(None, _SPACE + _CONTINUATION)),
    "n_symbols": lambda t: len(t.raw.translate(None, _NOT_SYMBOL)),
    "n_lines": lambda t: sum(1 for x in t.raw.split(b"\n") if x and not x.isspace()),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": _repeat_words,
    "n_distinct_words": lambda t: len(set(t.words)),
    "longest_word": lambda t: max(map(len, t.words), default=0),
    "n_digits": lambda t: sum(t.raw.count(d) for d in (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9")),
}


def base_failed(t: Text) -> bool:
    return t.n_words < 50 or 100 * t.n_repeat_words > 50 * t.n_words


#: Rules in whole numbers: a name, and whether a text is rejected.
RULES: dict[str, Callable[[Text], bool]] = {
    "symbols": lambda t: 100 * t.n_symbols > 10 * t.n_words,
    "dup_lines": lambda t: 100 * t.n_dup_lines > 30 * t.n_lines,
    "short_words": lambda t: t.word_chars < 2 * t.n_words,
    "long_words": lambda t: t.word_chars > 15 * t.n_words,
    "few_distinct": lambda t: 100 * t.n_distinct_words < 10 * t.n_words,
    "digits": lambda t: 100 * t.n_digits > 20 * t.word_chars,
    "huge_word": lambda t: t.longest_word > 1000,
}


@dataclass
class Cascade:
    """Rules in the order in which they run, with the cost and selectivity that put them there."""

    order: list[str]
    cost: dict[str, float] = field(default_factory=dict)
    rejects: dict[str, float] = field(default_factory=dict)

    def verdict(self, t: Text) -> str | None:
        """The first rule that rejects the text, or None."""
        return next((name for name in self.order if RULES[name](t)), None)


def measure(texts: list[str | None]) -> dict[str, tuple[float, int]]:
    """Seconds and rejections of each rule over texts. A rule's cost includes the statistics it needs."""
    out = {}
    for name, rule in RULES.items():
        parsed = [Text(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(rule(t) for t in parsed)
        out[name] = time.perf_counter() - began, rejected
    return out


def plan(n: int, found: dict[str, tuple[float, int]]) -> Cascade:
    """Order the rules by rejection per cost, as measured on n texts."""
    cost = {name: s / max(1, n) for name, (s, _) in found.items()}
    rejects = {name: r / max(1, n) for name, (_, r) in found.items()}
    order = sorted(RULES, key=lambda x: -rejects[x] / max(cost[x], 1e-9)) if n else list(RULES)
    return Cascade(order, cost, rejects)


def fit(docs: DataFrame, *, id_col="doc_id", text_col="text", rows: int = SAMPLE_ROWS) -> Cascade:
    """Estimate on at most `rows` texts, the least by a hash of the id, one row an id. Only ids are ranked; the texts of those
    follow and are measured where they are."""
    ids = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.lit(4), F.col(id_col)).alias("h")).distinct().sort("h", "id").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(ids.select("id")), "id", "left_semi")
    texts = texts.groupBy("id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = measure([t if isinstance(t, str) else None for t in batch["text"]])
            yield pd.DataFrame([(name, s, r, len(batch)) for name, (s, r) in found.items()], columns=["rule", "seconds", "rejected", "n"])

    sums = texts.mapInPandas(run, "rule string, seconds double, rejected long, n long").groupBy("rule").agg(F.sum("seconds").alias("s"), F.sum("rejected").alias("r"), F.sum("n").alias("n")).collect()
    return plan(sums[0]["n"] if sums else 0, {r["rule"]: (r["s"], r["r"]) for r in sums} if sums else dict.fromkeys(RULES, (0.0, 0)))


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


def judge(docs: DataFrame, cascade: Cascade, *, text_col="text", keep=None) -> DataFrame:
    """The columns `keep` of docs (all by default), the statistics, base_failed, kept, and the rule that rejected."""
    own = [c.split()[0] for c in SCHEMA.split(", ")]
    keep = [c for c in (docs.columns if keep is None else keep) if c not in own]

    @F.pandas_udf(SCHEMA)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = []
            for x in batch:
                t = Text(x)
                failed = base_failed(t)
                by = "base" if failed else cascade.verdict(t)
                rows.append((t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words, failed, by is None, by))
            yield pd.DataFrame(rows, columns=own)

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), run(F.col(text_col)).alias("own"))
    return packed.select("row.*", "own.*")
