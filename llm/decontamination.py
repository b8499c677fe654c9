"""Benchmark decontamination with SimHash over item-sized windows.

For every benchmark item, windows of as many words as the item has slide over each text, word by word; a text of fewer words
is one window, the whole of it. A window and an item are bags of 5-word shingles. A window gets a SimHash of 128 bits of its
weighted shingles. A multi-index over the items' fingerprints cuts them into eight blocks of 16 bits: of two fingerprints
within 31 bits, some block differs in three bits at most, so looking up, for each block, all values within three bits
guarantees every item within the radius. Of unrelated fingerprints one in twelve gets past the blocks, and none past the
whole distance. What is left is verified by the exact weighted similarity: the sum of the lesser weights over the sum of the
greater ones, at least 0.75.

A window can reach 0.75 only with three quarters of an item's shingles in it, so windows with fewer shingles known from
items of their size get no fingerprint; that loses nothing. The fingerprint step can: at a similarity of just 0.75 the
expected distance is 22 bits with a deviation of 4.3, so about one in 70 such pairs lies beyond 31, at 0.8 one in 600; exact
copies are at 0. A document has several windows near its best one, so fewer items are lost than pairs.

Items are a stated query set, indexed as flat arrays (about half a KB an item) that are broadcast; `ITEMS` of them, a bounded
size, go with one pass over the texts, and more of them take more passes.

Edge cases: items and texts that are null, empty or without words have no hits, and an empty benchmark or table gives no
rows; an item of fewer than five words is one shingle, its whole sequence; items with equal texts are all reported; repeated
rows get equal hits; of equally similar windows the first counts; very long texts are gone through whole; only the id and
the text of a document are read for `find`, and `clean` gives back all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.textkernel import _PLACES, Words, blocks, encode, mix

WIDTH = 5
BITS = 128
KEYS = 8
FLIPS = 3
#: Some of the blocks of two fingerprints within this distance differ in FLIPS bits at most.
RADIUS = KEYS * (FLIPS + 1) - 1
ITEMS = 100_000
BLOCK = 1_500_000
_BITS = np.arange(64, dtype=np.uint64)
#: All values of 16 bits with FLIPS bits set at most.
_BALL = np.array([sum(1 << b for b in c) for k in range(FLIPS + 1) for c in combinations(range(16), k)], np.int64)


def folded(text: str | None) -> bytes:
    """Bytes of a text in lower case, letters beyond ASCII too."""
    return encode(text.lower()) if isinstance(text, str) else b""


def _runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` word hashes."""
    n = len(words) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(width if n > 0 else 0):
        out += words[j : j + n] * _PLACES[j]
    return mix(out + np.uint64(width))


def _runs_at(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hash of the run of WIDTH word hashes at each place."""
    out = np.zeros(len(at), np.uint64)
    for j in range(WIDTH):
        out += words[at + j] * _PLACES[j]
    return mix(out + np.uint64(WIDTH))


def _signs(hashes: np.ndarray) -> np.ndarray:
    both = np.stack((hashes, mix(hashes + np.uint64(0x5851F42D4C957F2D))), axis=1)
    return ((((both[:, :, None] >> _BITS) & np.uint64(1)).astype(np.int32) << 1) - 1).reshape(len(hashes), BITS)


def _pack(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0).astype(np.uint64).reshape(len(sums), BITS // 64, 64) << _BITS).sum(axis=2, dtype=np.uint64)


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Bit by bit the sign of the sum over shingles, each as often as it occurs; two words of 64 bits."""
    return _pack(_signs(hashes).sum(axis=0)[None, :])[0]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of fingerprints."""
    return np.bitwise_count(a ^ b).sum(axis=1)


def similarity(a: Counter, b: Counter) -> float:
    """Sum of the lesser weights over the sum of the greater ones."""
    low = sum(min(n, b[x]) for x, n in a.items() if x in b)
    return low / (sum(a.values()) + sum(b.values()) - low)


class Index:
    """The items of one pass: a multi-index over the fingerprints of their different bags, and what is known by size."""

    class Size:
        def __init__(self, m: int, items: list[int], known: np.ndarray):
            self.words, self.width, self.items, self.known = m, min(m, WIDTH), items, known

    def __init__(self, items: list[tuple[object, str | None]], threshold: float):
        self.threshold = threshold
        same: dict[tuple[int, bytes], list] = defaultdict(list)
        by_size = defaultdict(list)
        for ident, text in items:
            h = Words([folded(text)]).hash
            if len(h):
                runs = np.sort(_runs(h, min(len(h), WIDTH)))
                same[len(h), runs.tobytes()].append(ident)
        self.ids, bags = list(same.values()), []
        for k, (m, body) in enumerate(same):
            bags.append(np.frombuffer(body, np.uint64))
            by_size[m].append(k)
        self.bag = np.concatenate(bags) if bags else np.zeros(0, np.uint64)
        self.edge = np.cumsum([0, *map(len, bags)])
        self.size = np.array([m for m, _ in same], np.int64)
        self.prints = np.array([simhash(b) for b in bags], np.uint64).reshape(-1, BITS // 64)
        blocks_ = self.prints.view(np.uint16).reshape(-1, KEYS)
        # For each block the items by its value, and where each value begins.
        self.order = [np.argsort(blocks_[:, k], kind="stable").astype(np.int32) for k in range(KEYS)]
        self.start = [np.searchsorted(blocks_[self.order[k], k], np.arange((1 << 16) + 1)).astype(np.int32) for k in range(KEYS)]
        self.sizes = [Index.Size(m, v, np.unique(np.concatenate([bags[i] for i in v]))) for m, v in sorted(by_size.items())]
        full = [s.known for s in self.sizes if s.width == WIDTH]
        self.any = np.unique(np.concatenate(full)) if full else np.zeros(0, np.uint64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.any >> np.uint64(44)).astype(np.int64)] = True
        self.short = [s for s in self.sizes if s.width < WIDTH]
        self.long = [s for s in self.sizes if s.width == WIDTH]

    def probe(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs that have a block within FLIPS bits, each once, in order."""
        values = np.ascontiguousarray(prints).view(np.uint16).reshape(-1, KEYS).astype(np.int64)
        rows, items = [], []
        for k in range(KEYS):
            near = (values[:, k][:, None] ^ _BALL).ravel()
            first = self.start[k][near]
            count = self.start[k][near + 1] - first
            hit = np.flatnonzero(count)
            count, first = count[hit].astype(np.int64), first[hit].astype(np.int64)
            at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows.append(np.repeat(hit // len(_BALL), count))
            items.append(self.order[k][at])
        n = max(1, len(self.ids))
        pairs = np.unique(np.concatenate(rows) * n + np.concatenate(items))
        return pairs // n, pairs % n

    def near(self, prints: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprint, item) pairs within RADIUS, of items with so many words."""
        found = []
        for at in range(0, len(prints), 256):
            w, k = self.probe(prints[at : at + 256])
            keep = self.size[k] == words
            w, k = w[keep] + at, k[keep]
            keep = distance(prints[w], self.prints[k]) <= RADIUS
            found.append((w[keep], k[keep]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def hits(self, words: np.ndarray) -> list[tuple[object, float, int, int]]:
        """(item, similarity, first word, words) of every item that a text has a window for, the best window of each."""
        out = []
        runs = _runs(words, WIDTH)
        maybe = np.flatnonzero(np.isin(runs, self.any))
        if len(maybe):
            for s in self.long:
                out += self._windows(s, runs, maybe[np.isin(runs[maybe], s.known)])
        for s in self.short:
            own = _runs(words, s.width)
            out += self._windows(s, own, np.flatnonzero(np.isin(own, s.known)))
        return out

    def likely(self, words: Words) -> np.ndarray:
        """The texts of a batch with a run of words that an item has; the others have no hits."""
        if self.short:
            return np.flatnonzero(words.count)
        at = np.flatnonzero(self.sieve[(_runs(words.hash, WIDTH) >> np.uint64(44)).astype(np.int64)])
        at = at[np.isin(_runs_at(words.hash, at), self.any)]
        at = at[words.text[at] == words.text[at + WIDTH - 1]]
        return np.unique(words.text[at])

    def _windows(self, s: Index.Size, runs: np.ndarray, at: np.ndarray) -> list[tuple[object, float, int, int]]:
        span = s.words - s.width + 1
        if not len(at):
            return []
        wide = min(span, len(runs))  # a text shorter than the items is one window
        near = np.zeros(len(runs) - wide + 2, np.int32)
        np.add.at(near, np.maximum(at - wide + 1, 0), 1)
        np.add.at(near, np.minimum(at + 1, len(near) - 1), -1)
        starts = np.flatnonzero(np.cumsum(near)[:-1] >= self.threshold * span)
        best: dict[int, tuple[float, int]] = {}
        for begin in range(0, len(starts), 4096):
            part = starts[begin : begin + 4096]
            low, high = int(part[0]), int(part[-1]) + wide
            # Windows far apart are summed one by one, close ones from running sums.
            if high - low <= 8 * len(part) + 20_000:
                sums = np.concatenate((np.zeros((1, BITS), np.int32), np.cumsum(_signs(runs[low:high]), axis=0, dtype=np.int32)))
                prints = _pack(sums[part - low + wide] - sums[part - low])
            else:
                prints = np.array([simhash(runs[i : i + wide]) for i in part], np.uint64)
            window, bag = -1, Counter()
            for w, k in zip(*(x.tolist() for x in self.near(prints, s.words)), strict=True):
                start = int(part[w])
                if window != w:
                    window, bag = w, Counter(runs[start : start + wide].tolist())
                score = similarity(bag, Counter(self.bag[self.edge[k] : self.edge[k + 1]].tolist()))
                if score >= self.threshold and score > best.get(k, (0.0, 0))[0]:
                    best[k] = (score, start)
        return [(i, score, start, wide + s.width - 1) for k, (score, start) in sorted(best.items()) for i in self.ids[k]]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, threshold: float) -> Iterator[Index]:
    """An index for each block of items."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    n = items.count()
    parts = max(1, -(-n // ITEMS))
    for k in range(parts):
        block = items if parts == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(parts)) == k)
        yield Index([(r["item"], r["text"]) for r in block.collect()], threshold)


def _hits(spark, index: Index, item_type: str):
    schema = f"items array<{item_type}>, similarities array<double>, starts array<int>, sizes array<int>"
    shared = spark.sparkContext.broadcast(index)  # flat arrays of at most ITEMS items

    @F.pandas_udf(schema)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for batch in texts:
            rows = []
            raw = [folded(t) for t in batch]
            for part in blocks([len(t) + 1 for t in raw], BLOCK):
                words = Words(raw[part])
                found = [((), (), (), ())] * len(words.count)
                for i in index.likely(words).tolist():
                    hits = index.hits(words.hash[words.first[i] : words.first[i + 1]])
                    found[i] = tuple([h[k] for h in hits] for k in range(4))
                rows += found
            yield pd.DataFrame(rows[: len(batch)], columns=["items", "similarities", "starts", "sizes"])

    return run.asNondeterministic()  # a filter on its result must not run it again


def find(docs: DataFrame, benchmark: DataFrame, *, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", threshold: float = 0.75) -> DataFrame:
    """One row for each text and item in it: id, item, similarity, start_word and n_words of the best window."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    out = None
    for index in _blocks(benchmark, item_col, item_text_col, threshold):
        hits = docs.select(F.col(id_col).alias("id"), _hits(docs.sparkSession, index, item_type)(F.col(text_col)).alias("h")).filter(F.size("h.items") > 0)
        rows = hits.select("id", F.explode(F.arrays_zip("h.items", "h.similarities", "h.starts", "h.sizes")).alias("x"))
        rows = rows.select(F.col("id").alias(id_col), F.col("x.items").alias(item_col), F.col("x.similarities").alias("similarity"), F.col("x.starts").alias("start_word"), F.col("x.sizes").alias("n_words"))
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col="text", item_col="item_id", item_text_col="text", threshold: float = 0.75) -> DataFrame:
    """The rows of docs whose texts hold no item."""
    item_type = benchmark.schema[item_col].dataType.simpleString()
    columns = [F.col(f"`{c}`") for c in docs.columns]
    for index in _blocks(benchmark, item_col, item_text_col, threshold):
        packed = docs.select(F.struct(*columns).alias("row"), F.size(_hits(docs.sparkSession, index, item_type)(F.col(text_col)).getField("items")).alias("n"))
        docs = packed.filter("n = 0").select("row.*")
    return docs
