"""N-gram Jaccard self-join with a token-group matrix.

A document is the set of its distinct word shingles; two documents link when intersection / union reaches the threshold.
Equal sets are one set with several documents. The steps:

1. One pass gives each document its set's size and fingerprint, and counts all shingles in a sketch of fixed width.
2. Shingles are ordered from rare to frequent by the sketch. Two sets that link have their first k common shingles among
   the first n - ceil(t n) + k of each. With k a quarter of the size, only those are dealt out to find the shingles that
   several sets share; a set that shares too few of them can't link with any other and is left.
3. Similar sets are put into groups: by the shared shingle that most sets hold, cut so that a group has a bounded number of
   members and shingles.
4. The token-group matrix (shingle, group) gives the pairs of groups that share a leading shingle and whose ranges of
   sizes allow a link.
5. Each group's token union is stored. For such a pair the union of one bounds how much a set of the other can share with any
   of its members; only sets that pass are opened, travel, and are compared, all at once, as a product of 0/1 matrices over
   common shingles, after the same bound from the other side.
6. Links are joined into components by alternating large-star and small-star rounds.

No step holds all documents of a group of copies, and nothing that grows with the corpus comes to the driver: the sketch
and the filter of surviving fingerprints have fixed sizes.

Edge cases: a text with fewer words than the width is one shingle, the whole sequence; null and empty texts have none and
link with nothing; rows with equal ids are separate documents; a null id never names a component unless all ids in it are
null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.session import partitions, work_table
from llm.textkernel import Words, blocks, encode, mix, shingles, thrifty

SKETCH_BITS = 20
SLICE = 1 << 16
TREE = 64
FILTER_BITS = 23
#: The dealt part holds the first common shingles of a link, the size over this number of them.
COMMON = 4
GROUP_SETS = 128
GROUP_TOKENS = 100_000
BLOCK = 1_000_000
FLUSH = 12_000_000


def text_sets(texts: list[bytes], width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct shingles of each text (bytes, words already in one case), sorted, and the set's fingerprint (0: empty)."""
    h, text, _ = shingles(Words(texts), width)
    cut = np.searchsorted(text, np.arange(len(texts) + 1))
    sets = [np.unique(h[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat + np.uint64(77)), dtype=np.uint64)))
    ends = np.cumsum(size)
    sid = mix((sums[ends] - sums[ends - size]) * np.uint64(31) + size.astype(np.uint64))
    sid[size == 0] = 0
    return sets, sid


def _prepared(batch: pd.DataFrame) -> Iterator[tuple[slice, list[bytes]]]:
    raw = [encode(t).lower() for t in batch["text"]]
    for part in blocks([len(t) + 1 for t in raw], BLOCK):
        yield part, raw[part]


def leading(n: int, num: int, den: int, common: int = 1) -> int:
    """Among how many of n ordered shingles the first `common` ones of any link lie: n - ceil(n num / den) + common."""
    return min(n, n - -(-n * num // den) + common)


def common(n: int) -> int:
    """How many common shingles the dealt part of a set of n is long enough for. Never falls with n."""
    return max(1, n // COMMON)


# ---------------------------------------------------------------- passes over the texts


def _survey(docs: DataFrame, width: int) -> tuple[DataFrame, np.ndarray]:
    """(id, n, sid) of every document, and the level of each place of the sketch, 0 to 255, rising with the count."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for part, raw in _prepared(batch):
                sets, sid = text_sets(raw, width)
                new = np.unique(sid, return_index=True)[1]
                flat = np.concatenate([sets[i] for i in new])
                counts += np.bincount((flat >> np.uint64(8)).astype(np.int64) & (len(counts) - 1), minlength=len(counts))
                yield pd.DataFrame({"id": batch["id"].iloc[part].to_numpy(), "n": [len(s) for s in sets], "sid": sid.astype(np.int64), "slice": -1, "task": 0, "body": None})
        task = TaskContext.get().partitionId()
        for k in range(0, len(counts), SLICE):
            if counts[k : k + SLICE].any():
                yield pd.DataFrame({"id": None, "n": 0, "sid": 0, "slice": [k // SLICE], "task": task, "body": [zlib.compress(counts[k : k + SLICE].tobytes(), 1)]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(SLICE, np.int64)
        for body in group["body"]:
            counts += np.frombuffer(zlib.decompress(body), np.int64)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "task": [group["task"].iloc[0] // TREE], "body": [zlib.compress(counts.tobytes(), 1)]})

    rows = docs.mapInPandas(thrifty(run), f"id {docs.schema['id'].dataType.simpleString()}, n long, sid long, slice int, task int, body binary")
    rows = work_table(rows, "survey")
    # Added up in a tree, `TREE` tasks' slices at a time, so no task reads more than that.
    sketch = rows.filter("slice >= 0").select("slice", "task", "body")
    tasks = sketch.agg(F.max("task")).first()[0] or 0
    while True:
        sketch = sketch.groupBy("slice", F.expr(f"task div {TREE}")).applyInPandas(lambda _, g: add(g), "slice int, task int, body binary")
        tasks //= TREE
        if not tasks:
            break
        sketch = work_table(sketch, "sketch")
    levels = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in sketch.collect():  # sixteen rows of half a MB at most
        counts = np.frombuffer(zlib.decompress(r["body"]), np.int64)
        levels[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.minimum(255, 4 * np.log2(counts + 1.0)).astype(np.uint8)
    return rows.filter("slice < 0").select("id", "n", "sid"), levels


def _shared(docs: DataFrame, levels: np.ndarray, width: int, num: int, den: int) -> DataFrame:
    """(sid, tok, c, shared): for each set and task, how many of its dealt shingles other sets have too, and, one a row, those
    of them that come first enough to be the first of a link, with the number of sets that have it."""
    bits = max(4, (2 * partitions(docs.sparkSession) - 1).bit_length())
    first_of_link = np.uint64(1 << 55)
    low = np.uint64((1 << 55) - 1)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toks, sids, size = [], [], 0

        def out() -> pd.DataFrame:
            tok, sid = np.concatenate(toks), np.concatenate(sids)
            bucket = (tok & np.uint64((1 << bits) - 1)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            tok, sid, bucket = tok[order], sid[order], bucket[order]
            first = np.flatnonzero(np.diff(bucket, prepend=-1))
            seven = np.ascontiguousarray(tok.view(np.uint8).reshape(-1, 8)[:, :7])
            ends = [*first[1:].tolist(), len(tok)]
            spans = list(zip(first.tolist(), ends, strict=True))
            return pd.DataFrame({"bucket": bucket[first], "toks": [seven[a:b].tobytes() for a, b in spans], "sids": [sid[a:b].tobytes() for a, b in spans]})

        for batch in batches:
            for _, raw in _prepared(batch):
                sets, sid = text_sets(raw, width)
                for i in np.unique(sid, return_index=True)[1]:
                    n = len(sets[i])
                    if n:
                        tok = sets[i] >> np.uint64(8)
                        key = (levels[tok.astype(np.int64) & (len(levels) - 1)].astype(np.uint64) << np.uint64(56)) | (tok & low)
                        one, most = leading(n, num, den), leading(n, num, den, common(n))
                        key = np.partition(key, [one - 1, most - 1])[:most] & low
                        key[:one] |= first_of_link
                        toks.append(key)
                        sids.append(np.full(most, sid[i]))
                size += sum(map(len, raw))
                if size > FLUSH and toks:
                    yield out()
                    toks, sids, size = [], [], 0
        if toks:
            yield out()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        seven = np.frombuffer(b"".join(group["toks"]), np.uint8).reshape(-1, 7)
        tok = np.zeros((len(seven), 8), np.uint8)
        tok[:, :7] = seven
        tok = tok.view(np.uint64).ravel()
        sid = np.frombuffer(b"".join(group["sids"]), np.uint64)
        order = np.argsort(tok & low, kind="stable")
        tok, sid = tok[order], sid[order]
        start = np.flatnonzero(np.diff(tok & low, prepend=(tok[0] & low) + np.uint64(1)))
        count = np.diff(np.append(start, len(tok)))
        many = np.repeat(count > 1, count)
        tok, sid = tok[many], sid[many]
        lead, tok = (tok & first_of_link) > 0, tok & low
        order = np.lexsort((sid, tok))
        tok, sid, lead = tok[order], sid[order], lead[order]
        new = np.ones(len(tok), bool)
        new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
        tok, sid, lead = tok[new], sid[new], lead[new]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(tok)), bool), tok[1:] != tok[:-1])))
        count = np.diff(np.append(start, len(tok)))
        c = np.repeat(count, count)
        keep = c > 1
        tok, sid, lead, c = tok[keep], sid[keep], lead[keep], c[keep]
        each, shared = np.unique(sid, return_counts=True)
        return pd.DataFrame({
            "sid": np.concatenate((sid[lead], each)).astype(np.int64),
            "tok": np.concatenate((tok[lead].astype(np.int64), np.zeros(len(each), np.int64))),
            "c": np.concatenate((c[lead], np.zeros(len(each), np.int64))),
            "shared": np.concatenate((np.zeros(int(lead.sum()), np.int64), shared)),
        })

    dealt = docs.mapInPandas(thrifty(deal), "bucket int, toks binary, sids binary")
    return work_table(dealt.groupBy("bucket").applyInPandas(meet, "sid long, tok long, c long, shared long"), "shared")


def _open_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(sid, body) of the wanted sets: their sorted shingles as bytes.

    A filter of fixed size over the fingerprints keeps most other sets from being dealt out; the join then is exact.
    """
    place = F.col("sid").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    words = wanted.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast((sid & {(1 << FILTER_BITS) - 1}) & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    mask = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in words.collect():  # at most 2**(FILTER_BITS - 6) rows
        mask[r["w"]] = np.int64(r["b"]).astype(np.uint64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, raw in _prepared(batch):
                sets, sid = text_sets(raw, width)
                at = sid.astype(np.int64) & ((1 << FILTER_BITS) - 1)
                hit = ((mask[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
                new = [i for i in np.unique(sid, return_index=True)[1] if hit[i] and len(sets[i])]
                if new:
                    yield pd.DataFrame({"sid": sid[new].astype(np.int64), "body": [sets[i].tobytes() for i in new]})

    found = docs.mapInPandas(thrifty(run), "sid long, body binary")
    return found.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.first("body").alias("body"))


# ---------------------------------------------------------------- groups


def compare(a: list[np.ndarray], b: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the sets of two groups that link.

    First the bound: what a set shares with the union of the other group; a set that can't reach the threshold with any
    member stays closed. Then the rest at once, over the shingles that both sides have.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    na, nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    union_a, union_b = (np.unique(np.concatenate(x)) for x in (a, b))
    common = np.intersect1d(union_a, union_b, assume_unique=True)
    if not len(common):
        return none

    def rows(sets: list[np.ndarray], sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        at = np.searchsorted(common, flat)
        at[at == len(common)] = 0
        hit = common[at] == flat
        shared = np.bincount(owner[hit], minlength=len(sets))
        opened = np.flatnonzero(den * shared >= num * np.maximum(sizes, least))
        return opened, at[hit], owner[hit]

    open_a, at_a, own_a = rows(a, na, int(nb.min()))
    open_b, at_b, own_b = rows(b, nb, int(na.min()))
    if not len(open_a) or not len(open_b):
        return none
    place = np.full(max(len(a), len(b)), -1)
    shared = np.zeros((len(open_a), len(open_b)), np.int64)
    for begin in range(0, len(common), 1 << 14):
        sides = []
        for opened, at, own in ((open_a, at_a, own_a), (open_b, at_b, own_b)):
            place[:] = -1
            place[opened] = np.arange(len(opened))
            keep = (at >= begin) & (at < begin + (1 << 14)) & (place[own] >= 0)
            m = np.zeros((len(opened), min(1 << 14, len(common) - begin)), np.float32)
            m[place[own[keep]], at[keep] - begin] = 1
            sides.append(m)
        shared += np.rint(sides[0] @ sides[1].T).astype(np.int64)
    total = na[open_a][:, None] + nb[open_b][None, :] - shared
    i, j = np.nonzero(den * shared >= num * total)
    return open_a[i], open_b[j]


def _unions(groups: DataFrame) -> DataFrame:
    """groups(g, m) with `tokens`, the union of the members' shingles by their upper halves, and `least`, the smallest size."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            tokens, least = [], []
            for ms in batch["m"]:
                sets = [np.frombuffer(m["body"], np.uint64) for m in ms]
                tokens.append(np.unique((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)).tobytes())
                least.append(min(map(len, sets)))
            yield pd.DataFrame({"g": batch["g"], "m": batch["m"], "tokens": tokens, "least": least})

    return groups.mapInPandas(thrifty(run), "g long, m array<struct<sid:long,copies:long,body:binary>>, tokens binary, least long")


def _qualified(asked: DataFrame, num: int, den: int) -> DataFrame:
    """(g2, sid, copies, body): members of a group that may link with some set of another, by the union of that.

    What a set shares with the union bounds what it shares with any member; halves of shingles only make it greater.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for us, ms in zip(batch["u"], batch["m"], strict=True):
                sets = [np.frombuffer(m["body"], np.uint64) for m in ms]
                size = np.array([len(x) for x in sets])
                flat, own = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.repeat(np.arange(len(sets)), size)
                for u in us:
                    union = np.frombuffer(u["tokens"], np.uint32)
                    at = np.searchsorted(union, flat)
                    at[at == len(union)] = 0
                    shared = np.bincount(own[union[at] == flat], minlength=len(sets))
                    hit = np.flatnonzero(den * shared >= num * np.maximum(size, u["least"])).tolist()
                    if hit:
                        yield pd.DataFrame({"g2": u["g2"], "sid": [ms[i]["sid"] for i in hit], "copies": [ms[i]["copies"] for i in hit], "body": [ms[i]["body"] for i in hit]})

    return asked.mapInPandas(thrifty(run), "g2 long, sid long, copies long, body binary")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place reachable from each of n places by the links i, j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _link(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """(sid, root, links): for sets with links in one pair of groups, the least set they reach there and their documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for same, ms, ns in zip(batch["same"], batch["m1"], batch["m2"], strict=True):
                one = [np.frombuffer(m["body"], np.uint64) for m in ms]
                two = one if same else [np.frombuffer(m["body"], np.uint64) for m in ns]
                i, j = compare(one, two, num, den)
                members = list(ms) if same else [*ms, *ns]
                if same:
                    i, j = i[i < j], j[i < j]
                else:
                    j = j + len(ms)
                if len(i):
                    sid = np.array([m["sid"] for m in members], np.int64)
                    copies = np.array([m["copies"] for m in members], np.int64)
                    order = np.argsort(sid)
                    rank = np.empty(len(sid), np.int64)
                    rank[order] = np.arange(len(sid))
                    root = sid[order][_roots(len(sid), rank[i], rank[j])][rank]
                    links = np.zeros(len(sid), np.int64)
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    has = links > 0
                    yield pd.DataFrame({"sid": sid[has], "root": root[has], "links": links[has]})

    return pairs.mapInPandas(thrifty(run), "sid long, root long, links long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(a, b) other than roots: root is the least node it can reach.

    Large-star rounds link every node's greater neighbours to its least one, small-star rounds its smaller ones, until the
    edges are stars.
    """
    now = work_table(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        now = work_table(small, "edges")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def join(docs: DataFrame, *, id_col="doc_id", text_col="text", width: int = 5, threshold=(75, 100)) -> DataFrame:
    """id, n_shingles, component_id and n_links of every row.

    component_id: the least id reachable by links, the row's own included; n_links: the other rows it links with.
    """
    num, den = threshold
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    members, levels = _survey(texts, width)
    sets = members.filter("sid != 0").groupBy("sid").agg(F.count("*").alias("copies"), F.min("id").alias("first"), F.first("n").alias("n"))
    shared = _shared(texts, levels, width, num, den)
    # A partner is at least n num / den in size, so its dealt part is long enough for so many common shingles.
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * num / den) / COMMON))
    keys = shared.groupBy("sid").agg(F.max(F.struct("c", "tok")).alias("k"), F.sum("shared").alias("shared"))
    keys = keys.join(sets.select("sid", "n"), "sid").filter(F.col("shared") >= least).select("sid", "n", F.col("k.tok").alias("key"))

    cut = keys.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / GROUP_SETS, F.sum("n") / GROUP_TOKENS)).alias("parts"))
    grouped = keys.join(cut, "key").select("sid", "n", F.xxhash64("key", F.pmod(F.xxhash64("sid"), "parts")).alias("g"))
    grouped = work_table(grouped, "groups")
    ranges = grouped.groupBy("g").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.sum("n").alias("w"))
    matrix = shared.filter("c > 0").select("tok", "sid").join(grouped.select("sid", "g"), "sid").select("tok", "g").distinct().join(ranges, "g")
    one, two = matrix.alias("x"), matrix.alias("y")
    # The group of fewer shingles is the one that travels.
    near = one.join(two, F.expr(f"x.tok = y.tok and (x.w, x.g) < (y.w, y.g) and {den} * x.high >= {num} * y.low and {den} * y.high >= {num} * x.low"))
    near = work_table(near.select(F.col("x.g").alias("g1"), F.col("y.g").alias("g2"), F.col("y.w").alias("w2")).distinct(), "pairs")
    alone = grouped.groupBy("g").count().filter("count > 1").select("g")

    # Groups that meet no other and have one member have nothing to compare.
    met = near.select(F.explode(F.array("g1", "g2")).alias("g")).union(alone).distinct()
    wanted = grouped.join(met, "g", "left_semi").select("sid", "g")
    full = _open_sets(texts, wanted.select("sid"), width).join(wanted, "sid").join(sets.select("sid", "copies"), "sid")
    full = work_table(_unions(full.groupBy("g").agg(F.collect_list(F.struct("sid", "copies", "body")).alias("m"))), "members")

    # A group's union travels to the smaller group of a pair, in parts of bounded size; only sets that pass its bound are
    # opened and go on to the other group.
    ask = near.join(full.select(F.col("g").alias("g2"), "tokens", "least"), "g2")
    parts = near.groupBy("g1").agg(F.ceil(F.sum("w2") / GROUP_TOKENS).alias("parts"))
    ask = ask.join(parts, "g1").groupBy("g1", F.pmod(F.xxhash64("g2"), "parts").alias("part")).agg(F.collect_list(F.struct("g2", "tokens", "least")).alias("u"))
    opened = work_table(_qualified(ask.join(full.select(F.col("g").alias("g1"), "m"), "g1").select("u", "m"), num, den), "opened")
    parts = opened.groupBy("g2").agg(F.ceil(F.sum(F.length("body") / 8) / GROUP_TOKENS).alias("parts"))
    sent = opened.join(parts, "g2").groupBy("g2", F.pmod(F.xxhash64("sid"), "parts").alias("part")).agg(F.collect_list(F.struct("sid", "copies", "body")).alias("m1"))
    across = sent.join(full.select(F.col("g").alias("g2"), F.col("m").alias("m2")), "g2").select(F.lit(False).alias("same"), "m1", "m2")
    inside = full.join(alone, "g", "left_semi").select(F.lit(True).alias("same"), F.col("m").alias("m1"), F.array().cast(full.schema["m"].dataType).alias("m2"))
    found = work_table(_link(across.union(inside), num, den), "links")

    stars = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.join(stars, F.col("sid") == F.col("node"), "left").select("sid", "copies", "first", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component"))
    info = named.join(least, "root").join(links, "sid", "left").select(F.col("sid").alias("s"), "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    rows = members.join(info, F.col("sid") == F.col("s"), "left")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
