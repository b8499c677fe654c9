"""Exact substring deduplication across documents with suffix arrays.

Every byte is removed that lies in a string of `width` bytes which also starts in a document of smaller id. Texts are judged
as they come in, so overlaps count and no removal depends on another.

1. Anchors. In every window of `width` bytes the 16-byte gram of least hash is its anchor; equal windows have equal
   anchors at equal places. The bytes that windows with one anchor can cover are its segment. Anchors are dealt out by hash
   with a fingerprint of their segment: where only one document has an anchor, no window is shared. Equal segments are
   collapsed first (within a task before anything is shuffled): all windows of a copy lie in the segment of the first
   document that has it, so they fall with it. Equal here means an equal anchor hash (52 bits and more) and an equal
   fingerprint of length, place and bytes (48 bits), by polynomial hashes; bytes are not compared, so of 2**50 segments two
   unlike ones would be taken for equal with a chance of about 1 in 2.
2. Shards. Segments that share an anchor but differ are cut out of the texts and gathered by anchor, in shards of bounded
   size. In a shard a suffix array is refined by doubling, sorting only groups that aren't settled yet (Larsson-Sadakane),
   and longest common prefixes follow by Kasai's scan, run for all segments side by side. Runs with a common prefix of at
   least `width` bytes are equal windows; the smallest id of a run is its first document.
3. Merging. Where an anchor's segments go on in the next shard, its windows are looked up there by binary search in the
   sorted windows carried over. Anchors with very many different segments are dealt out by window instead, so that no
   carried list grows without bound.

Ids are integers below 2**62; another type is a TypeError. Edge cases: null and empty texts have nothing to remove; a null id
counts as larger than all others, and null ids as equal; rows with equal ids never remove each other's bytes, and repeated
rows get equal answers; of strings that start in several documents (ties) the least id is the first; an empty table gives an
empty result; a very long text is read whole, in memory in proportion to it; other columns aren't read, so their names can't
clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.session import partitions, work_table
from llm.textkernel import blocks, encode, mix, strings

GRAM = 16
#: Rows without an id stand from here on, each text at a place of its own; they count as equal, and larger than all others.
LAST = 1 << 62
SHARD_SEGMENTS = 30_000
HOT_SEGMENTS = 20_000
BLOCK = 1_500_000
FLUSH = 20_000_000
_PLACES = mix(np.arange(501, 520, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOW48 = np.uint64((1 << 48) - 1)
FULL, NEED, HOT = 0, 1, 2


def rank(doc: np.ndarray) -> np.ndarray:
    """Ids as they are compared."""
    return np.minimum(doc, LAST)


def codes_of(key: np.ndarray, mark: np.ndarray, bits: int) -> np.ndarray:
    """61 bits of a segment's anchor and mark, by which a document is told what becomes of it."""
    code = (key >> np.uint64(bits)) & _LOW48  # both are well mixed already
    code *= _PLACES[0]
    code += mark * _PLACES[1]
    code >>= np.uint64(3)
    return code.view(np.int64)


class Anchors:
    """The anchors of a batch of texts: text, key (hash of the gram), begin and end of the segment in the buffer, mark."""

    def __init__(self, texts: list[bytes], width: int):
        self.buffer = np.frombuffer(b"".join(t + b"\0" for t in texts), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
        span = width - GRAM + 1
        gram = strings(self.buffer, GRAM)
        n = len(self.buffer) - width + 1
        none = np.zeros(0, np.int64)
        self.text = self.begin = self.end = none
        self.key = self.mark = np.zeros(0, np.uint64)
        if n < 1:
            return
        # Least by the upper half of the hash, then leftmost: the place fills the lower half.
        least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        step = 1
        while step * 2 <= span:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if span > step:
            least = np.minimum(least[: len(least) - (span - step)], least[span - step :])
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)[:n]
        text = np.repeat(np.arange(len(texts)), size + 1)[:n]
        inside = np.arange(n) <= (self.offset + size)[text] - width
        at, text = at[inside], text[inside]
        if not len(at):
            return
        new = np.concatenate(([True], at[1:] != at[:-1]))
        at, self.text = at[new], text[new]
        self.key = gram[at]
        self.begin = np.maximum(at - span + 1, self.offset[self.text])
        self.end = np.minimum(at + width, (self.offset + size)[self.text])
        length = self.end - self.begin
        mark = (length * 128 + (at - self.begin)).astype(np.uint64) * _PLACES[-1]
        for k in range(-(-(2 * width - GRAM) // GRAM)):
            mark += gram[self.begin + np.minimum(GRAM * k, length - GRAM)] * _PLACES[k]
        self.mark = mix(mark) & _LOW48


def _batches(batch: pd.DataFrame) -> Iterator[tuple[slice, list[bytes]]]:
    raw = [encode(t) for t in batch["text"]]
    for part in blocks([len(t) + 1 for t in raw], BLOCK):
        yield part, raw[part]


# ---------------------------------------------------------------- 1. anchors


def _firsts(key: np.ndarray, mark: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key, mark and document, and whether an entry has a smaller document before it in its group."""
    order = np.lexsort((doc, mark, key))
    key, mark, doc = key[order], mark[order], doc[order]
    start = np.ones(len(key), bool)
    start[1:] = (key[1:] != key[:-1]) | (mark[1:] != mark[:-1])
    first = doc[np.flatnonzero(start)][np.cumsum(start) - 1] if len(key) else doc
    return order, rank(doc) > rank(first)


def _bits(texts: DataFrame) -> int:
    return max(4, (2 * partitions(texts.sparkSession) - 1).bit_length())


def _verdicts(texts: DataFrame, width: int) -> DataFrame:
    """(doc, code): for each anchor that documents share, `codes_of` it * 4 + FULL, NEED or HOT."""
    bits = _bits(texts)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple] = []
        size = 0

        def out() -> pd.DataFrame:
            key, mark, doc = (np.concatenate(x) for x in zip(*parts, strict=True))
            bucket = (key & np.uint64((1 << bits) - 1)).astype(np.int32)
            order, copy = _firsts(key, mark, doc)
            bucket, key, mark, doc = bucket[order], key[order], mark[order], doc[order]
            lost = [(bucket[copy], codes_of(key[copy], mark[copy], bits).view(np.uint64), doc[copy])]
            again = np.zeros(len(key), bool)
            again[1:] = (key[1:] == key[:-1]) & (mark[1:] == mark[:-1])
            keep = ~copy & ~again
            rows: dict[int, dict] = {}
            for name, (b, m, d, k) in {"": (bucket[keep], mark[keep], doc[keep], key[keep]), "lost_": (*(np.concatenate(x) for x in zip(*lost, strict=True)), None)}.items():
                o = np.argsort(b, kind="stable")
                b, m, d = b[o], m[o], d[o]
                first = np.flatnonzero(np.diff(b, prepend=-1))
                for x, y in zip(first.tolist(), np.append(first[1:], len(b)).tolist(), strict=False):
                    row = rows.setdefault(int(b[x]), {"bucket": int(b[x]), "keys": b"", "marks": b"", "docs": b"", "lost_marks": b"", "lost_docs": b""})
                    row[name + "marks"] = np.ascontiguousarray(m[x:y].view(np.uint8).reshape(-1, 8)[:, : 6 if k is not None else 8]).tobytes()
                    row[name + "docs"] = _pack(d[x:y])
                    if k is not None:
                        row["keys"] = np.ascontiguousarray((k[o][x:y] >> np.uint64(bits)).view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
            return pd.DataFrame(list(rows.values()), columns=["bucket", "keys", "marks", "docs", "lost_marks", "lost_docs"])

        for batch in batches:
            ids = batch["id"].to_numpy(np.int64)
            for part, raw in _batches(batch):
                a = Anchors(raw, width)
                if len(a.key):
                    parts.append((a.key, a.mark, ids[part][a.text]))
                size += sum(map(len, raw))
                if size > FLUSH and parts:
                    yield out()
                    parts, size = [], 0
        if parts:
            yield out()

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        key, mark = _six(group["keys"]), _six(group["marks"])
        doc = _unpack(group["docs"])
        lost, lost_doc = np.frombuffer(b"".join(map(bytes, group["lost_marks"])), np.int64), _unpack(group["lost_docs"])
        sort = np.argsort(key, kind="stable")
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[sort][1:] != key[sort][:-1])))
        count = np.diff(np.append(start, len(key)))
        many = sort[np.repeat(count > 1, count)]
        key, mark, doc = key[many], mark[many], doc[many]
        order, copy = _firsts(key, mark, doc)
        key, mark, doc = key[order], mark[order], doc[order]
        again = np.zeros(len(key), bool)
        again[1:] = (key[1:] == key[:-1]) & (mark[1:] == mark[:-1])
        lead = ~copy & ~again  # the first document of each segment
        k, m, d = key[lead], mark[lead], doc[lead]
        start = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
        count = np.diff(np.append(start, len(k)))
        if len(k):
            least, most = np.minimum.reduceat(d, start), np.maximum.reduceat(d, start)
            need = np.repeat((count > 1) & (rank(least) < rank(most)), count)
            kind = np.where(np.repeat(count, count) > HOT_SEGMENTS, HOT, NEED)[need]
        else:
            need, kind = np.zeros(0, bool), np.zeros(0, np.int64)
        docs = np.concatenate((doc[copy], lost_doc, d[need]))
        # Keys come without their lowest bits, which are the bucket's.
        code = lambda a, b: codes_of(a << np.uint64(bits), b, bits)
        codes = np.concatenate((code(key[copy], mark[copy]) * 4 + FULL, lost * 4 + FULL, code(k[need], m[need]) * 4 + kind))
        return pd.DataFrame({"doc": docs, "code": codes})

    dealt = texts.mapInPandas(deal, "bucket int, keys binary, marks binary, docs binary, lost_marks binary, lost_docs binary")
    return dealt.groupBy("bucket").applyInPandas(meet, "doc long, code long")


def _pack(docs: np.ndarray) -> bytes:
    """Ids as 4-byte steps from the least where they fit, else whole."""
    low = int(docs.min()) if len(docs) else 0
    if len(docs) and int(docs.max()) - low < 1 << 32:
        return b"\x04" + low.to_bytes(8, "little", signed=True) + (docs - low).astype(np.uint32).tobytes()
    return b"\x08" + bytes(8) + docs.tobytes()


def _unpack(bodies: pd.Series) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for b in bodies:
        b = bytes(b)
        if b:
            out.append(np.frombuffer(b, np.uint32, offset=9).astype(np.int64) + int.from_bytes(b[1:9], "little", signed=True) if b[0] == 4 else np.frombuffer(b, np.int64, offset=9))
    return np.concatenate(out)


def _six(bodies: pd.Series) -> np.ndarray:
    six = np.frombuffer(b"".join(map(bytes, bodies)), np.uint8).reshape(-1, 6)
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :6] = six
    return out.view(np.uint64).ravel()


# ---------------------------------------------------------------- 2. shards


def suffix_array(rows: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Order of all suffixes of at least `width` bytes, as places row * columns + column.

    rows: zero-padded byte strings. Starts from the order by eight bytes; each round doubles the depth by sorting, within
    the groups not settled yet, by the rank of what follows. Equal suffixes stay in row order.
    """
    m, wide = rows.shape
    padded = np.zeros((m, wide + 8), np.uint8)
    padded[:, :wide] = rows
    word = np.zeros((m, wide), np.uint64)
    for k in range(8):
        word <<= np.uint64(8)
        word |= padded[:, k : k + wide]
    alive = (np.arange(wide)[None, :] < length[:, None]).ravel()
    place = np.flatnonzero(alive).astype(np.int32)
    value = word.ravel()[place]
    if (rows.ravel()[place] == 0).any():
        # A zero byte looks like the padding of a shorter suffix; what is left of each tells them apart.
        left = np.minimum(8, (length[:, None] - np.arange(wide)[None, :]).ravel()[place])
        order = np.lexsort((left, value))
        value, left = value[order], left[order]
        starts = np.concatenate(([True], (value[1:] != value[:-1]) | (left[1:] != left[:-1])))
    else:
        order = np.argsort(value)
        value = value[order]
        starts = np.concatenate(([True], value[1:] != value[:-1]))
    place = place[order]
    rank = np.zeros(m * wide + 1, np.int32)  # 0: beyond the end
    head = np.flatnonzero(starts)
    size = np.diff(np.append(head, len(place)))
    rank[place] = np.repeat(head + 1, size)
    open_ = np.flatnonzero(np.repeat(size > 1, size))
    beyond = np.int32(m * wide)
    depth = 8
    while depth < wide and len(open_):
        who = place[open_]
        follow = rank[np.where(who % wide + depth < wide, who + depth, beyond)]
        key = (rank[who].astype(np.uint64) << np.uint64(32)) | follow.astype(np.uint64)
        o = np.argsort(key)
        who, key = who[o], key[o]
        place[open_] = who
        starts = np.concatenate(([True], key[1:] != key[:-1]))
        head = np.flatnonzero(starts)
        size = np.diff(np.append(head, len(who)))
        rank[who] = np.repeat(open_[head] + 1, size)
        open_ = open_[np.repeat(size > 1, size)]
        depth *= 2
    if len(open_):  # equal to their ends: in row order
        who = place[open_]
        place[open_] = who[np.argsort((rank[who].astype(np.uint64) << np.uint64(32)) | who.astype(np.uint64))]
    return place[place % wide <= (length - width)[place // wide]].astype(np.int64)


def common_prefixes(rows: np.ndarray, length: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order (0 for the first), by Kasai's scan.

    All rows go along side by side: at each column a row keeps one byte less of the prefix it had, unless the neighbour
    has no next suffix, and extends it.
    """
    m, wide = rows.shape
    flat = rows.ravel()
    before = np.full(m * wide, -1)
    before[order[1:]] = order[:-1]
    out = np.zeros(m * wide, np.int64)
    h, usable = np.zeros(m, np.int64), np.zeros(m, bool)
    for column in range(int((length - width).max()) + 1 if m else 0):
        here = np.arange(m) * wide + column
        has = (column <= length - width) & (before[here] >= 0)
        h = np.where(usable, np.maximum(h - 1, 0), 0)
        h[~has] = 0
        r = np.flatnonzero(has)
        mine, other = here[r], before[here[r]]
        most = np.minimum(length[r] - column, length[other // wide] - other % wide)
        g = np.minimum(h[r], most)
        going = np.arange(len(r))
        while len(going):
            going = going[g[going] < most[going]]
            going = going[flat[mine[going] + g[going]] == flat[other[going] + g[going]]]
            g[going] += 1
        h[r] = g
        out[here] = h
        usable = np.zeros(m, bool)
        usable[r] = other % wide + 1 <= (length - width)[other // wide]
    return out[order]


def _sieve(rows: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    """Which rows have a window whose hash another window of the shard has too; the others have no equal window."""
    wide = rows.shape[1]
    h = strings(rows.ravel(), width)
    place = np.flatnonzero(np.arange(len(h)) % wide <= np.repeat(length - width, wide)[: len(h)])
    order = np.argsort(h[place])
    h = h[place][order]
    equal = h[1:] == h[:-1]
    twice = np.concatenate((equal, [False])) | np.concatenate(([False], equal))
    keep = np.zeros(len(rows), bool)
    keep[place[order[twice]] // wide] = True
    return keep


def covered(rows: np.ndarray, length: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column) of windows that a smaller document has too, and the sorted places of all windows."""
    order = suffix_array(rows, length, width)
    if not len(order):
        return order, order, order
    lcp = common_prefixes(rows, length, order, width)
    start = np.flatnonzero(lcp < width)
    least = np.minimum.reduceat(doc[order // rows.shape[1]], start)
    lost = rank(doc[order // rows.shape[1]]) > np.repeat(rank(least), np.diff(np.append(start, len(order))))
    return order[lost] // rows.shape[1], order[lost] % rows.shape[1], order


def _runs(doc: np.ndarray, row: np.ndarray, at: np.ndarray, width: int) -> pd.DataFrame:
    """Windows as maximal byte runs of each row."""
    o = np.lexsort((at, row, doc))
    doc, row, at = doc[o], row[o], at[o]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (at[1:] > at[:-1] + width)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1 if len(doc) else first
    return pd.DataFrame({"doc": doc[first], "row": row[first], "begin": at[first], "end": at[last] + width})


def _shards(segments: DataFrame, width: int) -> DataFrame:
    """segments(key, doc, row, at, body) -> (doc, row, begin, end): bytes that a smaller document has too.

    row tells rows of one id apart.
    """

    def windows(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        wide = rows.shape[1]
        return np.ascontiguousarray(rows.ravel()[places[:, None] + np.arange(width)[None, :]]).view(f"S{width}").ravel() if wide else np.zeros(0, f"S{width}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried: tuple[int, np.ndarray, np.ndarray] | None = None  # an anchor, its sorted windows, their first documents
        rest: pd.DataFrame | None = None

        def shard(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal carried
            bodies = [bytes(b) for b in part["body"]]
            length = np.fromiter(map(len, bodies), np.int64, len(bodies))
            wide = int(length.max())
            rows = np.frombuffer(b"".join(b.ljust(wide, b"\0") for b in bodies), np.uint8).reshape(-1, wide)
            key, doc, row, at = (part[c].to_numpy(np.int64) for c in ("key", "doc", "row", "at"))
            keep = _sieve(rows, length, width) | (key == key[0]) | (key == key[-1])
            rows, length, key, doc, row, at = rows[keep], length[keep], key[keep], doc[keep], row[keep], at[keep]
            r, c, order = covered(rows, length, doc, width)
            found = [(doc[r], row[r], at[r] + c)]
            if carried is not None and carried[0] == key[0]:
                mine = order[key[order // wide] == key[0]]
                w = windows(rows, mine)
                p = np.searchsorted(carried[1], w)
                p[p == len(carried[1])] = 0
                hit = (carried[1][p] == w) & (rank(carried[2][p]) < rank(doc[mine // wide]))
                found.append((doc[mine[hit] // wide], row[mine[hit] // wide], at[mine[hit] // wide] + mine[hit] % wide))
            last = int(key[-1])
            mine = order[key[order // wide] == last]
            w, d = windows(rows, mine), doc[mine // wide]
            if carried is not None and carried[0] == last:
                w, d = np.concatenate((carried[1], w)), np.concatenate((carried[2], d))
            o = np.lexsort((d, w))
            w, d = w[o], d[o]
            new = np.ones(len(w), bool)
            new[1:] = w[1:] != w[:-1]
            carried = (last, w[new], d[new])
            lost = [np.concatenate(x) for x in zip(*found, strict=True)]
            if len(lost[0]):
                yield _runs(*lost, width)

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            while len(rest) >= SHARD_SEGMENTS:
                yield from shard(rest.iloc[:SHARD_SEGMENTS])
                rest = rest.iloc[SHARD_SEGMENTS:]
        if rest is not None and len(rest):
            yield from shard(rest)

    n = partitions(segments.sparkSession)
    dealt = segments.repartition(n, "key").sortWithinPartitions("key", "doc", "at")
    return dealt.mapInPandas(run, "doc long, row long, begin long, end long")


# ---------------------------------------------------------------- the operator


def dedup(docs: DataFrame, *, id_col="doc_id", text_col="text", width: int = 50, text_out: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and spans (removed byte runs) of every row.

    With text_out also kept_bytes, the bytes that are left.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    ident, text = F.col(id_col).cast("long"), F.col(text_col)
    ident = F.when(ident >= LAST, F.raise_error(F.lit("ids must be below 2**62")).cast("long")).otherwise(ident)
    texts = docs.select(F.coalesce(ident, F.lit(LAST) + F.xxhash64(text).bitwiseAND(F.lit(LAST - 1))).alias("id"), text.alias("text"), F.xxhash64(text).alias("row"))
    bits = _bits(texts)
    verdicts = work_table(_verdicts(texts.select("id", "text"), width), "verdicts")
    codes = verdicts.groupBy("doc").agg(F.collect_set("code").alias("codes"), F.max(F.expr("code & 3")).alias("most"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, raw in _batches(batch):
                a = Anchors(raw, width)
                sub = batch.iloc[part]
                ids, own = sub["id"].to_numpy(np.int64), sub["row"].to_numpy(np.int64)
                edge = np.searchsorted(a.text, np.arange(len(raw) + 1))
                rows = []
                for i, codes in enumerate(sub["codes"]):
                    codes = np.asarray(codes, np.int64)
                    mark = codes_of(a.key[edge[i] : edge[i + 1]], a.mark[edge[i] : edge[i + 1]], bits)
                    for kind in (NEED, HOT):
                        wanted = codes[codes & 3 == kind] >> 2
                        if not len(wanted):
                            continue
                        for k in np.flatnonzero(np.isin(mark, wanted)) + edge[i]:
                            b, e, o = int(a.begin[k]), int(a.end[k]), int(a.offset[i])
                            body = raw[i][b - o : e - o]
                            if kind == NEED:
                                rows.append((int(a.key[k].astype(np.int64)), ids[i], own[i], b - o, body))
                            else:
                                h = strings(np.frombuffer(body, np.uint8), width).astype(np.int64)
                                rows.extend((int(h[j]), ids[i], own[i], b - o + j, body[j : j + width]) for j in range(len(h)))
                if rows:
                    yield pd.DataFrame(rows, columns=["key", "doc", "row", "at", "body"])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<array<long>>" + ", kept_bytes binary" * text_out

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for part, raw in _batches(batch):
                sub = batch.iloc[part]
                has = [i for i, c in enumerate(sub["codes"]) if c is not None and len(c)]
                a = Anchors([raw[i] for i in has], width) if has else None
                edge = np.searchsorted(a.text, np.arange(len(has) + 1)) if has else None
                where = {i: k for k, i in enumerate(has)}
                for i, (ident, own, codes, runs) in enumerate(zip(sub["id"], sub["row"], sub["codes"], sub["runs"], strict=True)):
                    t = raw[i]
                    begins, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                    if i in where:
                        s = slice(edge[where[i]], edge[where[i] + 1])
                        codes = np.asarray(codes, np.int64)
                        full = np.isin(codes_of(a.key[s], a.mark[s], bits), codes[codes & 3 == FULL] >> 2)
                        begins.append((a.begin[s] - a.offset[where[i]])[full])
                        ends.append((a.end[s] - a.offset[where[i]])[full])
                    if runs is not None and len(runs):
                        flat = np.array([(r["begin"], r["end"]) for r in runs if r["row"] == own], np.int64).reshape(-1, 2)
                        begins.append(flat[:, 0])
                        ends.append(flat[:, 1])
                    spans = _union(np.concatenate(begins), np.concatenate(ends))
                    kept, at = [], 0
                    for b, e in spans:
                        kept.append(t[at:b])
                        at = e
                    kept = b"".join([*kept, t[at:]])
                    row = (ident, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans)
                    out.append((*row, kept) if text_out else row)
                    if len(out) >= 1000:
                        yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
                        out = []
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    judged = texts.join(codes, F.col("id") == F.col("doc"), "left").select("id", "row", "text", "codes", "most")
    segments = judged.filter(F.col("most") > 0).select("id", "row", "text", "codes").mapInPandas(cut, "key long, doc long, row long, at long, body binary")
    runs = _shards(segments, width).groupBy("doc").agg(F.collect_list(F.struct("row", "begin", "end")).alias("runs"))
    done = judged.join(runs, F.col("id") == F.col("doc"), "left").select("id", "row", "text", "codes", "runs").mapInPandas(finish, schema)
    return done.withColumn("id", F.when(F.col("id") < LAST, F.col("id"))).withColumnRenamed("id", id_col)


def _union(begin: np.ndarray, end: np.ndarray) -> list[list[int]]:
    """Overlapping or touching runs joined."""
    if not len(begin):
        return []
    o = np.argsort(begin, kind="stable")
    begin, end = begin[o], np.maximum.accumulate(end[o])
    new = np.concatenate(([True], begin[1:] > end[:-1]))
    first = np.flatnonzero(new)
    return [[int(b), int(e)] for b, e in zip(begin[first], end[np.append(first[1:], len(begin)) - 1], strict=True)]
