"""Token ids in a content-addressed store.

A document's ids (with an end id) form a stream that a rolling hash of the last 32 ids cuts into chunks; a chunk is
addressed by the hash of its bytes and stored once, however many documents hold it. A document is a recipe: the addresses
of its chunks in order. Recipes are kept in ascending id order with the number of ids before each document. A Merkle manifest
holds hash-tree roots over blocks of recipes, over blocks of those roots, and so on up to one root for the whole corpus.

Files under the store's path: `format` (width of an id in bytes, end id, chunk rule), `parts/kind=chunk` (address, ids as
little-endian unsigned integers of that width), `parts/kind=recipe` (as encoded), `recipes` (doc_id, start, n_tokens,
addresses, place), `manifest` (level, block, number of leaves, root).

Reading goes through the files alone: recipes must hash to the manifest, chunks are hashed again and must match their
addresses, then documents are put together, or only their checksums and counts are, from those of their chunks' bytes.

Ids are integers; another type is a TypeError. Edge cases: null and empty texts are the end id alone; rows with equal ids
are kept apart and stand next to each other, by number of ids and addresses, and equal rows (ties) by occurrence; null ids
come first; an empty table gives an empty store; columns other than id and text aren't read, so their names can't clash. A
very long text is encoded whole, in memory in proportion to it; its chunks travel one by one.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.ordering import running
from llm.session import partitions, work_path
from llm.textkernel import blocks, mix, thrifty

END_ID = 2
CHUNK_BITS = 8
MOST = 4096
BLOCK = 1_000_000
_ADDRESS = 16


# ---------------------------------------------------------------- encoding

_END, _LETTER, _NUMBER, _OTHER, _BLANK, _ODD = range(6)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """What the splitting rule sees in each byte below 128, and in each two-byte character from U+0080 to U+024F."""

    def kind(i: int) -> int:
        c = chr(i)
        if c in "\t\n\r ":
            return _BLANK
        if i < 0x20 or 0x7F <= i <= 0xA0:
            return _ODD
        return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)

    one = np.full(256, _ODD, np.uint8)
    one[:128] = [kind(i) for i in range(128)]
    one[0] = _END
    two = np.full(0x800, _ODD, np.uint8)
    two[0x80:0x250] = [kind(i) for i in range(0x80, 0x250)]
    return one, two


_ONE, _TWO = _kinds()
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def kinds(buffer: np.ndarray) -> np.ndarray:
    """The kind of each byte; both bytes of a two-byte character get its kind. Texts are separated by zero bytes."""
    out = _ONE[buffer]
    lead = np.flatnonzero((buffer >= 0xC2) & (buffer <= 0xDF))
    lead = lead[buffer[lead + 1] & 0xC0 == 0x80]
    if len(lead):
        out[lead] = out[lead + 1] = _TWO[(buffer[lead].astype(np.int64) & 31) << 6 | (buffer[lead + 1] & 63)]
    return out


def pieces(buffer: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the pieces into which the byte-level splitting rule cuts the texts of a buffer without odd bytes.

    A piece is a run of one kind with the blank before it, if that is a space; a run of blanks before something else
    leaves its last one to a piece of its own or to what follows; an apostrophe that begins a piece takes s, t, m, d, re, ve
    or ll with it and nothing more.
    """
    n = len(buffer)
    edge = np.empty(n + 1, bool)
    edge[0] = edge[n] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:n])
    end = kind == _END
    edge[:n] |= end
    # Runs of blanks that something follows.
    after = np.flatnonzero((kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~end[1:]) + 1
    edge[after - 1] = True
    edge[after[buffer[after - 1] == 32]] = False
    mark = np.flatnonzero(buffer[:-2] == 39)
    if len(mark):
        before = np.where(mark > 0, buffer[mark - 1], 0)
        mark = mark[(before != 32) & ((mark == 0) | (kind[mark - 1] != _OTHER))]
        one, two = buffer[mark + 1], buffer[mark + 2]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        mark, size = mark[short | long], np.where(short, 2, 3)[short | long]
        edge[mark + 1] = False
        edge[mark + size] = True
    at = np.flatnonzero(edge)
    begin, stop = at[:-1], at[1:]
    own = ~end[begin]
    return begin[own], stop[own]


class Encoder:
    """Encodes texts with a byte-level BPE file of the tokenizers library, remembering the ids of pieces it has met.

    Byte-level BPE never merges across the pieces of its splitting rule, so a text's ids are its pieces' ids one after
    another. A piece of at most 16 bytes is its own key, two words, in a table with one place for each hash: a new piece
    replaces the one that has its place, so memory is bounded. Unknown pieces go to the library strung together, and the
    lengths of their tokens tell where each ends. Texts with characters beyond Latin letters or with the name of an added
    token go to the library whole, as all do where the file has another splitting rule.
    """

    PLACES = 21
    ARENA = 12_000_000
    LONG = 50_000

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rule = json.loads(self.tokenizer.to_str())
        split = rule.get("pre_tokenizer") or {}
        self.plain = rule.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and rule["model"]["type"] == "BPE"
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.kind = np.dtype("<u4" if self.wide else "<u2")
        vocab = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)  # a byte-level token has a character for each byte
        self.bytes[list(vocab.values())] = [len(t) for t in vocab]
        self.forget()

    def forget(self) -> None:
        n = 1 << self.PLACES
        self.key1, self.key2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.first, self.count = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.long: dict[bytes, tuple[int, int]] = {}
        self.arena, self.used = np.zeros(1 << 20, self.kind), 0

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, self.kind) for e in found]

    def _strung(self, news: list[bytes], lead: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces that stay apart when strung together with `lead` before each, and the ends of each piece's ids."""
        lists, ends, before = [], [], 0
        for at in range(0, len(news), 256):
            part = news[at : at + 256]
            ids = np.array(self.tokenizer.encode(b"".join([lead + p for p in part]).decode(), add_special_tokens=False).ids, self.kind)
            size = np.cumsum([len(lead) + len(p) for p in part])
            reach = np.cumsum(self.bytes[ids])
            stop = np.searchsorted(reach, size)
            if stop[-1] != len(ids) - 1 or not np.array_equal(reach[stop], size):
                raise AssertionError("a token lies across two pieces")
            if lead:
                begin = np.concatenate(([0], stop[:-1] + 1))
                drop = np.zeros(len(ids), bool)
                drop[begin] = True
                ids, stop = ids[~drop], stop - np.arange(1, len(part) + 1)
            lists.append(ids)
            ends.append(stop + 1 + before)
            before += len(ids)
        return np.concatenate(lists), np.concatenate(ends)

    def _learn(self, news: list[bytes]) -> dict[bytes, tuple[int, int]]:
        """Where in the arena the ids of new pieces are, and how many."""
        spaced = [p for p in news if p[0] == 32 and len(p) > 1 and p[1] not in b" \t\r\n"]
        blank = [p for p in news if p.isspace()]
        other = set(news).difference(spaced, blank)
        out: dict[bytes, tuple[int, int]] = {}
        for group, lead in ((spaced, b""), (sorted(other), b"\n"), (blank, None)):
            if not group:
                continue
            if lead is None:
                lists = self._whole(group)
                ids, ends = np.concatenate(lists), np.cumsum([len(x) for x in lists])
            else:
                ids, ends = self._strung(group, lead)
            while self.used + len(ids) > len(self.arena):
                self.arena = np.concatenate((self.arena, np.zeros(len(self.arena), self.kind)))
            self.arena[self.used : self.used + len(ids)] = ids
            begin = np.concatenate(([0], ends[:-1]))
            out.update(zip(group, zip((begin + self.used).tolist(), (ends - begin).tolist(), strict=True), strict=True))
            self.used += len(ids)
        return out

    def _plain(self, texts: list[bytes], buffer: np.ndarray, kind: np.ndarray) -> list[np.ndarray]:
        begin, end = pieces(buffer, kind)
        size = end - begin
        padded = np.concatenate((buffer, np.zeros(24, np.uint8)))
        words = np.ndarray((len(buffer) + 16,), "<u8", padded.data, strides=(1,))
        one = words[begin] & _KEEP[np.minimum(size, 8)]
        two = words[begin + 8] & _KEEP[np.clip(size - 8, 0, 8)]
        h = (one ^ (one >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + two * np.uint64(0xD6E8FEB86659FD93)
        place = ((h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.PLACES)).astype(np.int64)
        first, count = self.first[place], self.count[place]
        miss = np.flatnonzero((self.key1[place] != one) | (self.key2[place] != two) | (size > 16))
        if len(miss):
            raw = buffer.tobytes()
            names = [raw[a:b] for a, b in zip(begin[miss].tolist(), end[miss].tolist(), strict=True)]
            known = self._learn([p for p in dict.fromkeys(names) if p not in self.long])
            where = np.array([known.get(p) or self.long[p] for p in names], np.int64)
            first[miss], count[miss] = where[:, 0], where[:, 1]
            short = miss[size[miss] <= 16]
            p = place[short]
            self.key1[p], self.key2[p], self.first[p], self.count[p] = one[short], two[short], first[short], count[short]
            # Two new pieces may have one place: all four columns hold the last one, as numpy assigns in order.
            self.long.update((p, x) for p, x in known.items() if len(p) > 16)
        total = np.cumsum(count, dtype=np.int64)
        ids = self.arena[np.repeat(first - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        stops = np.cumsum([len(t) + 1 for t in texts])
        at = np.concatenate(([0], total))[np.searchsorted(begin, stops)]
        if self.used > self.ARENA or len(self.long) > self.LONG:
            self.forget()
        return np.split(ids, at[:-1])

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        if not texts:
            return []
        odd = np.full(len(texts), not self.plain)
        for k in range(2 if self.plain else 0):
            left = np.flatnonzero(~odd).tolist()
            buffer = np.frombuffer(b"".join([texts[i] + b"\0" for i in left]), np.uint8)
            kind = kinds(buffer)
            if k or not len(left):
                break
            stops = np.cumsum([len(texts[i]) + 1 for i in left])
            odd[np.searchsorted(stops, np.flatnonzero(kind == _ODD), "right")] = True
            if int((buffer == 0).sum()) > len(left):
                odd |= [b"\0" in t for t in texts]
            if self.added:
                odd |= [any(a in t for a in self.added) for t in texts]
            if not odd.any():
                break
        out: list = [None] * len(texts)
        whole = np.flatnonzero(odd).tolist()
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids
        left = np.flatnonzero(~odd).tolist()
        if left:
            for i, ids in zip(left, self._plain([texts[i] for i in left], buffer, kind), strict=True):
                out[i] = ids
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# ---------------------------------------------------------------- chunks

_GEAR = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def cuts(streams: list[np.ndarray], bits: int = CHUNK_BITS, most: int = MOST) -> list[np.ndarray]:
    """Ends of the chunks of each stream: where the rolling hash of its last 32 ids has `bits` leading zeros, and its end.

    A chunk longer than `most` is cut every `most` ids. Streams stand side by side with 31 places that weigh nothing between.
    """
    if not streams:
        return []
    gap = np.zeros(31, streams[0].dtype)
    ids = np.concatenate([x for s in streams for x in (gap, s)])
    size = np.array([len(s) for s in streams])
    begin = np.cumsum(size + 31) - size
    h = _GEAR[ids & 0xFFFF] ^ mix(ids >> 16) if ids.dtype.itemsize > 2 else _GEAR[ids]
    pad = (begin[:, None] - np.arange(1, 32)).ravel()
    h[pad] = 0
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            h[k:] += h[:-k] << np.uint64(k)
    is_end = (h >> np.uint64(64 - bits)) == 0
    is_end[pad] = False
    is_end[(begin + size - 1)[size > 0]] = True
    ends = np.flatnonzero(is_end) + 1
    edge = np.searchsorted(ends, begin + size, "right")
    out = []
    for b, x, y in zip(begin.tolist(), [0, *edge[:-1].tolist()], edge.tolist(), strict=True):
        e = ends[x:y] - b
        gaps = np.diff(e, prepend=0)
        if len(gaps) and gaps.max() > most:
            e = np.unique(np.concatenate([e, *[np.arange(z - g + most, z, most) for z, g in zip(e, gaps, strict=True) if g > most]]))
        out.append(e)
    return out


def address(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=_ADDRESS).digest()


PARTS = "kind string, key binary, doc_id long, n_tokens long, body binary"


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.view(kind).to_pylist()]


def write(docs: DataFrame, path: str, tokenizer: str, *, id_col="doc_id", text_col="text", end_id: int = END_ID) -> None:
    """Encode every text and write the store. Chunks and recipes travel in one shuffle; a chunk's copies meet there."""
    if not isinstance(docs.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{id_col} must be an integer")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.kind)
        width = enc.kind.itemsize
        sent: set[bytes] = set()
        times: dict[tuple, int] = {}
        for batch in batches:
            every, ids_of = _texts(batch.column(1)), batch.column(0).to_pylist()
            for part in blocks(map(len, every), BLOCK):
                texts, ids = every[part], ids_of[part]
                distinct = list(dict.fromkeys(texts))
                streams = [np.concatenate((x, end)) for x in enc.encode(distinct)]
                recipes, keys, bodies = {}, [], []
                for t, stream, stops in zip(distinct, streams, cuts(streams), strict=True):
                    body, begin, names = stream.tobytes(), 0, []
                    for stop in stops.tolist():
                        chunk = body[begin * width : stop * width]
                        names.append(name := address(chunk))
                        if name not in sent:
                            if len(sent) > 200_000:
                                sent.clear()
                            sent.add(name)
                            keys.append(name)
                            bodies.append(chunk)
                        begin = stop
                    recipes[t] = len(stream), b"".join(names)
                n = len(keys)
                for d, t in zip(ids, texts, strict=True):
                    # Equal rows are counted, so that they go to different places, the same ones if the task runs again.
                    row = (d, address(recipes[t][1]))
                    if len(times) > 200_000:
                        times.clear()
                    times[row] = k = times.get(row, 0) + 1
                    keys.append(address(repr((*row, k)).encode()))
                    bodies.append(recipes[t][1])
                kind = pa.array(["chunk"] * n + ["recipe"] * len(ids))
                count = pa.array([None] * n + [recipes[t][0] for t in texts], pa.int64())
                yield pa.record_batch([kind, pa.array(keys, pa.binary()), pa.array([None] * n + ids, pa.int64()), count, pa.array(bodies, pa.binary())], ["kind", "key", "doc_id", "n_tokens", "body"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the chunk written last
        for batch in batches:
            keep = []
            for kind, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keep.append(kind != "chunk" or key != last)
                last = key if kind == "chunk" else None
            yield batch.filter(pa.array(keep, pa.bool_()))

    spark = docs.sparkSession
    n = partitions(spark)
    dealt = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(thrifty(encode), PARTS)
    dealt.repartition(n, "key").sortWithinPartitions("kind", "key").mapInArrow(once, PARTS).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/parts")
    width = encoder(tokenizer).kind.itemsize
    spark.createDataFrame([(1, width, end_id, CHUNK_BITS, MOST, _ADDRESS)], FORMAT).coalesce(1).write.parquet(f"{path}/format")
    found = spark.read.schema(PARTS).parquet(f"{path}/parts").filter("kind = 'recipe'").select("key", "doc_id", "n_tokens", F.col("body").alias("addresses"))
    # The key is the last resort: any number of rows may have one id, or none, and one text.
    ordered = running(found, [F.col("doc_id").asc_nulls_first(), F.col("n_tokens"), F.col("addresses"), F.col("key")], {"start": "n_tokens"}, name="recipes")
    ordered.select("pid", "position", "doc_id", "start", "n_tokens", "addresses").write.parquet(f"{path}/recipes")
    level = _roots(_leaves(spark.read.parquet(f"{path}/recipes")))
    k = 0
    while True:
        level.select(F.lit(k).alias("level"), "block", "n", "root").write.mode("append").parquet(f"{path}/manifest")
        written = _manifest(spark, path).filter(F.col("level") == k)
        if written.count() <= 1:
            return
        level, k = _roots(written.select(F.col("block").alias("position"), F.col("root").alias("leaf"))), k + 1


FORMAT = "version int, id_bytes int, end_id long, chunk_bits int, most_ids int, address_bytes int"


def _format(spark: SparkSession, path: str) -> dict:
    """What the store says about itself."""
    row = spark.read.schema(FORMAT).parquet(f"{path}/format").first()
    if row is None or row["version"] != 1 or row["address_bytes"] != _ADDRESS:
        raise Damaged("format")
    return row.asDict()


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(f"{path}/parts").filter("kind = 'chunk'").select("key", "body")


# ---------------------------------------------------------------- manifest


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary hash tree over the leaves; an odd one moves up as it is."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    level = leaves
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


LEAVES = 4096


def _leaves(recipes: DataFrame) -> DataFrame:
    """position and leaf, the hash of all that a recipe says."""
    said = F.concat_ws("|", "position", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "start", "n_tokens", F.lit(""))
    return recipes.select("position", F.unhex(F.sha2(F.concat(said.cast("binary"), F.col("addresses")), 256)).alias("leaf"))


def _roots(leaves: DataFrame) -> DataFrame:
    """leaves(position, leaf) -> hash-tree roots over blocks of `LEAVES` of them in order: block, n, root."""

    def root(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("position")
        return pd.DataFrame({"block": [int(group["block"].iloc[0])], "n": [len(group)], "root": [merkle_root([bytes(x) for x in group["leaf"]])]})

    return leaves.withColumn("block", F.expr(f"position div {LEAVES}")).groupBy("block").applyInPandas(root, "block long, n long, root binary")


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("level int, block long, n long, root binary").parquet(f"{path}/manifest")


def corpus_root(spark: SparkSession, path: str) -> bytes:
    """The one root over all recipes; of an empty store, the hash of nothing."""
    top = _manifest(spark, path).sort(F.desc("level"), "block").first()
    return bytes(top["root"]) if top is not None else merkle_root([])


def verify(spark: SparkSession, path: str) -> DataFrame:
    """(level, block) whose recipes or lower roots no longer hash to the manifest; empty if the store is whole."""
    then = _manifest(spark, path).select("level", "block", F.col("n").alias("n_then"), F.col("root").alias("root_then"))
    top = then.agg(F.max("level")).first()[0]
    out = None
    for k in range((top or 0) + 1):
        below = _leaves(spark.read.parquet(f"{path}/recipes")) if k == 0 else then.filter(F.col("level") == k - 1).select(F.col("block").alias("position"), F.col("root_then").alias("leaf"))
        both = _roots(below).join(then.filter(F.col("level") == k).drop("level"), "block", "full")
        bad = both.filter("not (root <=> root_then and n <=> n_then)").select(F.lit(k).alias("level"), "block")
        out = bad if out is None else out.unionAll(bad)
    return out


# ---------------------------------------------------------------- reading

_POLY = np.uint64(0xEDB88320)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of two arrays of reflected CRC-32 polynomials."""
    out = np.zeros_like(a)
    b = b.copy()
    for k in range(31, -1, -1):
        out ^= np.where((a >> np.uint64(k)) & np.uint64(1), b, np.uint64(0))
        b = np.where(b & np.uint64(1), (b >> np.uint64(1)) ^ _POLY, b >> np.uint64(1))
    return out


def crc_after(crc: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """What checksums become when so many bytes follow, to be combined by exclusive or with the checksum of those."""
    power = np.full(len(crc), 1 << 31, np.uint64)
    square = np.array([1 << 23], np.uint64)  # x**8
    left = n_bytes.astype(np.uint64).copy()
    while left.any():
        odd = np.flatnonzero(left & np.uint64(1))
        power[odd] = _times(power[odd], np.broadcast_to(square, len(odd)))
        square = _times(square, square)
        left >>= np.uint64(1)
    return _times(crc.astype(np.uint64), power)


class Damaged(ValueError):
    """A part of the store isn't what its address, the manifest or the format says."""


def _checked(key: bytes, body: bytes) -> bytes:
    if address(body) != key:
        raise Damaged(key.hex())
    return body


def _chunk_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    kind = np.dtype(f"<u{width}")
    for batch in batches:
        bodies = [_checked(k, b) for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        sums = [zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in bodies]
        yield pa.record_batch([batch.column(0), pa.array(sums, pa.int64()), pa.array([len(b) // width for b in bodies], pa.int64())], ["key", "crc", "n"])


def _joined(recipes: DataFrame, chunks: DataFrame, *columns: str) -> DataFrame:
    """recipes with `c`, for each address in order its place and these columns of its chunk."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            positions, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for part in blocks(map(len, texts), 2_000_000):
                count = np.array([len(x) // _ADDRESS for x in texts[part]], np.int64)
                keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(_ADDRESS), int(count.sum()), [None, pa.py_buffer(b"".join(texts[part]))]).cast(pa.binary())
                place = np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)
                yield pa.record_batch([pa.array(np.repeat(positions[part], count)), pa.array(place, pa.int32()), keys], ["at", "i", "key"])

    refs = recipes.select("position", "addresses").mapInArrow(spread, "at long, i int, key binary")
    lists = refs.join(chunks, "key").groupBy("at").agg(F.sort_array(F.collect_list(F.struct("i", *columns))).alias("c"))
    return recipes.drop("addresses").join(lists, F.col("position") == F.col("at"), "left").drop("at")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the store's files.

    Recipes must hash to the manifest up to its one root. The checksum and the number of ids of a document are put together
    from those of its chunks, each computed from the chunk's own bytes after these matched their address, so the chunks
    themselves stay where they lie; the start is the sum of what was counted before, and must be the recipe's.
    """
    width = _format(spark, path)["id_bytes"]
    for bad in verify(spark, path).limit(1).collect():
        raise Damaged(f"manifest level {bad['level']}, block {bad['block']}")
    sums = _chunks(spark, path).mapInArrow(lambda it: _chunk_sums(it, width), "key binary, crc long, n long")

    @F.pandas_udf("struct<crc:long,n:long>")
    def combine(ns: pd.Series, crcs: pd.Series) -> pd.DataFrame:
        count = np.array([0 if x is None else len(x) for x in ns])
        if (count == 0).any():
            raise Damaged("a recipe without its chunks")
        if not len(count):
            return pd.DataFrame({"crc": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        n = np.concatenate([np.asarray(x, np.int64) for x in ns])
        crc = np.concatenate([np.asarray(x, np.int64) for x in crcs])
        first = np.concatenate(([0], np.cumsum(count)))[:-1]
        total = np.cumsum(n)
        ends = total[first + count - 1]
        after = np.repeat(ends, count) - total
        moved = crc_after(crc, after * 4)
        return pd.DataFrame({"crc": np.bitwise_xor.reduceat(moved, first).astype(np.int64), "n": np.add.reduceat(n, first)})

    recipes = spark.read.parquet(f"{path}/recipes")
    found = _joined(recipes, sums, "n", "crc").select("pid", "position", "doc_id", "start", "n_tokens", combine(F.col("c.n"), F.col("c.crc")).alias("own"))
    # Places were dealt by ranges: the sums before a range are as few as the ranges.
    earlier = Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    before = recipes.groupBy("pid").agg(F.sum("n_tokens").alias("n")).select("pid", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("pid").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("own.n").over(inside), F.lit(0))
    read = found.join(before, "pid").select("doc_id", "start", "n_tokens", "own", start.alias("counted"))
    right = (F.col("own.n") == F.col("n_tokens")) & (F.col("counted") == F.col("start"))
    n = F.when(right, F.col("own.n")).otherwise(F.raise_error(F.lit("the store is damaged: a count of ids")).cast("long"))
    return read.select("doc_id", F.col("counted").alias("start"), n.alias("n_tokens"), F.col("own.crc").alias("ids_crc32"))


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids of every document, put together from the store; chunks must match their addresses."""
    kind = np.dtype(f"<u{_format(spark, path)['id_bytes']}")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _checked(k, b)
            yield batch

    chunks = _chunks(spark, path).mapInArrow(checked, "key binary, body binary")
    found = _joined(spark.read.parquet(f"{path}/recipes"), chunks, "body")

    @F.pandas_udf("array<int>")
    def ids(bodies: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(map(bytes, b)), kind).astype(np.int32) for b in bodies])

    return found.select("doc_id", "start", ids(F.col("c.body")).alias("ids"))


def store_path(spark: SparkSession) -> str:
    return work_path(spark, "tokens")
