"""Readers and writers of regular volumes: a header with raw or gzip data, raw slices, blocked volumes."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sample types that headers name. Unsigned 16-bit samples are read as signed ones.
TYPES = {"unsigned char": "u1", "uchar": "u1", "char": "i1", "short": "i2", "unsigned short": "i2", "float": "f4"}
RAW_SIDE = 256
SCHEMA = "x int, y int, z int, value double"


def _content(spark: SparkSession, path: str) -> bytes:
    """A header file: small by its format."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def header(text: str) -> dict:
    """type, sizes, spacings, data file, encoding, endian, origin of a header."""
    out = {}
    for line in text.splitlines():
        key, colon, value = line.partition(":")
        if colon and not line.startswith("#"):
            out[key.strip().lower()] = value.strip(" =")
    sizes = [int(x) for x in out["sizes"].split()]
    origin = [float(x) for x in out.get("space origin", "(0,0,0)").strip("() ").split(",")]
    return {
        "dims": sizes, "type": out.get("type", "float"), "spacings": [float(x) for x in out.get("spacings", "1 1 1").split()], "file": out.get("data file", ""),
        "gzip": out.get("encoding", "raw").startswith("gz"), "big": out.get("endian", "little") == "big", "origin": origin, "block": [int(x) for x in out.get("block size", "").split()], "prefix": out.get("block prefix", ""),
    }


def _samples(spark: SparkSession, path: str, kind: str, dims: list[int] | None, big: bool, gz: bool, start=(0, 0, 0)) -> DataFrame:
    """Voxels of one data file, x fastest. One task a file: blocked volumes have as many tasks as blocks."""
    dtype = np.dtype(("big" if big else "little") == "big" and ">" + kind or "<" + kind)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                data = np.frombuffer(gzip.decompress(content) if gz else content, dtype)
                nx, ny, nz = dims or (RAW_SIDE, RAW_SIDE, len(data) // (RAW_SIDE * RAW_SIDE))
                for z in range(nz):
                    part = data[z * nx * ny : (z + 1) * nx * ny].astype(float)
                    yield pd.DataFrame({"x": start[0] + np.tile(np.arange(nx, dtype=np.int32), ny), "y": start[1] + np.repeat(np.arange(ny, dtype=np.int32), nx), "z": np.full(nx * ny, start[2] + z, np.int32), "value": part})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def read_nhdr(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """voxels(x, y, z, value) and the header."""
    h = header(_content(spark, path).decode())
    data = path.rsplit("/", 1)[0] + "/" + h["file"]
    return _samples(spark, data, TYPES[h["type"]], h["dims"], h["big"], h["gzip"]), h


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """`.short.vol`, `.byte.vol` or `.float.vol`: slices of 256 x 256, as many as the file holds."""
    kind = {"short": "i2", "byte": "u1", "float": "f4"}[path.rsplit(".", 2)[1]]
    return _samples(spark, path, kind, None, False, False)


def read_blocked(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """A header with a block size and prefix; each block is a volume of its own, read by its own task."""
    h = header(_content(spark, path).decode())
    folder = path.rsplit("/", 1)[0]
    out = None
    counts = [-(-n // b) for n, b in zip(h["dims"], h["block"], strict=True)]
    for bz in range(counts[2]):
        for by in range(counts[1]):
            for bx in range(counts[0]):
                name = f"{folder}/{h['prefix']}.{bx:03d}.{by:03d}.{bz:03d}.nhdr"
                vox, _ = read_nhdr(spark, name)
                vox = vox.select(*[(F.col(c) + b * s).cast("int").alias(c) for c, b, s in zip("xyz", (bx, by, bz), h["block"], strict=True)], "value")
                out = vox if out is None else out.unionByName(vox)
    return out, h
