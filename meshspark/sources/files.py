"""Whole files as rows, unzipped where their name ends in .gz."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def contents(spark: SparkSession, path: str) -> DataFrame:
    """content of each file that the path names."""
    files = spark.read.format("binaryFile").load(path).select("content")
    if not path.endswith(".gz"):
        return files

    def unzip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"content": [gzip.decompress(c) for c in batch["content"]]})

    return files.mapInPandas(unzip, "content binary")
