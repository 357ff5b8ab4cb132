"""Texts as lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sediment.functions.text import LINE_END, lines_of


def explode_lines(texts: DataFrame, text: str = "content", keys: tuple[str, ...] = ("path",), end: str = LINE_END) -> DataFrame:
    """A row a line: the key columns, ``line`` (from 1) and ``text``. A null text has no lines;
    ``end`` is a pattern of what ends one."""
    return texts.select(*keys, F.posexplode(lines_of(F.col(text), end)).alias("_at", "text")).select(*keys, (F.col("_at") + 1).alias("line"), "text")
