"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word characters are everything but these (as a Java and RE2 character class).
SPACES = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet (compared without case)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def text_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Total UTF-8 bytes of a text column (one scan of that column)."""
    return df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
