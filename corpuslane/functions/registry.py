"""Text functions under SQL names, for use in spark.sql."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuslane.operators import chunkers


def register(spark: SparkSession) -> None:
    """Registers chunk_text(text), normalize_document(text) and tokenize_text(text) as Arrow-batched SQL functions."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def chunk_text(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: [c[0] for c in chunkers.by_sentences(t)] if t else [])

    @F.pandas_udf(T.StringType())
    def normalize_document(s: pd.Series) -> pd.Series:
        return s.map(lambda t: chunkers.normalized(t) if t else "")

    spark.udf.register("chunk_text", chunk_text)
    spark.udf.register("normalize_document", normalize_document)
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION tokenize_text(t STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(coalesce(t, '')), '[\\p{L}\\p{N}_\\-]+', 0)")
