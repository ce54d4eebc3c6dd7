"""Functions registered for SQL: vec_dot, vec_l2, l2_normalize, bm25_part, chunk_text (a table function)."""

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from docspark.functions import text as T


def _pairs(a: pd.Series, b: pd.Series, f) -> pd.Series:
    return pd.Series([None if x is None or y is None else float(f(np.asarray(x, float), np.asarray(y, float))) for x, y in zip(a, b, strict=True)], dtype="float64")


def vec_dot(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(a, b, lambda x, y: x @ y)


def vec_l2(a: pd.Series, b: pd.Series) -> pd.Series:
    return _pairs(a, b, lambda x, y: np.linalg.norm(x - y))


def l2_normalize(v: pd.Series) -> pd.Series:
    def unit(x):
        if x is None:
            return None
        x = np.asarray(x, float)
        n = np.linalg.norm(x)
        return x / n if n > 0 else x

    return v.map(unit)


class ChunkText:
    def eval(self, text: str, size: int, overlap: int):
        yield from T.chunk_text(text, size, overlap)


def register(spark: SparkSession) -> None:
    spark.udf.register("vec_dot", F.pandas_udf(vec_dot, "double"))
    spark.udf.register("vec_l2", F.pandas_udf(vec_l2, "double"))
    spark.udf.register("l2_normalize", F.pandas_udf(l2_normalize, "array<double>"))
    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="ordinal int, text string, char_start int, char_end int"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bm25_part(tf DOUBLE, len DOUBLE, avglen DOUBLE, idf DOUBLE) RETURNS DOUBLE RETURN idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avglen))")
