"""Vector functions as Column expressions; all arithmetic is in double precision."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Dot product; equals cosine for normalized vectors."""
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def let(value: Column, use) -> Column:
    """use(value) with value computed once a row; inside a lambda it would be computed for every element."""
    return F.transform(F.array(value), use)[0]


def l2_normalize(v: Column) -> Column:
    """A zero vector stays zero."""
    return let(norm(v), lambda n: F.transform(as_double(v), lambda x: F.when(n > 0, x / n).otherwise(x)))


def unit_literal(values: list[float], dims: int | None = None) -> Column:
    """A query vector, cut to dims and normalized here, as a literal."""
    v = [float(x) for x in values][: dims or len(values)]
    n = math.sqrt(sum(x * x for x in v))
    return F.array(*(F.lit(x / n if n > 0 else x) for x in v))


def truncate_and_normalize(v: Column, dims: int) -> Column:
    """First `dims` components, normalized; errors for an empty vector, dims 0 and dims beyond the length."""
    problem = F.when(F.size(v) <= 0, "empty embedding").when(F.lit(dims) <= 0, "dims must be positive").when(F.size(v) < dims, "dims exceed the vector")
    return F.when(problem.isNotNull(), F.raise_error(problem).cast("array<double>")).otherwise(l2_normalize(F.slice(v, 1, max(dims, 1))))


def cosine(a: Column, b: Column) -> Column:
    """True cosine; null if either is zero."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def l2_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: x - y)
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))


def quantize_int8(v: Column) -> Column:
    """Struct of scale and codes: components over the largest magnitude, in -127..127."""
    top = F.array_max(F.transform(as_double(v), F.abs))
    code = lambda t: F.transform(as_double(v), lambda x: F.when(t > 0, F.round(x * 127 / t)).otherwise(F.lit(0.0)).cast("tinyint"))
    return let(top, lambda t: F.struct((t / 127).alias("scale"), code(t).alias("codes")))


def dot_int8(a: Column, b: Column) -> Column:
    """Approximate dot product of two quantized vectors."""
    codes = F.zip_with(a["codes"], b["codes"], lambda x, y: x.cast("int") * y.cast("int"))
    return F.aggregate(codes, F.lit(0), lambda s, x: s + x) * a["scale"] * b["scale"]


def floats_to_bytes(values: list[float]) -> bytes:
    """Little-endian 32-bit floats, for import and export of vector blobs."""
    return struct.pack(f"<{len(values)}f", *values)


def bytes_to_floats(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError("a vector blob holds whole 32-bit floats")
    return list(struct.unpack(f"<{len(blob) // 4}f", blob))
