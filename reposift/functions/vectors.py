"""Column helpers for vectors held as arrays."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(doubles(a), doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(vector: Column) -> Column:
    return F.sqrt(dot(vector, vector))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double precision; 0 if either norm is 0 (so for empty vectors); vectors of unequal lengths fail."""
    norm_a, norm_b = norm(a) if norm_a is None else norm_a, norm(b) if norm_b is None else norm_b
    unequal = F.raise_error(F.concat(F.lit("vectors of lengths "), F.size(a).cast("string"), F.lit(" and "), F.size(b).cast("string")))
    return (
        F.when(F.size(a) != F.size(b), unequal.cast("double"))
        .when((norm_a == 0) | (norm_b == 0), F.lit(0.0))
        .otherwise(dot(a, b) / (norm_a * norm_b))
    )


def mean_vector(vector: Column) -> Column:
    """Aggregate: element-wise mean in double precision, by partial and final aggregation; vectors of unequal lengths fail."""
    mean = vector_to_array(Summarizer.mean(array_to_vector(doubles(vector))))
    low, high = F.min(F.size(vector)), F.max(F.size(vector))
    return F.when(low == high, mean).when(low.isNotNull(), F.raise_error(F.lit("vectors of unequal lengths")).cast("array<double>"))
