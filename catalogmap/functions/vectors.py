"""Column expressions on ``array<float>`` vectors; arithmetic is in double."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogmap.functions.text import col_of


def as_double(v: str | Column) -> Column:
    return col_of(v).cast("array<double>")


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(
        F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(v: str | Column) -> Column:
    return F.sqrt(F.aggregate(as_double(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: str | Column, eps: float = 0.0) -> Column:
    """Unit vector; a zero vector stays zero. ``eps`` is the serving form: divide by norm + eps."""
    n = norm(v) + F.lit(eps)
    # the one-element array binds the norm once for all components
    return F.transform(
        F.array(F.when(n == 0, F.lit(1.0)).otherwise(n)),
        lambda d: F.transform(as_double(v), lambda x: x / d),
    )[0]


def scale(v: str | Column, w: float | Column) -> Column:
    w = F.lit(float(w)) if isinstance(w, (int, float)) else w
    return F.transform(as_double(v), lambda x: x * w)


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def vote_weight(votes: str | Column) -> Column:
    """1 + ln(1 + votes); null and negative votes count as none."""
    return F.lit(1.0) + F.log1p(F.greatest(F.coalesce(col_of(votes), F.lit(0)), F.lit(0)).cast("double"))


def mean_vector(v: str | Column, weight: Column | None = None) -> Column:
    """Weighted mean as an aggregate with map-side partial sums, so that a hot group stays small."""
    vec = array_to_vector(as_double(v))
    mean = Summarizer.mean(vec, weight) if weight is not None else Summarizer.mean(vec)
    return vector_to_array(mean)
