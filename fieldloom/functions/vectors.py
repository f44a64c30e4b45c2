"""Vector arithmetic over ARRAY columns, in DOUBLE and inside the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(array) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when either side has no length, NULL when either side is NULL."""
    scale = norm(a) * norm(b)
    return F.when(scale == 0.0, F.lit(0.0)).otherwise(dot(a, b) / scale)


def squared_l2(a, b) -> Column:
    return _total(
        F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    )


def distance(a, b, metric="l2sq") -> Column:
    if metric == "l2sq":
        return squared_l2(a, b)
    if metric == "cosine":
        return 1.0 - cosine(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def literal(values) -> Column:
    """A vector known to the driver (a query vector, of fixed length) as a constant column."""
    return F.array(*[F.lit(float(v)) for v in values])
