"""Array, map and vector column expressions.

Higher-order functions run per row inside the JVM; no Python UDFs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def head(col: str | Column, n: int | Column) -> Column:
    """C4 ``x[:-n]``: all but the last ``n`` elements."""
    c = _c(col)
    keep = F.greatest(F.size(c) - n, F.lit(0))
    return F.slice(c, F.lit(1), keep)


def tail(col: str | Column, n: int | Column) -> Column:
    """C4 ``x[-n:]``: the last ``n`` elements (all when shorter)."""
    c = _c(col)
    take = F.least(F.size(c), F.lit(n) if isinstance(n, int) else n)
    return F.slice(c, F.greatest(F.size(c) - take + 1, F.lit(1)), take)


def hadamard(a: str | Column, b: str | Column) -> Column:
    """C11: element-wise product ``u ⊙ i``."""
    return F.zip_with(_c(a), _c(b), lambda x, y: x * y)


def concat_vectors(*cols: str | Column) -> Column:
    """Vector concatenation."""
    return F.concat(*[_c(c) for c in cols])


def pad_truncate(col: str | Column, width: int | Column, pad=0) -> Column:
    """Pad with ``pad`` / truncate to exactly ``width`` elements
    (``width`` may be a column, e.g. the longest list as a scalar subquery)."""
    c = _c(col)
    w = width if isinstance(width, Column) else F.lit(width)
    return F.slice(F.concat(c, F.array_repeat(F.lit(pad).cast("int") if isinstance(pad, int) else F.lit(pad),
                                              w)), F.lit(1), w)


def struct_names(col: str | Column, field: str = "name", sep: str = "\n") -> Column:
    """The ``field`` of every struct of an array, joined by ``sep``."""
    return F.array_join(F.transform(_c(col), lambda x: x[field]), sep)


def sort_structs(col: str | Column) -> Column:
    """Stable sort of a struct array by its leading fields (put the time
    first and the original position second to keep ties stable)."""
    return F.array_sort(_c(col))


# D10 -- scalar math (kept JVM-side)
def sigmoid(col: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_c(col)))


def relu(col: str | Column) -> Column:
    return F.greatest(_c(col), F.lit(0.0))


def leaky_relu(col: str | Column, slope: float = 0.2) -> Column:
    c = _c(col)
    return F.when(c > 0, c).otherwise(c * F.lit(slope))


def elu(col: str | Column, alpha: float = 1.0) -> Column:
    c = _c(col)
    return F.when(c > 0, c).otherwise(F.lit(alpha) * (F.exp(c) - 1))


def inv_log2_rank(col: str | Column) -> Column:
    """DCG gain ``1 / log2(rank + 1)``."""
    return F.lit(1.0) / F.log2(_c(col) + 1)
