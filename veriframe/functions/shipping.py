"""Arrow UDFs that do not need this package on the workers' path."""

from __future__ import annotations

from collections.abc import Callable
from types import FunctionType

from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def by_value_arrow_udf(fn: Callable, result: DataType):
    """An Arrow UDF around a self-contained function, pickled by value instead of by module name."""
    loose = FunctionType(fn.__code__, {"__builtins__": __builtins__}, fn.__name__, fn.__defaults__, fn.__closure__)
    loose.__module__ = "__main__"
    loose.__annotations__ = _arrow_types(fn)
    return F.arrow_udf(loose, result)


def _arrow_types(fn: Callable) -> dict:
    import pyarrow as pa

    return {name: pa.Array for name in fn.__annotations__}
