"""Arrow-batched wrappers for scalar functions that Spark's built-ins cannot express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def arrow_function(f: Callable, returns: str) -> Callable[..., Column]:
    """A column function that applies ``f`` to each row of its arguments, batch by batch."""

    @wraps(f)
    def column(*args) -> Column:
        kind = to_arrow_type(_parse_datatype_string(returns))

        def run(*columns):
            return pa.array([f(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)

        return F.arrow_udf(run, returns, ArrowUDFType.SCALAR)(*args)

    return column
