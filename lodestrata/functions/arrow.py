"""Python functions over Arrow columns, for what the JVM's functions can't express."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

#: So many values at a time are Python objects; a batch can hold many more, and what is made of them takes several times the room of its Arrow form.
PIECE = 16


def _kind(ddl: str) -> DataType:
    return StructType.fromDDL(f"x {ddl}")["x"].dataType


def over_values(function: Callable, ddl: str) -> Callable[[Column | str], Column]:
    """A Column function that applies function to each value (null to null), an Arrow batch at a time.

    The type is parsed with the first use, as that takes a session.
    """

    def column(of: Column | str) -> Column:
        kind = _kind(ddl)
        arrow = to_arrow_type(kind)

        @F.arrow_udf(kind)
        def apply(values: pa.Array) -> pa.Array:
            pieces = (values.slice(i, PIECE).to_pylist() for i in range(0, len(values), PIECE))
            return pa.concat_arrays([pa.array([None if x is None else function(x) for x in piece], arrow) for piece in pieces] or [pa.array([], arrow)])

        return apply(of)

    return column
