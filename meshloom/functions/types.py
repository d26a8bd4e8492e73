"""Element types of attributes: numpy and C names to Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of element types and what holds them.
#: Unsigned types take the next wider signed one; 64-bit unsigned ids stay long and are checked on reading.
SPARK_TYPES: dict[str, T.DataType] = {
    "char": T.ByteType(), "signed char": T.ByteType(), "int8": T.ByteType(),
    "unsigned char": T.ShortType(), "uint8": T.ShortType(),
    "short": T.ShortType(), "int16": T.ShortType(),
    "unsigned short": T.IntegerType(), "uint16": T.IntegerType(),
    "int": T.IntegerType(), "int32": T.IntegerType(),
    "unsigned": T.LongType(), "unsigned int": T.LongType(), "uint32": T.LongType(),
    "long": T.LongType(), "long long": T.LongType(), "int64": T.LongType(),
    "unsigned long": T.LongType(), "unsigned long long": T.LongType(), "uint64": T.LongType(),
    "float": T.FloatType(), "float32": T.FloatType(),
    "double": T.DoubleType(), "float64": T.DoubleType(),
    "long double": T.DoubleType(), "float128": T.DoubleType(),
    "wchar_t": T.StringType(),
}


def spark_type(name: str) -> T.DataType:
    """The Spark type of an element type; anything that isn't a number travels as binary."""
    return SPARK_TYPES.get(str(name).strip(), T.BinaryType())


def composite(base: T.DataType, sizes: tuple[int, ...] = ()) -> T.DataType:
    """A value with trailing dimensions: nested arrays, innermost dimension last."""
    for _ in sizes:
        base = T.ArrayType(base, False)
    return base
