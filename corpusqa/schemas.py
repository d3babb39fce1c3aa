"""Schemas of the tables the engine reads and produces."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


FILE = _struct(path=T.StringType(), text=T.StringType())

FILE_STATS = _struct(
    doc_id=T.LongType(), lines=T.IntegerType(), code=T.IntegerType(),
    comments=T.IntegerType(), blank=T.IntegerType(),
)

ISSUE = _struct(
    category=T.StringType(), type=T.StringType(), description=T.StringType(),
    severity=T.StringType(), line=T.IntegerType(), context=T.StringType(),
)

FUNCTION = _struct(
    name=T.StringType(), line=T.IntegerType(), end_line=T.IntegerType(),
    lines=T.IntegerType(), params=T.IntegerType(), complexity=T.IntegerType(),
)

NESTING = _struct(name=T.StringType(), level=T.IntegerType(), line=T.IntegerType())

NESTED_LOOP = _struct(line=T.IntegerType(), inner_line=T.IntegerType())

ADVISORY = _struct(
    package=T.StringType(), affected=T.StringType(), description=T.StringType(),
    id=T.StringType(),
)

REQUIREMENT = _struct(project=T.StringType(), line=T.StringType())
