"""Schemas of the tables that operators exchange, and the projection that fills optional columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<int>": T.ArrayType(T.IntegerType())}


def _struct(ddl: str) -> T.StructType:
    """A schema from names and types; unlike Spark's own parser it needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in ddl.split(","))])


BOX = ("x1", "y1", "x2", "y2")
#: A detection: relative corners, ``det_id`` its ordinal in the frame (the tie-breaker everywhere).
DETECTION = _struct(
    "video_id long, frame long, det_id long, x1 double, y1 double, x2 double, y2 double, confidence double, "
    "object_class long, frame_width long, frame_height long, is_confident boolean, mask long"
)
TRACK = _struct(
    "video_id long, frame long, track_id long, x1 double, y1 double, x2 double, y2 double, width double, height double, "
    "state string, age long, last_seen long, score double, should_blur boolean, mask long, debug_color array<int>, origin string"
)
#: Class names in order of their ids, and those redacted unless told otherwise.
CLASSES = ("bike", "head", "person", "plate", "vehicle")
REDACTED = ("plate", "head")


def conform(df: DataFrame, schema: T.StructType, **defaults: object) -> DataFrame:
    """All columns of a schema, in order and of its types; missing ones take their default, or null."""
    return df.select(*((F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema))


def detections(df: DataFrame) -> DataFrame:
    """Detections with every optional column; rows without ``is_confident`` count as confident."""
    return conform(df, DETECTION, is_confident=True, object_class=0)
