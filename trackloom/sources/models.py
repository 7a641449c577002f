"""Model files as rows: what a folder holds, and what the note beside a model says about its classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import text as X
from trackloom.schema import CLASSES, REDACTED

#: Names that ship with a deployment and are not to be deleted are passed in; none by default.
SUFFIX, NOTE = ".onnx", ".classes.json"


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """``name, classes, default_blur`` of each readable note ``<model>.classes.json`` of a folder.

    ``classes`` is a list, or an object from number to name; where it is missing or neither, the usual classes stand.
    ``default_blur`` keeps the model's own names of those it knows; where none is left, the usual ones it knows. A note
    that isn't JSON counts as missing.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{NOTE}").load(folder)
    note = F.decode("content", "UTF-8")
    name = F.regexp_extract("path", rf"([^/]+){NOTE.replace('.', '[.]')}$", 1)
    raw = lambda key: F.get_json_object(note, f"$.{key}")
    listed, mapped = F.from_json(raw("classes"), "array<string>"), F.from_json(raw("classes"), "map<string,string>")
    usual = F.array(*map(F.lit, CLASSES))
    named = F.when(raw("classes").startswith("["), listed).when(raw("classes").startswith("{"), X.class_names(mapped))
    known = files.where(F.get_json_object(note, "$").isNotNull()).select(name.alias("name"), F.coalesce(named, usual).alias("classes"), F.coalesce(F.from_json(raw("default_blur"), "array<string>"), F.array(raw("default_blur"))).alias("wanted"))
    low = lambda a: F.transform(a, F.lower)
    chosen = F.filter(F.transform("wanted", lambda w: F.try_element_at(F.filter("classes", lambda c: F.lower(c) == F.lower(w)), F.lit(-1))), lambda c: c.isNotNull())
    fallback = F.array_intersect("classes", F.array(*map(F.lit, REDACTED)))
    return known.select("name", "classes", F.when(F.size(F.coalesce(F.array_intersect(low("wanted"), low("classes")), F.array())) > 0, chosen).otherwise(fallback).alias("default_blur"))


def listing(spark: SparkSession, folder: str, immutable: tuple[str, ...] = ()) -> DataFrame:
    """``name, filename, size_bytes, modified_at, immutable, classes, default_blur`` of each model of a folder.

    Contents aren't read. Models without a note have the usual classes.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(folder).select("path", "length", "modificationTime")
    file = F.regexp_extract("path", r"([^/]+)$", 1)
    models = files.select(F.regexp_extract(file, rf"^(.*){SUFFIX.replace('.', '[.]')}$", 1).alias("name"), file.alias("filename"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))
    usual = {"classes": F.array(*map(F.lit, CLASSES)), "default_blur": F.array(*(F.lit(c) for c in CLASSES if c in REDACTED))}
    out = models.join(notes(spark, folder), "name", "left").withColumns({c: F.coalesce(c, v) for c, v in usual.items()})
    return out.select("name", "filename", "size_bytes", "modified_at", F.col("name").isin(*immutable).alias("immutable") if immutable else F.lit(False).alias("immutable"), "classes", "default_blur")
