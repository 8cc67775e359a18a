"""The record: a 64-bit id, a 64-bit timestamp (milliseconds by convention) and a dense vector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

ELEMENTS = {"int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(), "float32": T.FloatType(), "float64": T.DoubleType()}
#: Type codes in binary files (fixed values of the format).
CODES = {1: "int8", 2: "int16", 3: "int32", 4: "int64", 5: "float32", 6: "float64"}


def record_schema(element: str = "float32") -> T.StructType:
    return T.StructType([T.StructField("uid", T.LongType()), T.StructField("ts", T.LongType()), T.StructField("vec", T.ArrayType(ELEMENTS[element]))])


def records(df: DataFrame, uid: str = "uid", ts: str = "ts", vec: str = "vec", dim: int | None = None, nameless: bool = False) -> DataFrame:
    """df as records. Rows without id (unless ``nameless``) or vector, or with a null element, are no records and go;
    another dimension than ``dim`` is an error when the row is read (a shorter vector would give null distances)."""
    if not isinstance(df.schema[vec].dataType, T.ArrayType) or not isinstance(df.schema[vec].dataType.elementType, T.NumericType):
        raise ValueError(f"{vec} is no array of numbers")
    out = df.select(F.col(uid).cast("bigint").alias("uid"), F.col(ts).cast("bigint").alias("ts"), F.col(vec).alias("vec"))
    out = out.where("vec is not null and not exists(vec, x -> x is null)" + " and uid is not null" * (not nameless))
    if dim is not None:
        checked = F.when(F.size("vec") == dim, F.col("vec")).otherwise(F.raise_error(F.concat(F.lit(f"dimension {dim} expected, got "), F.size("vec").cast("string"))))
        out = out.withColumn("vec", checked)
    return out


def event_time(ts: Column) -> Column:
    """A timestamp for watermarks, of milliseconds."""
    return F.timestamp_millis(ts)


def from_embeddings(df: DataFrame) -> DataFrame:
    """vec_id, embedding as records whose timestamp is their position."""
    return records(df, "vec_id", "vec_id", "embedding")


def micros(df: DataFrame, ts: str = "ts") -> Column:
    """Microseconds since 1970 of a timestamp. One without a time zone is read as UTC, whatever the session's zone: there
    hours may be missing or come twice."""
    if df.schema[ts].dataType != T.TimestampNTZType():
        return F.unix_micros(F.col(ts).cast("timestamp"))
    days = F.datediff(F.col(ts).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), F.col(ts)) * 1_000_000).cast("bigint")


def from_events(df: DataFrame, nameless: bool = False) -> DataFrame:
    """event_id, ts, value as records of one-dimensional vectors, with milliseconds: the nearest ones, halves away from
    1970, as ``epoch_ms`` of the SQL has them."""
    rows = df.select(F.col("event_id").alias("uid"), micros(df).alias("us"), F.array(F.col("value").cast("double")).alias("vec"))
    return records(rows.withColumn("ts", F.expr("(us + if(us < 0, -500, 500)) div 1000")), nameless=nameless)
