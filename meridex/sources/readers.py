"""Readers with checked columns and explicit shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import wkt_points


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """`df`, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def read_events(spark: SparkSession, path: str, required: list[str], schema: str | None = None) -> DataFrame:
    """CSV (with header) or Parquet by the path's ending."""
    reader = spark.read.schema(schema) if schema else spark.read
    return require(reader.option("header", True).csv(path) if path.rstrip("/").endswith("csv") else reader.parquet(path), required)


def read_edges(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Road edges of a CSV: id `u_v_key` and a polyline of points; rows whose geometry can't be read are dropped."""
    df = require(spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path), ["u", "v", "key", geometry])
    return df.withColumns({"segment_id": F.concat_ws("_", "u", "v", "key"), "line": wkt_points(F.col(geometry))}).where("line is not null")


def read_poi_elements(spark: SparkSession, path: str, categories: dict[str, tuple[str, str]], whole_file: bool = True) -> DataFrame:
    """Elements of JSON documents (one in a file, or in a line) with `lat`/`lon` or a `center`; one row for each (type, id).

    categories: name -> (tag, value); the first that an element's tags have is its category.
    """
    schema = "elements array<struct<type:string,id:long,lat:double,lon:double,center:struct<lat:double,lon:double>,tags:map<string,string>>>"
    e = spark.read.schema(schema).option("multiLine", whole_file).json(path).select(F.inline("elements"))
    kind = None
    for name, (tag, value) in categories.items():
        hit = F.try_element_at("tags", F.lit(tag)) == value
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    got = e.select("type", "id", F.coalesce("lat", "center.lat").alias("lat"), F.coalesce("lon", "center.lon").alias("lon"), kind.alias("category"))
    return got.where("lat is not null and lon is not null and category is not null").dropDuplicates(["type", "id"])


def read_columnar_json(spark: SparkSession, paths: list[str], variables: list[str], time: str = "time", whole_file: bool = True) -> DataFrame:
    """Hourly structs of arrays (a document in a file, or in a line) to one row for each hour, chunks united, repeated hours once."""
    schema = f"hourly struct<{time}:array<string>, {', '.join(f'{v}:array<double>' for v in variables)}>"
    zipped = F.arrays_zip(*[F.col(f"hourly.{c}").alias(c) for c in (time, *variables)])
    rows = spark.read.schema(schema).option("multiLine", whole_file).json(paths).select(F.inline(zipped))
    return rows.withColumn(time, F.try_to_timestamp(F.regexp_replace(time, "T", " "), F.lit("yyyy-MM-dd HH:mm")).cast("timestamp_ntz")).where(F.col(time).isNotNull()).dropDuplicates([time])


def read_forecast(df: DataFrame, key: str, body: str, start: str, hours: int = 24) -> DataFrame:
    """Points of a nested forecast (a JSON column) in [start, start + hours); `start` is a column of epoch seconds."""
    schema = "list array<struct<dt:long,main:struct<temp:double,humidity:double,pressure:double>,wind:struct<speed:double,gust:double>,rain:map<string,double>,snow:map<string,double>,visibility:double,weather:array<struct<id:int>>>>"
    each = df.select(key, start, F.inline(F.from_json(body, schema)["list"]))
    got = each.where((F.col("dt") >= F.col(start)) & (F.col("dt") < F.col(start) + hours * 3600))
    first = lambda m: F.coalesce(F.try_element_at(m, F.lit("3h")), F.lit(0.0))
    return got.select(key, F.col("dt"), F.col("main.temp").alias("temperature"), F.col("main.humidity").alias("humidity"), F.col("main.pressure").alias("pressure"), F.col("wind.speed").alias("wind_speed"), F.col("wind.gust").alias("wind_gust"), first("rain").alias("rain"), first("snow").alias("snow"), "visibility", F.try_element_at("weather", F.lit(1))["id"].alias("weather_id"))
