"""Text inputs: comma-separated, no header, sorted by time; batch or stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "taxis": "taxi_id bigint, ts_ms bigint, passengers int, zone int, payment string, fare double, tip double",
    "tweets": "tweet_id bigint, ts_ms bigint, hashtags string, likes int, retweets int, is_verified boolean, is_blue_verified boolean, location string",
    "persons": "person_id bigint, ts_ms bigint, name string, city string, state string",
    "auctions": "auction_id bigint, ts_ms bigint, seller_id bigint, category int, item_name string",
    "synthetic": "id bigint, ts_ms bigint, source_id int, key int, value bigint",
    "linear_road": "type int, time bigint, vid int, speed int, xway int, lane int, dir int, seg int, pos int",
    "smart_grid": "ts bigint, meter string, value bigint",
    "cars_cloud": "ts_ms bigint, car_id int, lat double, lon double",
    "outputs": "ts_ms bigint, c0 bigint, c1 bigint",
}
# The grid that a zone number is a cell of, west to east and south to north.
LON_MIN, LON_MAX, LON_CELLS = -74.05, -73.75, 40
LAT_MIN, LAT_MAX, LAT_CELLS = 40.58, 40.92, 25


def schema_of(kind: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[kind])


def parse(lines: DataFrame, kind: str) -> DataFrame:
    """Lines (column value) as rows. The last field takes whatever is left, commas included; lines that don't parse are skipped."""
    fields = schema_of(kind).fields
    cells = F.split("value", ",", len(fields))
    whole = lines.select(cells.alias("c")).where(F.size("c") == len(fields))
    rows = whole.select(*[F.trim(F.get("c", F.lit(i))).try_cast(f.dataType).alias(f.name) if f.dataType.typeName() != "string" else F.get("c", F.lit(i)).alias(f.name) for i, f in enumerate(fields)])
    good = F.lit(True)
    for f in fields:
        if f.dataType.typeName() != "string":
            good = good & F.col(f.name).isNotNull()
    return rows.where(good)


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return parse(spark.read.text(path), kind)


def stream(spark: SparkSession, path: str, kind: str, delay: str, files_at_once: int = 1) -> DataFrame:
    """The same as a stream with a watermark: column ts beside ts_ms."""
    rows = parse(spark.readStream.option("maxFilesPerTrigger", files_at_once).text(path), kind)
    return rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def socket_stream(spark: SparkSession, host: str, port: int, kind: str, delay: str) -> DataFrame:
    rows = parse(spark.readStream.format("socket").option("host", host).option("port", port).load(), kind)
    return rows.withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", delay)


def borough(zone: Column) -> Column:
    """0 (Manhattan) or 1 (Queens) for a zone whose cell's middle lies in the borough's box, else -1."""
    lon = F.lit(LON_MIN) + (zone % LON_CELLS + 0.5) * (LON_MAX - LON_MIN) / LON_CELLS
    lat = F.lit(LAT_MIN) + (F.floor(zone / LON_CELLS) + 0.5) * (LAT_MAX - LAT_MIN) / LAT_CELLS
    manhattan = (lon >= -74.02) & (lon < -73.92) & (lat >= 40.70) & (lat < 40.88)
    return F.when(manhattan, 0).when((lon >= -73.92) & (lat < 40.80), 1).otherwise(-1)


def hashtags(text: Column) -> Column:
    """The non-empty tags of a pipe-separated list."""
    return F.filter(F.split(text, "[|]"), lambda t: t != "")


def scale_view(df: DataFrame, kind: str, channels: int) -> DataFrame:
    """(ts_ms, key, channel, value) of taxis by taxi or by zone, or of tweets by hashtag."""
    if kind == "taxi":
        return df.select("ts_ms", F.col("taxi_id").cast("string").alias("key"), F.pmod("zone", F.lit(channels)).alias("channel"), F.round(F.col("fare") * 100).cast("bigint").alias("value"))
    if kind == "taxi_zone":
        return df.select("ts_ms", F.col("zone").cast("string").alias("key"), F.pmod("taxi_id", F.lit(channels)).cast("int").alias("channel"), F.round(F.col("fare") * 100).cast("bigint").alias("value"))
    tags = df.select("ts_ms", "tweet_id", (F.col("likes") + F.col("retweets")).cast("bigint").alias("value"), F.explode(hashtags(F.col("hashtags"))).alias("key"))
    return tags.select("ts_ms", "key", F.pmod("tweet_id", F.lit(channels)).cast("int").alias("channel"), "value")
