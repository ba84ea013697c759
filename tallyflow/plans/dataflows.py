"""The dataflows, over any input that has their columns: each builds one plan for all annotation schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyflow.functions.time import DAY, HOUR, MINUTE, SECOND
from tallyflow.operators.flow import Flow, tag
from tallyflow.sources.readers import borough, hashtags


def count_join(solo: Flow, crowded: Flow, key: str, size: int, slide: int) -> Flow:
    """taxi_1: keys with one row in the first branch's window meet keys with two or more in the second's."""
    count = lambda f: f.aggregate([key], {"n": ("count", None)}, size, slide)
    left, right = count(solo).where(F.col("n") == 1), count(crowded).where(F.col("n") >= 2)
    return left.join(right, key, size, slide, [F.col("l.n").alias("solo_count"), F.col("r.n").alias("crowded_count")])


def average_join(left: Flow, right: Flow, key: str, value: str, size: int, slide: int, names: tuple[str, str], values: tuple[str, str] | None = None) -> Flow:
    """taxi_2 and twitter_1: the averages of two branches, joined by key."""
    values = values or (value, value)
    a = left.aggregate([key], {"v": ("avg", values[0])}, size, slide)
    b = right.aggregate([key], {"v": ("avg", values[1])}, size, slide)
    return a.join(b, key, size, slide, [F.col("l.v").alias(names[0]), F.col("r.v").alias(names[1])])


def taxi_1(rides: DataFrame, scheme: str = "counters", by_source: bool = False) -> Flow:
    rides = rides.withColumn("borough", borough(F.col("zone"))).where("borough >= 0")
    branch = 0 if by_source else 2
    start = lambda cond, b: tag(rides.where(cond).select("ts_ms", "taxi_id", "borough"), F.col("borough") + b * branch, 2 + branch, scheme, F.col("ts_ms"))
    return count_join(start("passengers = 1", 0), start("passengers > 2", 1), "taxi_id", HOUR, 10 * MINUTE)


def taxi_2(rides: DataFrame, scheme: str = "counters") -> Flow:
    start = lambda kind, c, v: tag(rides.where(F.col("payment") == kind).select("ts_ms", "zone", v), F.lit(c), 2, scheme, F.col("ts_ms"))
    return average_join(start("CRD", 0, "tip"), start("CSH", 1, "fare"), "zone", "tip", HOUR, 10 * MINUTE, ("avg_card_tip", "avg_cash_fare"), ("tip", "fare"))


def scored_tags(tweets: DataFrame) -> DataFrame:
    score = (F.col("likes") + F.col("retweets")).cast("double").alias("score")
    return tweets.select("ts_ms", "tweet_id", "is_verified", "is_blue_verified", "location", score, F.explode(hashtags(F.col("hashtags"))).alias("hashtag"))


def twitter_1(tweets: DataFrame, scheme: str = "counters", by_source: bool = False) -> Flow:
    tags = scored_tags(tweets)
    one, two = (0, 0) if by_source else (0, 1)
    start = lambda df, c: tag(df.select("ts_ms", "tweet_id", "hashtag", "score"), F.lit(c), 1 if by_source else 2, scheme, F.col("tweet_id"))
    return average_join(start(tags, one), start(tags.where("is_verified or is_blue_verified"), two), "hashtag", "score", 30 * MINUTE, 5 * MINUTE, ("avg_all", "avg_verified"))


def twitter_2(tweets: DataFrame, scheme: str = "counters") -> Flow:
    tags = scored_tags(tweets)
    rows = tag(tags, F.when(F.col("location") != "", 0).otherwise(1), 2, scheme, F.col("tweet_id")).select("hashtag", "score")
    return rows.aggregate(["hashtag"], {"avg_score": ("avg", "score")}, 6 * HOUR, HOUR)


def new_users(persons: Flow, auctions: Flow, size: int = 12 * HOUR) -> Flow:
    """nexmark_1: persons (person_id) with the number of auctions that they opened after joining, in the same window."""
    met = persons.join(auctions, "person_id", size, None, [], F.col("r.ts_ms") >= F.col("l.ts_ms"))
    return met.aggregate(["person_id"], {"n_auctions": ("count", None)}, size)


def local_items(persons: Flow, auctions: Flow, cols: list[str], size: int = 12 * HOUR) -> Flow:
    """nexmark_2: auctions of persons in the same window."""
    return persons.join(auctions, "person_id", size, None, [*[F.col(f"l.{c}") for c in cols], F.col("r.auction_id")])


def _nexmark(persons: DataFrame, auctions: DataFrame, scheme: str) -> tuple[Flow, Flow]:
    own = tag(persons, F.lit(0), 2, scheme, F.col("person_id") * 2)
    return own, tag(auctions.withColumnRenamed("seller_id", "person_id"), F.lit(1), 2, scheme, F.col("auction_id") * 2 + 1)


def nexmark_1(persons: DataFrame, auctions: DataFrame, scheme: str = "counters") -> Flow:
    return new_users(*_nexmark(persons, auctions, scheme))


def nexmark_2(persons: DataFrame, auctions: DataFrame, scheme: str = "counters") -> Flow:
    some = persons.where(F.col("state").isin("OR", "ID", "CA"))
    return local_items(*_nexmark(some, auctions.where("category = 10"), scheme), ["name", "city", "state"])


def count_sum(df: DataFrame, channels: int, scheme: str, size: int, source_id: Column | None = None) -> Flow:
    """Channel scaling: (ts_ms, key, channel, value) to count and sum for each key and window."""
    return tag(df, F.col("channel"), channels, scheme, source_id).aggregate(["key"], {"n": ("count", None), "total": ("sum", "value")}, size)


def nested(df: DataFrame, channels: int, scheme: str, size: int = 60 * SECOND) -> Flow:
    """Three levels of eight branches on the id's low nine bits; the halves of the first level's branches are counted apart and joined.
    The channel is the leaf's low bits."""
    leaf = F.col("id").bitwiseAND(F.lit(511))
    rows = tag(df.withColumn("__leaf", leaf), F.col("__leaf").bitwiseAND(F.lit(channels - 1)).cast("int"), channels, scheme, F.col("id"))
    half = lambda cond: rows.where(cond).aggregate(["key"], {"n": ("count", None), "total": ("sum", "value")}, size)
    first = F.col("__leaf").bitwiseAND(F.lit(7))
    cols = [(F.col("l.n") + F.col("r.n")).alias("n"), (F.col("l.total") + F.col("r.total")).alias("total")]
    return half(first < 4).join(half(first >= 4), "key", size, None, cols)


# --- linear road, smart grid, vehicles


def stopped(reports: Flow, key: str, reports_needed: int, size: int, slide: int) -> Flow:
    """Vehicles (key) whose reports in a window are so many and all at one position, with the latest position."""
    done = reports.aggregate([key], {"n": ("count", None), "position": ("last", "pos@ts_ms"), "positions": ("distinct", "pos")}, size, slide)
    return done.where((F.col("n") == reports_needed) & (F.col("positions") == 1))


def accidents(reports: Flow, key: str, reports_needed: int, size: int, slide: int, at: int) -> Flow:
    """Positions at which more than one vehicle is stopped in a window of `at`."""
    return stopped(reports, key, reports_needed, size, slide).aggregate(["position"], {"vehicles": ("distinct", key)}, at).where(F.col("vehicles") > 1)


def linear_road(reports: DataFrame, scheme: str = "counters") -> Flow:
    rows = reports.where("type = 0 and speed = 0").withColumn("ts_ms", F.col("time") * SECOND)
    return accidents(tag(rows, F.lit(0), 1, scheme, F.col("vid")), "vid", 4, 120 * SECOND, 30 * SECOND, 30 * SECOND)


def blackout(meters: Flow, below: float, at_least: int) -> Flow:
    """Days on which so many meters used less than that: a count over the whole day's stream."""
    daily = meters.aggregate(["meter"], {"usage": ("sum", "value")}, DAY).where(F.col("usage") < below)
    return daily.aggregate([], {"n": ("count", None)}, DAY).where(F.col("n") >= at_least)


def anomaly(meters: Flow, readings: Flow, above: float) -> Flow:
    """Meters with a day's usage over a bound that lies further than that from a reading in the day's last hour."""
    daily = meters.aggregate(["meter"], {"usage": ("sum", "value")}, DAY).where(F.col("usage") > above)
    apart = F.abs(F.col("l.usage") - F.col("r.value")).alias("apart")
    return daily.join(readings, "meter", HOUR, None, [apart, F.greatest("l.ts_ms", "r.ts_ms").alias("latest")]).where(F.col("apart") > above)


def smart_grid(readings: DataFrame, scheme: str = "counters") -> tuple[Flow, Flow]:
    """Blackouts and anomalies of hourly readings (ts in hours, meter, value); both read the one input, a reading that ends a day twice."""
    rows = readings.withColumn("ts_ms", F.col("ts") * HOUR)
    start = lambda df: tag(df, F.lit(0), 1, scheme, F.col("ts"))
    return blackout(start(rows), 1, 8), anomaly(start(rows), start(rows.where("(ts + 1) % 24 = 0")), 200)


# Metres a degree, and the region looked at.
LAT_M, LON_M = 111132.954 - 559.822 * 1 + 1.175 * 1, 111132.954 * 1
REGION = (39.912915, 39.9206835, 116.299221, 116.3188575)


def located(cars: DataFrame, scheme: str) -> Flow:
    """A flow of positions (ts_ms, car_id, lat, lon); rows with lon = -1 hold none."""
    return tag(cars.withColumn("place", F.struct("lat", "lon")), F.lit(0), 1, scheme, F.col("ts_ms"))


def fast_cars(cars: Flow, above: float = 70, instant: tuple[int, int] = (15 * SECOND, 5 * SECOND), average: tuple[int, int] = (120 * SECOND, 60 * SECOND)) -> Flow:
    """Cars whose speed between a window's first and last position is over a bound (km/h) on average of a longer window."""
    ends = cars.where(F.col("lon") != -1).aggregate(["car_id"], {"t0": ("min", "ts_ms"), "t1": ("max", "ts_ms"), "p0": ("first", "place@ts_ms"), "p1": ("last", "place@ts_ms")}, *instant)
    metres = F.sqrt(F.pow((F.col("p0.lat") - F.col("p1.lat")) * LAT_M, 2) + F.pow((F.col("p0.lon") - F.col("p1.lon")) * LON_M, 2))
    moved = ends.where(F.col("t1") > F.col("t0")).select("car_id", (metres / (F.col("t1") - F.col("t0")) * 1000 * 3.6).alias("speed"))
    return moved.aggregate(["car_id"], {"speed": ("avg", "speed")}, *average).where(F.col("speed") > above)


def cars_in_region(cars: Flow, region: tuple[float, float, float, float] = REGION, more_than: int = 9, window: tuple[int, int] = (300 * SECOND, 150 * SECOND)) -> Flow:
    """Cars seen more than so often in the region (south, north, west, east) in a window."""
    south, north, west, east = region
    inside = (F.col("lat") > south) & (F.col("lat") < north) & (F.col("lon") > west) & (F.col("lon") < east)
    return cars.where(inside).aggregate(["car_id"], {"n": ("count", None)}, *window).where(F.col("n") > more_than)


LEFT, RIGHT = "ring_front_left", "ring_front_right"


def objects(frames: Flow, label: str, reach: float | None = None) -> Flow:
    """A row for each object of the label in a frame's map of annotations, with reach only those within it to the front and side."""
    each = frames.flat_map("entry", F.map_entries("annotations"))
    found = F.col("entry.value.labelClass") == label
    if reach is not None:
        found = found & (F.abs(F.col("entry.value.x")) < reach) & (F.abs(F.col("entry.value.y")) < reach)
    return each.where(found).select("camera", F.col("entry.key").alias("object"))


def crossing(frames: Flow, size: int = 2 * SECOND, slide: int = SECOND) -> Flow:
    """Pedestrians seen by both cameras in a window: a self-join in which each row looks for the other camera's, so each pair meets twice."""
    seen = objects(frames, "PEDESTRIAN")
    other = F.when(F.col("camera") == LEFT, RIGHT).otherwise(LEFT)
    looking = seen.select("object", F.concat(other, "object").alias("seen"))
    return looking.join(seen.select(F.concat("camera", "object").alias("seen")), "seen", size, slide, [F.col("l.object")])


def cyclists(frames: Flow, above: int = 11, size: int = 6 * SECOND, slide: int = 3 * SECOND) -> Flow:
    """Cyclists near the vehicle more than so often in a window."""
    return objects(frames, "BICYCLE", 20.0).aggregate(["object"], {"n": ("count", None)}, size, slide).where(F.col("n") > above)
