"""The dataflows and operators on the star-schema tables, with the same queries in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.functions import algebra
from tallyflow.functions.time import DAY, HOUR, millis
from tallyflow.operators import provenance, sampling
from tallyflow.operators.flow import Flow, tag
from tallyflow.operators.index import TemporalIndex, mismatches, query_lengths, relative_errors, versioning, with_shares
from tallyflow.operators.tiers import TwoTier, sharded_answer
from tallyflow.plans import dataflows
from tallyflow.sources import arrival, generate, readers
from tallyflow.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    prop = F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("prop")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", prop, millis("ts").alias("ts_ms"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", millis("o_orderdate").alias("ts_ms"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_quantity", millis("l_shipdate").alias("ts_ms"))


EVENTS = "SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS prop, epoch_us(ts) // 1000 AS ts_ms FROM events"
ORDERS = "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_totalprice, epoch_us(o_orderdate) // 1000 AS ts_ms FROM orders"
LINES = "SELECT l_orderkey, l_linenumber, l_suppkey, l_returnflag, l_quantity, epoch_us(l_shipdate) // 1000 AS ts_ms FROM lineitem"


def sql_windows(src: str, size: int, slide: int) -> str:
    return f"SELECT s.*, (ts_ms // {slide} - k) * {slide} AS w FROM ({src}) s, range({size // slide}) g(k)"


def sql_aggregate(src: str, key: str, size: int, slide: int, cols: str, having: str = "true") -> str:
    names = f"{key}, " if key else ""
    return f"SELECT {names}w + {size - 1} AS ts_ms, {cols} FROM ({sql_windows(src, size, slide)}) x GROUP BY {names}w HAVING {having}"


def sql_join(left: str, right: str, key: str, size: int, slide: int, cols: str, where: str = "true") -> str:
    return f"SELECT l.{key}, l.w + {size - 1} AS ts_ms, {cols} FROM ({sql_windows(left, size, slide)}) l JOIN ({sql_windows(right, size, slide)}) r ON l.{key} = r.{key} AND l.w = r.w WHERE {where}"


# --- taxi_1: clicks and views of users, the source is the event id's parity

W1, S1 = 6 * HOUR, HOUR


def taxi_1_flow(spark: SparkSession, sf_dir: str, scheme: str, by_source: bool = False) -> Flow:
    rows, step = events(spark, sf_dir), 0 if by_source else 2
    part = lambda kind, b: tag(rows.where(F.col("event_type") == kind).select("ts_ms", "user_id", "event_id"), (F.col("event_id") % 2 + b * step).cast("int"), 2 + step, scheme, F.col("event_id")).select("user_id")
    return dataflows.count_join(part("click", 0), part("view", 1), "user_id", W1, S1)


def _taxi_1_sql(step: int) -> str:
    m = 2 + step
    marks = lambda b: ", ".join(f"count(*) FILTER (WHERE event_id % 2 + {b * step} = {i}) AS c{i}" for i in range(m))
    side = lambda kind, b, having: sql_aggregate(f"{EVENTS} WHERE event_type = '{kind}'", "user_id", W1, S1, f"count(*) AS n, {marks(b)}", having)
    sums = ", ".join(f"l.c{i} + r.c{i} AS c{i}" for i in range(m))
    return sql_join(side("click", 0, "count(*) = 1"), side("view", 1, "count(*) >= 2"), "user_id", W1, S1, f"l.n AS solo_count, r.n AS crowded_count, {sums}")


TAXI_1 = _taxi_1_sql(2)


@query(TAXI_1)
def taxi_1(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "counters").dense()


@query(_taxi_1_sql(0))
def taxi_1_by_source(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "counters", by_source=True).dense()


@query(f"SELECT user_id, ts_ms, solo_count, crowded_count FROM ({TAXI_1})")
def taxi_1_unannotated(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "none").df


@query(TAXI_1)
def taxi_1_sparse(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "sparse").dense()


@query(TAXI_1)
def taxi_1_prefix(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "prefix").dense()


@query(TAXI_1)
def taxi_1_polynomial(spark, sf_dir):
    return taxi_1_flow(spark, sf_dir, "poly").dense()


@query(f"SELECT user_id, ts_ms, solo_count, crowded_count, c0 + c1 + c2 + c3 AS leaves FROM ({TAXI_1})")
def taxi_1_graph_leaves(spark, sf_dir):
    flow = taxi_1_flow(spark, sf_dir, "graph")
    return flow.df.withColumn("leaves", algebra.leaf_count(F.col("src"))).drop("src")


def _taxi_1_sources_sql() -> str:
    side = lambda kind, having: sql_aggregate(f"{EVENTS} WHERE event_type = '{kind}'", "user_id", W1, S1, "count(*) AS n, list(event_id) AS src", having)
    return sql_join(side("click", "count(*) = 1"), side("view", "count(*) >= 2"), "user_id", W1, S1, "l.n AS solo_count, r.n AS crowded_count, list_sort(list_distinct(list_concat(l.src, r.src))) AS src")


@query(f"SELECT user_id, ts_ms, solo_count, crowded_count, array_to_string(src, ',') AS sources FROM ({_taxi_1_sources_sql()})")
def provenance_backward(spark, sf_dir):
    found = provenance.backward(taxi_1_flow(spark, sf_dir, "graph"))
    return found.withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), ","))


_SINK = "concat(user_id, ':', ts_ms, ':', solo_count, ':', crowded_count)"
_UNFOLD = f"SELECT DISTINCT {_SINK} AS sink, ts_ms, unnest(src) AS source FROM ({_taxi_1_sources_sql()})"


@query(f"SELECT DISTINCT sink, source FROM ({_UNFOLD})")
def provenance_unfold(spark, sf_dir):
    return provenance.unfold(taxi_1_flow(spark, sf_dir, "graph"), F.expr(_SINK)).distinct()


_WATERMARK, _MAX_DELAY = 1_705_300_000_000, 24 * HOUR
_FORWARD = f"""
    WITH p AS ({_UNFOLD}), e AS (SELECT event_id, ts_ms FROM ({EVENTS}) WHERE event_id IN (SELECT source FROM p))
    SELECT DISTINCT 'SINK' AS kind, sink AS id, CAST(NULL AS VARCHAR) AS other, ts_ms AS ts FROM p
    UNION ALL SELECT DISTINCT 'SOURCE', CAST(event_id AS VARCHAR), NULL, ts_ms FROM e
    UNION ALL SELECT DISTINCT 'EDGE', CAST(source AS VARCHAR), sink, NULL FROM p
    UNION ALL SELECT DISTINCT 'ACK', CAST(event_id AS VARCHAR), NULL, ts_ms FROM e WHERE ts_ms < {_WATERMARK - _MAX_DELAY}"""


def _forward(spark, sf_dir) -> DataFrame:
    return provenance.forward_graph(taxi_1_flow(spark, sf_dir, "graph"), F.expr(_SINK), events(spark, sf_dir), "event_id", "ts_ms", _WATERMARK, _MAX_DELAY)


@query(_FORWARD)
def provenance_forward(spark, sf_dir):
    return _forward(spark, sf_dir)


@query(f"""SELECT CASE kind WHEN 'EDGE' THEN 'EDGE ::: ' || id || ' -> ' || other WHEN 'ACK' THEN 'ACK ::: ' || id
           ELSE kind || ' ::: ' || id || ' ::: ' || ts END AS value FROM ({_FORWARD})""")
def provenance_text(spark, sf_dir):
    return provenance.encode_text(_forward(spark, sf_dir))


@query(f"""SELECT CASE kind WHEN 'EDGE' THEN '<edge source="' || id || '" target="' || other || '"/>'
           ELSE '<node id="' || id || '" label="' || kind || '"/>' END AS value FROM ({_FORWARD}) WHERE kind <> 'ACK'""")
def provenance_gexf(spark, sf_dir):
    return provenance.encode_gexf(_forward(spark, sf_dir))


# --- stored graphs: events as stored sources, several rows a user

_STORED = f"""SELECT user_id AS id, ts_ms AS ts, event_type AS data, event_id AS stimulus, user_id % 5 = 0 AND event_id % 50 = 0 AS sent,
              user_id % 7 = 0 AND event_id % 40 = 0 AS expired FROM ({EVENTS})"""


def _stored(spark, sf_dir) -> DataFrame:
    sent, expired = (F.expr(f"user_id % {a} = 0 AND event_id % {b} = 0") for a, b in ((5, 50), (7, 40)))
    return events(spark, sf_dir).select(F.col("user_id").alias("id"), F.col("ts_ms").alias("ts"), F.col("event_type").alias("data"), F.col("event_id").alias("stimulus"), sent.alias("sent"), expired.alias("expired"))


@query(f"SELECT * FROM ({_STORED}) WHERE NOT sent")
def stored_unsent(spark, sf_dir):
    return provenance.unsent(_stored(spark, sf_dir))


@query(f"WITH s AS ({_STORED}), f AS (SELECT id % 4 AS task, max(ts) - {2 * DAY} AS ts FROM s GROUP BY 1) SELECT * FROM s WHERE NOT expired AND ts < (SELECT min(ts) FROM f)")
def stored_acks(spark, sf_dir):
    rows = _stored(spark, sf_dir)
    return provenance.acks(rows, rows.groupBy((F.col("id") % 4).alias("task")).agg((F.max("ts") - 2 * DAY).alias("ts")))


@query(f"""WITH s AS ({_STORED}) SELECT DISTINCT ON (id) id, ts, data, stimulus, sent, expired FROM s
           WHERE id IN (SELECT id FROM s GROUP BY id HAVING bool_or(sent) = false AND bool_or(expired) = false) ORDER BY id, stimulus""")
def stored_distinct_on(spark, sf_dir):
    return provenance.distinct_on(_stored(spark, sf_dir))


@query(f"SELECT id, min(ts) AS ts, min(stimulus) AS stimulus, arg_min(data, stimulus) AS data FROM ({_STORED}) GROUP BY id HAVING max(sent) = false")
def stored_first_values(spark, sf_dir):
    return provenance.first_values(_stored(spark, sf_dir))


# --- taxi_2, twitter, nexmark


@query("SELECT user_id, ts_ms, round(a, 4) AS avg_purchase, round(b, 4) AS avg_error, c0, c1 FROM (" + sql_join(
    sql_aggregate(f"{EVENTS} WHERE event_type = 'purchase'", "user_id", W1, S1, "avg(value) AS v, count(*) AS n"),
    sql_aggregate(f"{EVENTS} WHERE event_type = 'error'", "user_id", W1, S1, "avg(value) AS v, count(*) AS n"), "user_id", W1, S1, "l.v AS a, r.v AS b, l.n AS c0, r.n AS c1") + ")")
def taxi_2(spark, sf_dir):
    return _averages(_taxi_2(spark, sf_dir, "counters").dense(), 4)


def _averages(df: DataFrame, digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in df.columns if c.startswith("avg_")})


def _taxi_2(spark, sf_dir, scheme: str) -> Flow:
    rows = events(spark, sf_dir)
    part = lambda kind, c: tag(rows.where(F.col("event_type") == kind), F.lit(c), 2, scheme, F.col("event_id")).select("user_id", "value")
    return dataflows.average_join(part("purchase", 0), part("error", 1), "user_id", "value", W1, S1, ("avg_purchase", "avg_error"))


def _tags(spark, sf_dir) -> DataFrame:
    tags = F.explode(F.filter(F.split("o_orderpriority", "-"), lambda t: t != ""))
    return orders(spark, sf_dir).select("ts_ms", "o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("score"), tags.alias("hashtag"))


TAGS = f"SELECT * FROM (SELECT ts_ms, o_orderkey, o_orderstatus, o_totalprice AS score, unnest(string_split(o_orderpriority, '-')) AS hashtag FROM ({ORDERS})) WHERE hashtag <> ''"


@query("SELECT hashtag, ts_ms, round(a, 6) AS avg_all, round(b, 6) AS avg_verified, c0, c1 FROM (" + sql_join(
    sql_aggregate(TAGS, "hashtag", 4 * DAY, 2 * DAY, "avg(score) AS v, count(*) AS n"),
    sql_aggregate(f"{TAGS} AND o_orderstatus = 'F'", "hashtag", 4 * DAY, 2 * DAY, "avg(score) AS v, count(*) AS n"), "hashtag", 4 * DAY, 2 * DAY, "l.v AS a, r.v AS b, l.n AS c0, r.n AS c1") + ")")
def twitter_1(spark, sf_dir):
    return _averages(_twitter_1(spark, sf_dir, "counters").dense(), 6)


def _twitter_1(spark, sf_dir, scheme: str) -> Flow:
    rows = _tags(spark, sf_dir)
    part = lambda df, c: tag(df, F.lit(c), 2, scheme, F.col("o_orderkey")).select("hashtag", "score")
    return dataflows.average_join(part(rows, 0), part(rows.where("o_orderstatus = 'F'"), 1), "hashtag", "score", 4 * DAY, 2 * DAY, ("avg_all", "avg_verified"))


@query("SELECT hashtag, ts_ms, round(v, 6) AS avg_score, c0, c1 FROM (" + sql_aggregate(TAGS, "hashtag", 6 * DAY, DAY, "avg(score) AS v, count(*) FILTER (WHERE o_orderstatus = 'F') AS c0, count(*) FILTER (WHERE o_orderstatus <> 'F') AS c1") + ")")
def twitter_2(spark, sf_dir):
    return _averages(_twitter_2(spark, sf_dir, "counters").dense(), 6)


def _twitter_2(spark, sf_dir, scheme: str) -> Flow:
    flow = tag(_tags(spark, sf_dir), F.when(F.col("o_orderstatus") == "F", 0).otherwise(1), 2, scheme, F.col("o_orderkey")).select("hashtag", "score")
    return flow.aggregate(["hashtag"], {"avg_score": ("avg", "score")}, 6 * DAY, DAY)


W2 = 12 * HOUR
_PERSONS, _AUCTIONS = (f"SELECT user_id AS person_id, event_id, ts_ms FROM ({EVENTS}) WHERE event_type = '{k}'" for k in ("signup", "purchase"))


def _nexmark(spark, sf_dir, persons: Column | None = None, auctions: Column | None = None, scheme: str = "counters") -> tuple[Flow, Flow]:
    rows = events(spark, sf_dir).withColumnRenamed("user_id", "person_id")
    a, b = rows.where("event_type = 'signup'"), rows.where("event_type = 'purchase'")
    a, b = a if persons is None else a.where(persons), b if auctions is None else b.where(auctions)
    return tag(a, F.lit(0), 2, scheme, F.col("event_id")), tag(b.withColumnRenamed("event_id", "auction_id"), F.lit(1), 2, scheme, F.col("auction_id"))


_NEW = sql_join(_PERSONS, _AUCTIONS, "person_id", W2, W2, "1 AS c0, 1 AS c1", "r.ts_ms >= l.ts_ms")


@query(sql_aggregate(_NEW, "person_id", W2, W2, "count(*) AS n_auctions, CAST(sum(c0) AS BIGINT) AS c0, CAST(sum(c1) AS BIGINT) AS c1"))
def nexmark_1(spark, sf_dir):
    return dataflows.new_users(*_nexmark(spark, sf_dir)).dense()


@query(sql_join(f"{_PERSONS} AND prop >= 40", f"{_AUCTIONS} AND value < 60", "person_id", W2, W2, "l.event_id, r.event_id AS auction_id, CAST(1 AS BIGINT) AS c0, CAST(1 AS BIGINT) AS c1"))
def nexmark_2(spark, sf_dir):
    """A field of props stands in for the person's state, the value for the auction's category."""
    return _nexmark_2(spark, sf_dir, "counters").dense()


def _nexmark_2(spark, sf_dir, scheme: str) -> Flow:
    return dataflows.local_items(*_nexmark(spark, sf_dir, F.col("prop") >= 40, F.col("value") < 60, scheme), ["event_id"])


def _in_scheme(flow: Callable[..., Flow], scheme: str, digits: int):
    def run(spark, sf_dir):
        found = flow(spark, sf_dir, scheme)
        if scheme == "graph":
            return _averages(found.df.withColumn("leaves", algebra.leaf_count(F.col("src"))).drop("src"), digits)
        return _averages(found.dense(), digits)

    return run


# the five dataflows in the other schemes: without annotation, with sparse counters, polynomials, and lists of sources
for _name, _flow, _digits in (
    ("taxi_2", _taxi_2, 4), ("twitter_1", _twitter_1, 6), ("twitter_2", _twitter_2, 6),
    ("nexmark_1", lambda spark, sf_dir, scheme: dataflows.new_users(*_nexmark(spark, sf_dir, scheme=scheme)), 6), ("nexmark_2", _nexmark_2, 6),
):
    query(f"SELECT * EXCLUDE (c0, c1) FROM ({SQL[_name]})", f"{_name}_unannotated")(_in_scheme(_flow, "none", _digits))
    query(SQL[_name], f"{_name}_sparse")(_in_scheme(_flow, "sparse", _digits))
    query(SQL[_name], f"{_name}_polynomial")(_in_scheme(_flow, "poly", _digits))
    query(f"SELECT * EXCLUDE (c0, c1), c0 + c1 AS leaves FROM ({SQL[_name]})", f"{_name}_graph_leaves")(_in_scheme(_flow, "graph", _digits))


# --- linear road, smart grid, vehicles

W3, S3 = 48 * HOUR, 12 * HOUR
_STOPPED = sql_aggregate(f"SELECT *, event_id % 2 AS pos FROM ({EVENTS}) WHERE event_type = 'error'", "user_id", W3, S3, "count(*) AS n, arg_max(pos, ts_ms) AS position, count(DISTINCT pos) AS positions", "count(*) = 3 AND count(DISTINCT pos) = 1")


def _reports(spark, sf_dir, scheme: str = "counters") -> Flow:
    rows = events(spark, sf_dir).where("event_type = 'error'").withColumn("pos", F.col("event_id") % 2)
    return tag(rows, F.lit(0), 1, scheme, F.col("event_id"))


@query(f"SELECT user_id, ts_ms, n, position, positions, n AS c0 FROM ({_STOPPED})")
def linear_road_stopped(spark, sf_dir):
    return dataflows.stopped(_reports(spark, sf_dir), "user_id", 3, W3, S3).dense()


@query(sql_aggregate(_STOPPED, "position", S3, S3, "count(DISTINCT user_id) AS vehicles, CAST(sum(n) AS BIGINT) AS c0", "count(DISTINCT user_id) > 1"))
def linear_road_accidents(spark, sf_dir):
    return dataflows.accidents(_reports(spark, sf_dir), "user_id", 3, W3, S3, S3).dense()


_METERS = f"SELECT l_suppkey AS meter, l_quantity AS value, ts_ms FROM ({LINES})"
_USAGE = sql_aggregate(_METERS, "meter", DAY, DAY, "sum(value) AS usage, count(*) AS c0")


def _meters(spark, sf_dir) -> Flow:
    return tag(lines(spark, sf_dir).select("ts_ms", F.col("l_suppkey").alias("meter"), F.col("l_quantity").alias("value")), F.lit(0), 1, "counters")


@query(sql_aggregate(f"SELECT * FROM ({_USAGE}) WHERE usage < 5", "", DAY, DAY, "count(*) AS n, CAST(sum(c0) AS BIGINT) AS c0", "count(*) >= 2"))
def smart_grid_blackout(spark, sf_dir):
    return dataflows.blackout(_meters(spark, sf_dir), 5, 2).dense()


@query("SELECT * FROM (" + sql_join(f"SELECT * FROM ({_USAGE}) WHERE usage > 60", f"SELECT meter, value, ts_ms + {23 * HOUR} AS ts_ms FROM ({_METERS})", "meter", HOUR, HOUR, "abs(l.usage - r.value) AS apart, greatest(l.ts_ms, r.ts_ms) AS latest, l.c0 + 1 AS c0") + ") WHERE apart > 60")
def smart_grid_anomaly(spark, sf_dir):
    meters = _meters(spark, sf_dir)
    late = lines(spark, sf_dir).select((F.col("ts_ms") + 23 * HOUR).alias("ts_ms"), F.col("l_suppkey").alias("meter"), F.col("l_quantity").alias("value"))
    return dataflows.anomaly(meters, tag(late, F.lit(0), 1, "counters"), 60).dense()


_CARS = f"SELECT user_id AS car_id, value / 1000 AS lat, event_id % 40 - 1 AS lon, ts_ms FROM ({EVENTS})"
_MOVED = f"SELECT car_id, ts_ms, c0, sqrt(pow((la0 - la1) * {dataflows.LAT_M!r}, 2) + pow((lo0 - lo1) * {dataflows.LON_M!r}, 2)) / (t1 - t0) * 1000 * 3.6 AS speed FROM (" + sql_aggregate(f"SELECT * FROM ({_CARS}) WHERE lon <> -1", "car_id", DAY, 12 * HOUR, "min(ts_ms) AS t0, max(ts_ms) AS t1, arg_min(lat, ts_ms) AS la0, arg_max(lat, ts_ms) AS la1, arg_min(lon, ts_ms) AS lo0, arg_max(lon, ts_ms) AS lo1, count(*) AS c0", "max(ts_ms) > min(ts_ms)") + ")"


def _cars(spark, sf_dir) -> Flow:
    cars = events(spark, sf_dir).select("ts_ms", F.col("user_id").alias("car_id"), (F.col("value") / 1000).alias("lat"), (F.col("event_id") % 40 - 1).alias("lon"))
    return dataflows.located(cars, "counters")


@query("SELECT car_id, ts_ms, round(speed, 5) AS speed, c0 FROM (" + sql_aggregate(_MOVED, "car_id", 2 * DAY, DAY, "avg(speed) AS speed, CAST(sum(c0) AS BIGINT) AS c0", "avg(speed) > 70") + ")")
def vehicles_fast(spark, sf_dir):
    flow = dataflows.fast_cars(_cars(spark, sf_dir), 70, (DAY, 12 * HOUR), (2 * DAY, DAY))
    return flow.dense().withColumn("speed", F.round("speed", 5))


@query(sql_aggregate(f"SELECT * FROM ({_CARS}) WHERE lat > 0.01 AND lat < 0.09 AND lon > 5 AND lon < 30", "car_id", 6 * DAY, 3 * DAY, "count(*) AS n, count(*) AS c0", "count(*) > 4"))
def vehicles_in_region(spark, sf_dir):
    return dataflows.cars_in_region(_cars(spark, sf_dir), (0.01, 0.09, 5, 30), 4, (6 * DAY, 3 * DAY)).dense()


def _frames(spark, sf_dir, scheme: str) -> Flow:
    rows = events(spark, sf_dir)
    label = F.when(F.col("event_type").isin("click", "view"), "PEDESTRIAN").otherwise("BICYCLE")
    note = F.struct(label.alias("labelClass"), F.lit(0.0).alias("x"), (F.col("event_id") % 50 - 25).cast("double").alias("y"), F.lit(0.0).alias("z"))
    camera = F.when(F.col("event_id") % 2 == 0, dataflows.LEFT).otherwise(dataflows.RIGHT)
    frames = rows.select("ts_ms", "event_id", camera.alias("camera"), F.create_map(F.col("user_id").cast("string"), note).alias("annotations"))
    return tag(frames, (F.col("event_id") % 2).cast("int"), 2, scheme, F.col("event_id"))


_SEEN = f"SELECT CAST(user_id AS VARCHAR) AS object, event_id % 2 AS cam, ts_ms FROM ({EVENTS}) WHERE event_type IN ('click', 'view')"


@query("SELECT CASE cam WHEN 0 THEN 'ring_front_right' ELSE 'ring_front_left' END || object AS seen, object, ts_ms, CAST(1 AS BIGINT) AS c0, CAST(1 AS BIGINT) AS c1 FROM (" + sql_join(_SEEN, _SEEN, "object", 6 * HOUR, 3 * HOUR, "l.cam", "l.cam <> r.cam") + ")")
def vehicles_crossing(spark, sf_dir):
    return dataflows.crossing(_frames(spark, sf_dir, "counters"), 6 * HOUR, 3 * HOUR).dense()


@query(sql_aggregate(f"SELECT CAST(user_id AS VARCHAR) AS object, event_id, ts_ms FROM ({EVENTS}) WHERE event_type NOT IN ('click', 'view') AND abs(event_id % 50 - 25) < 20", "object", 2 * DAY, DAY, "count(*) AS n, count(*) FILTER (WHERE event_id % 2 = 0) AS c0, count(*) FILTER (WHERE event_id % 2 = 1) AS c1", "count(*) > 4"))
def vehicles_cyclists(spark, sf_dir):
    return dataflows.cyclists(_frames(spark, sf_dir, "counters"), 4, 2 * DAY, DAY).dense()


# --- channel scaling: return flags by month, the channel is the supplier

W4 = 30 * DAY


def _scale_sql(m: int) -> str:
    per = ", ".join(f"count(*) FILTER (WHERE l_suppkey % {m} = {i})" for i in range(m))
    return f"SELECT l_returnflag AS key, w + {W4 - 1} AS ts_ms, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, array_to_string([{per}], ';') AS counters FROM ({sql_windows(LINES, W4, W4)}) x GROUP BY l_returnflag, w"


def _scale(m: int, scheme: str):
    def run(spark, sf_dir):
        rows = lines(spark, sf_dir).select("ts_ms", F.col("l_returnflag").alias("key"), F.pmod("l_suppkey", F.lit(m)).cast("int").alias("channel"), F.col("l_quantity").cast("bigint").alias("value"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
        flow = dataflows.count_sum(rows, m, scheme, W4, F.col("id"))
        text = F.array_join(F.transform(flow.counters(), lambda x: x.cast("string")), ";")
        return flow.df.select("key", "ts_ms", "n", "total", text.alias("counters"))

    return run


for _m, _scheme in ((2, "counters"), (8, "counters"), (64, "counters"), (8, "sparse"), (64, "sparse"), (8, "prefix"), (64, "prefix"), (8, "poly"), (512, "sparse")):
    query(_scale_sql(_m), f"channels_{_m}_{_scheme}")(_scale(_m, _scheme))


@query(f"""SELECT l_returnflag AS key, w + {W4 - 1} AS ts_ms, count(*) FILTER (WHERE l_suppkey % 2 = 1) AS level1_of_1, count(*) FILTER (WHERE l_suppkey % 4 = 2) AS level2_of_2, count(*) AS root, true AS consistent
           FROM ({sql_windows(LINES, W4, W4)}) x GROUP BY l_returnflag, w""")
def prefix_counts(spark, sf_dir):
    rows = lines(spark, sf_dir).select("ts_ms", F.col("l_returnflag").alias("key"), F.pmod("l_suppkey", F.lit(8)).cast("int").alias("channel"), F.lit(0).cast("bigint").alias("value"))
    trie = F.col("hm")
    flow = dataflows.count_sum(rows, 8, "prefix", W4)
    counts = {"level1_of_1": (1, 1), "level2_of_2": (2, 2), "root": (0, 0)}
    return flow.df.select("key", "ts_ms", *[algebra.prefix_count(trie, *x).alias(n) for n, x in counts.items()], algebra.trie_consistent(trie, 3).alias("consistent"))


def _nested_sql(m: int) -> str:
    per = ", ".join(f"count(*) FILTER (WHERE (id & 511) & {m - 1} = {i}) AS c{i}" for i in range(m))
    src = f"SELECT event_id AS id, user_id % 20 AS key, CAST(value AS BIGINT) AS value, ts_ms FROM ({EVENTS})"
    half = lambda cond: sql_aggregate(f"SELECT * FROM ({src}) WHERE (id & 7) {cond}", "key", DAY, DAY, f"count(*) AS n, CAST(sum(value) AS BIGINT) AS total, {per}")
    return sql_join(half("< 4"), half(">= 4"), "key", DAY, DAY, "l.n + r.n AS n, l.total + r.total AS total, " + ", ".join(f"l.c{i} + r.c{i} AS c{i}" for i in range(m)))


def _nested_rows(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select("ts_ms", F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("key"), F.floor("value").cast("bigint").alias("value"))


_NESTED = {m: _nested_sql(m).replace("CAST(value AS BIGINT)", "CAST(floor(value) AS BIGINT)") for m in (8, 64, 512)}


@query(_NESTED[8])
def nested_paths(spark, sf_dir):
    return dataflows.nested(_nested_rows(spark, sf_dir), 8, "counters", DAY).dense()


@query(f"SELECT key, ts_ms, n, total FROM ({_NESTED[8]})")
def nested_paths_unannotated(spark, sf_dir):
    return dataflows.nested(_nested_rows(spark, sf_dir), 8, "none", DAY).df


def _nested_text(m: int, scheme: str):
    def run(spark, sf_dir):
        flow = dataflows.nested(_nested_rows(spark, sf_dir), m, scheme, DAY)
        text = F.array_join(F.transform(flow.counters(), lambda x: x.cast("string")), ";")
        return flow.df.select("key", "ts_ms", "n", "total", text.alias("counters"))

    return run


for _m, _scheme in ((64, "counters"), (512, "sparse")):
    query(f"SELECT key, ts_ms, n, total, concat_ws(';', {', '.join(f'c{i}' for i in range(_m))}) AS counters FROM ({_NESTED[_m]})", f"nested_paths_{_m}")(_nested_text(_m, _scheme))


def _real_sql(m: int) -> str:
    per = ", ".join(f"count(*) FILTER (WHERE event_id % {m} = {i})" for i in range(m))
    return f"SELECT user_id AS key, w + {DAY - 1} AS ts_ms, count(*) AS n, CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS total, array_to_string([{per}], ';') AS counters FROM ({sql_windows(EVENTS, DAY, DAY)}) x GROUP BY user_id, w"


def _real(m: int, scheme: str):
    """The real-scale view of a table: time, key, channel, and a value in hundredths, counted and summed for each key and day."""

    def run(spark, sf_dir):
        rows = events(spark, sf_dir).select("ts_ms", F.col("user_id").alias("key"), F.pmod("event_id", F.lit(m)).cast("int").alias("channel"), F.floor(F.col("value") * 100).cast("bigint").alias("value"), F.col("event_id").alias("id"))
        flow = dataflows.count_sum(rows, m, scheme, DAY, F.col("id"))
        return flow.df.select("key", "ts_ms", "n", "total", F.array_join(F.transform(flow.counters(), lambda x: x.cast("string")), ";").alias("counters"))

    return run


for _m, _scheme in ((8, "counters"), (64, "sparse")):
    query(_real_sql(_m), f"real_scale_{_m}")(_real(_m, _scheme))


# --- temporal index over orders: one output an order, in the channel of its status

_OUT = f"SELECT ts_ms, CAST(o_orderstatus = 'F' AS BIGINT) AS c0, CAST(o_orderstatus = 'O' AS BIGINT) AS c1, CAST(o_orderstatus = 'P' AS BIGINT) AS c2, o_orderkey FROM ({ORDERS})"
_FIRST = 788_918_400_000
_ASKED = f"SELECT i AS query_id, {_FIRST} + i * {11 * DAY} - {100 * DAY} AS lo, {_FIRST} + i * {11 * DAY} - {100 * DAY} + (i % 9) * {5 * DAY} - {DAY} AS hi FROM range(300) g(i)"
_SUMS = ", ".join(f"CAST(coalesce(sum(c{i}), 0) AS BIGINT) AS c{i}" for i in range(3)) + ", count(c0) AS n, count(c0) > 0 AS is_defined"


def _answer_sql(out: str = _OUT, asked: str = _ASKED) -> str:
    return f"SELECT query_id, lo, hi, {_SUMS} FROM ({asked}) q LEFT JOIN ({out}) o ON o.ts_ms BETWEEN q.lo AND q.hi GROUP BY query_id, lo, hi"


def outputs(spark, sf_dir) -> DataFrame:
    return orders(spark, sf_dir).select("ts_ms", *[(F.col("o_orderstatus") == s).cast("bigint").alias(f"c{i}") for i, s in enumerate("FOP")], "o_orderkey")


def asked(spark, n: int = 300, shift: int = 0) -> DataFrame:
    lo = F.lit(_FIRST - 100 * DAY + shift) + F.col("id") * (11 * DAY)
    return spark.range(n).select(F.col("id").alias("query_id"), lo.alias("lo"), (lo + F.col("id") % 9 * (5 * DAY) - DAY).alias("hi"))


@query(_answer_sql())
def index_how_much(spark, sf_dir):
    return TemporalIndex.build(outputs(spark, sf_dir), 3).answer(asked(spark))


@query(f"SELECT query_id, lo, hi, c0, c1, c2, n, is_defined, " + ", ".join(f"round(CASE WHEN c0 + c1 + c2 > 0 THEN c{i} / (c0 + c1 + c2) END, 9) AS share{i}" for i in range(3)) + f" FROM ({_answer_sql()})")
def index_shares(spark, sf_dir):
    return with_shares(TemporalIndex.build(outputs(spark, sf_dir), 3).answer(asked(spark)), 3).withColumns({f"share{i}": F.round(f"share{i}", 9) for i in range(3)})


_LATER = _ASKED.replace(f"- {100 * DAY}", f"- {100 * DAY} + {365 * DAY}")


@query(f"WITH a AS ({_answer_sql()}), b AS ({_answer_sql(asked=_LATER)}) SELECT a.query_id, " + ", ".join(
    f"CASE WHEN a.is_defined AND b.is_defined THEN b.c{i} - a.c{i} END AS delta{i}, round(CASE WHEN a.is_defined AND b.is_defined THEN b.c{i} / (b.c0 + b.c1 + b.c2) - a.c{i} / (a.c0 + a.c1 + a.c2) END, 9) AS delta_share{i}" for i in range(3)
) + ", a.is_defined AND b.is_defined AS is_defined FROM a JOIN b USING (query_id)")
def index_versioning(spark, sf_dir):
    index = TemporalIndex.build(outputs(spark, sf_dir), 3)
    found = versioning(index.answer(asked(spark)), index.answer(asked(spark, shift=365 * DAY)), 3)
    return found.withColumns({f"delta_share{i}": F.round(f"delta_share{i}", 9) for i in range(3)})


_HORIZON = _FIRST + 900 * DAY
_AFTER = f"SELECT * FROM ({_ASKED}) WHERE lo >= {_HORIZON}"


@query(_answer_sql(asked=_AFTER))
def index_expired(spark, sf_dir):
    index = TemporalIndex.build(outputs(spark, sf_dir), 3).expire_before(_HORIZON)
    return index.answer(asked(spark).where(F.col("lo") >= _HORIZON))


@query(f"SELECT query_id, lo, hi, " + ", ".join(f"CASE WHEN lo >= {_HORIZON} THEN {c} END AS {c}" for c in ("c0", "c1", "c2", "n")) + f", is_defined AND lo >= {_HORIZON} AS is_defined FROM ({_answer_sql()})")
def index_across_horizon(spark, sf_dir):
    """Ranges before, across and after the horizon: of those that begin before it, a part is gone."""
    return TemporalIndex.build(outputs(spark, sf_dir), 3).expire_before(_HORIZON).answer(asked(spark))


_WIDTH = 30 * DAY
_SUMMARIZED = f"""
    WITH o AS ({_OUT}), f AS (SELECT min(ts_ms) AS first FROM o), u AS (SELECT first, first + ({_HORIZON} - first) // {_WIDTH} * {_WIDTH} AS until FROM f),
         b AS (SELECT first + (ts_ms - first) // {_WIDTH} * {_WIDTH} AS s, sum(c0) AS c0, sum(c1) AS c1, sum(c2) AS c2, count(*) AS n FROM o, u WHERE ts_ms < until GROUP BY 1),
         p AS (SELECT s, s + {_WIDTH - 1} AS e, c0, c1, c2, n FROM b UNION ALL SELECT ts_ms, ts_ms, c0, c1, c2, 1 FROM o, u WHERE ts_ms >= until)
    SELECT query_id, lo, hi, {{}} FROM ({_ASKED}) q LEFT JOIN p ON p.s <= q.hi AND p.e >= q.lo AND q.lo <= q.hi GROUP BY query_id, lo, hi""".format(
    ", ".join(f"round(coalesce(sum({c} * (least(hi, e) - greatest(lo, s) + 1) / (e - s + 1)), 0), 4) AS {c}" for c in ("c0", "c1", "c2", "n"))
)


@query(_SUMMARIZED)
def index_summarized(spark, sf_dir):
    index = TemporalIndex.build(outputs(spark, sf_dir), 3).summarize_before(_HORIZON, _WIDTH)
    return index.answer(asked(spark)).select("query_id", "lo", "hi", *[F.round(c, 4).alias(c) for c in ("c0", "c1", "c2", "n")])


@query(f"SELECT count(DISTINCT ts_ms) AS records, CAST(count(DISTINCT ts_ms) * 32 AS BIGINT) AS bytes FROM ({_OUT})")
def index_memory(spark, sf_dir):
    return TemporalIndex.build(outputs(spark, sf_dir), 3).memory()


@query(f"SELECT count(*) AS n FROM ({_OUT}) WHERE ts_ms BETWEEN {_FIRST} AND {_FIRST + 100 * DAY}")
def index_count_in(spark, sf_dir):
    return TemporalIndex.build(outputs(spark, sf_dir), 3).count_in(_FIRST, _FIRST + 100 * DAY)


_INSIDE = f"SELECT query_id, greatest(lo, {_HORIZON}) AS lo, greatest(hi, {_HORIZON}) AS hi FROM ({_ASKED})"
_NEW_ONLY = f"SELECT * FROM ({_OUT}) WHERE ts_ms >= {_HORIZON}"


@query(f"SELECT count(*) AS queries, count(*) FILTER (WHERE a.n <> b.n OR a.c0 <> b.c0 OR a.c1 <> b.c1 OR a.c2 <> b.c2) AS mismatches FROM ({_answer_sql(asked=_INSIDE)}) a JOIN ({_answer_sql(_NEW_ONLY, _INSIDE)}) b USING (query_id)")
def index_expiry_check(spark, sf_dir):
    """Ranges after the horizon, asked of the whole and of the expired index."""
    index = TemporalIndex.build(outputs(spark, sf_dir), 3)
    inside = asked(spark).withColumns({"lo": F.greatest("lo", F.lit(_HORIZON)), "hi": F.greatest("hi", F.lit(_HORIZON))})
    return mismatches(index.answer(inside), index.expire_before(_HORIZON).answer(inside), 3)


_ERRORS = " UNION ALL ".join(f"SELECT abs(a.c{i} - b.c{i}) / greatest(1, b.c{i}) AS e FROM a JOIN b USING (query_id)" for i in range(3))


@query(f"WITH a AS ({_SUMMARIZED.replace(', 4) AS', ', 12) AS')}), b AS ({_answer_sql()}) SELECT round(avg(e), 6) AS mean_error, round(max(e), 6) AS max_error FROM ({_ERRORS})")
def index_summary_error(spark, sf_dir):
    index = TemporalIndex.build(outputs(spark, sf_dir), 3)
    found = relative_errors(index.summarize_before(_HORIZON, _WIDTH).answer(asked(spark)), index.answer(asked(spark)), 3)
    return found.select(*[F.round(c, 6).alias(c) for c in ("mean_error", "max_error")])


@query()
def index_query_lengths(spark, sf_dir):
    index = TemporalIndex.build(outputs(spark, sf_dir), 3)
    ranges = query_lengths(index, [DAY, 10 * DAY, 100 * DAY], 100)
    return index.answer(ranges).join(ranges.select("query_id", "length"), "query_id").groupBy("length").agg(F.count(F.lit(1)).alias("queries"), F.sum("n").alias("outputs"))


_MARK = _FIRST + 1500 * DAY


_EARLY = f"SELECT * FROM ({_OUT}) WHERE o_orderkey % 3 <> 0"


@query(f"SELECT count(*) AS queries, count(*) FILTER (WHERE a.c0 > b.c0 OR a.c1 > b.c1 OR a.c2 > b.c2) AS above FROM ({_answer_sql(_EARLY)}) a JOIN ({_answer_sql()}) b USING (query_id)")
def tiers_provisional_below_final(spark, sf_dir):
    """Provisional answers, asked before the rest of the outputs came, are never above the final ones."""
    rows = outputs(spark, sf_dir)
    early = TwoTier.empty(rows, 3).add(rows.where("o_orderkey % 3 <> 0"))
    late = early.add(rows.where("o_orderkey % 3 = 0")).advance(_MARK * 2)
    both = early.answer(asked(spark)).alias("a").join(late.answer(asked(spark)).alias("b"), "query_id")
    above = (F.col("a.c0") > F.col("b.c0")) | (F.col("a.c1") > F.col("b.c1")) | (F.col("a.c2") > F.col("b.c2"))
    return both.agg(F.count(F.lit(1)).alias("queries"), F.count_if(above).alias("above"))


@query(f"SELECT *, hi <= {_MARK} AS is_final FROM ({_answer_sql(f'SELECT * FROM ({_OUT}) WHERE NOT (o_orderkey % 4 = 0 AND ts_ms <= {_MARK})')})")
def tiers_answer(spark, sf_dir):
    rows = outputs(spark, sf_dir)
    tiers = TwoTier.empty(rows, 3).add(rows.where("o_orderkey % 4 <> 0")).advance(_MARK).add(rows.where("o_orderkey % 4 = 0"))  # late ones are left out
    return tiers.answer(asked(spark))


@query(f"SELECT *, hi <= {_MARK - 2 * DAY} AS is_final FROM ({_answer_sql()})")
def sharded(spark, sf_dir):
    rows = outputs(spark, sf_dir).withColumn("shard", F.col("o_orderkey") % 3)
    marks = spark.range(3).select(F.col("id").alias("shard"), (F.lit(_MARK) - F.col("id") * DAY).alias("watermark"))
    return sharded_answer(rows, marks, asked(spark), 3)


# --- sources, sampling, state

_TWO64, _TWO63 = (f"CAST({1 << n} AS HUGEINT)" for n in (64, 63))


def sql_fnv(text: str) -> str:
    """FNV-1a of an ASCII text, as an unsigned number."""
    items = f"list_prepend(CAST(14695981039346656037 AS HUGEINT), list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS HUGEINT)))"
    return f"list_reduce({items}, lambda h, b: xor(h, b) * CAST(1099511628211 AS HUGEINT) % {_TWO64})"


def sql_coin(text: str, probability: float) -> str:
    return f"{sql_fnv(text)} // 2048 < {int(probability * (1 << 53))}"


@query("""SELECT p_partkey, CASE WHEN lon >= -74.02 AND lon < -73.92 AND lat >= 40.70 AND lat < 40.88 THEN 0 WHEN lon >= -73.92 AND lat < 40.80 THEN 1 ELSE -1 END AS borough
          FROM (SELECT p_partkey, CAST(-74.05 AS DOUBLE) + (p_partkey % 1000 % 40 + 0.5) * (CAST(-73.75 AS DOUBLE) + CAST(74.05 AS DOUBLE)) / 40 AS lon,
                CAST(40.58 AS DOUBLE) + (p_partkey % 1000 // 40 + 0.5) * (CAST(40.92 AS DOUBLE) - CAST(40.58 AS DOUBLE)) / 25 AS lat FROM part)""")
def taxi_boroughs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", readers.borough(F.col("p_partkey") % 1000).alias("borough"))


@query(f"SELECT event_id + r * (SELECT count(*) FROM events) AS event_id, ts_ms + r * ((SELECT max(ts_ms) FROM ({EVENTS})) + 1) AS ts_ms FROM ({EVENTS}), range(3) g(r)")
def repeated_source(spark, sf_dir):
    return generate.repeated(events(spark, sf_dir).select("event_id", "ts_ms"), 3, "ts_ms", "event_id")


@query(f"SELECT event_id, row_number() OVER (ORDER BY ts_ms, event_id) - 1 AS line, CAST((row_number() OVER (ORDER BY ts_ms, event_id) - 1) % 4 AS INTEGER) AS reader FROM ({EVENTS})")
def partitioned_reader(spark, sf_dir):
    rows = arrival.numbered(events(spark, sf_dir), "ts_ms", ["event_id"])
    return rows.select("event_id", "line", arrival.reader_of(F.col("line"), 4).alias("reader"))


@query()
def zipf_keys(spark, sf_dir):
    rank = arrival.zipf_rank(F.col("event_id"), 1000, 1.1, 42)
    return events(spark, sf_dir).select(rank.alias("rank")).groupBy("rank").agg(F.count(F.lit(1)).alias("n"))


@query()
def sample_bottom_k(spark, sf_dir):
    return sampling.bottom_k(events(spark, sf_dir), "event_id", 100, 42)


@query(f"SELECT event_id, user_id FROM ({EVENTS}) WHERE {sql_coin('CAST(user_id AS VARCHAR)', 0.2)}")
def sample_bernoulli(spark, sf_dir):
    return sampling.bernoulli(events(spark, sf_dir), F.col("user_id"), 0.2).select("event_id", "user_id")


@query(f"SELECT * FROM ({TAXI_1}) WHERE {sql_coin("user_id || ':' || ts_ms", 0.3)}")
def sampled_provenance(spark, sf_dir):
    return sampling.sampled_answers(taxi_1_flow(spark, sf_dir, "counters"), F.concat_ws(":", "user_id", "ts_ms"), 0.3)


@query(f"SELECT l.user_id, greatest(l.ts_ms, r.ts_ms) AS ts_ms, l.event_id AS click, r.event_id AS purchase, CAST(1 AS BIGINT) AS c0, CAST(1 AS BIGINT) AS c1 FROM ({EVENTS}) l JOIN ({EVENTS}) r ON l.user_id = r.user_id AND r.ts_ms - l.ts_ms BETWEEN {-HOUR} AND {5 * HOUR} WHERE l.event_type = 'click' AND r.event_type = 'purchase'")
def interval_join(spark, sf_dir):
    rows = events(spark, sf_dir)
    part = lambda kind, c: tag(rows.where(F.col("event_type") == kind), F.lit(c), 2, "counters").select("user_id", "event_id")
    cols = [F.col("l.event_id").alias("click"), F.col("r.event_id").alias("purchase")]
    return part("click", 0).interval_join(part("purchase", 1), "user_id", -HOUR, 5 * HOUR, cols).dense()


@query()
def output_digests(spark, sf_dir):
    return sampling.digests(taxi_1(spark, sf_dir), "ts_ms", ["user_id", "ts_ms", "solo_count", "crowded_count"])


_COLUMNS = "solo_count, crowded_count, c0, c1, c2, c3"


@query(f"""SELECT 'taxi_1' AS operator, ts_ms AS window_end, user_id AS key, row_number() OVER (PARTITION BY ts_ms, user_id ORDER BY {_COLUMNS}) - 1 AS ordinal,
           CAST(CASE WHEN h >= {_TWO63} THEN h - {_TWO64} ELSE h END AS BIGINT) AS row_hash FROM (SELECT *, {sql_fnv(f"concat_ws(',', {_COLUMNS})")} AS h FROM ({TAXI_1}))""")
def output_log(spark, sf_dir):
    return sampling.output_ids(taxi_1(spark, sf_dir), "taxi_1", "ts_ms", "user_id", ["solo_count", "crowded_count", "c0", "c1", "c2", "c3"])


@query(f"""WITH x AS (SELECT user_id, w, min(ts_ms) AS a FROM ({sql_windows(f"{EVENTS} WHERE event_type = 'click'", W1, S1)}) GROUP BY user_id, w),
           d AS (SELECT a AS t, 32 AS d FROM x UNION ALL SELECT w + {W1}, -32 FROM x), s AS (SELECT t, sum(d) AS d FROM d GROUP BY t)
           SELECT t AS at, bytes, max(bytes) OVER (ORDER BY t) AS peak FROM (SELECT t, CAST(sum(d) OVER (ORDER BY t) AS BIGINT) AS bytes FROM s)""")
def live_state(spark, sf_dir):
    return sampling.live_state(events(spark, sf_dir).where("event_type = 'click'"), "ts_ms", ["user_id"], W1, S1, 32)


@query(f"SELECT count(*) AS n FROM ({TAXI_1})")
def taxi_1_cardinality(spark, sf_dir):
    return sampling.cardinality(taxi_1(spark, sf_dir))


@query(f"SELECT CAST(count(*) * 32 AS BIGINT) AS counters, CAST(sum(CAST(c0 > 0 AS INT) + CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT) + CAST(c3 > 0 AS INT)) * 12 AS BIGINT) AS sparse, CAST(sum(c0 + c1 + c2 + c3) * 12 AS BIGINT) AS polynomial, CAST(sum(c0 + c1 + c2 + c3) * 32 AS BIGINT) AS graph FROM ({TAXI_1})")
def memory_model(spark, sf_dir):
    cells = [F.col(f"c{i}") for i in range(4)]
    pairs = sum((c > 0).cast("int") for c in cells)
    facts = taxi_1(spark, sf_dir).agg(F.count(F.lit(1)).alias("outputs"), F.sum(pairs).cast("bigint").alias("pairs"), F.sum(sum(cells)).cast("bigint").alias("contributors"))
    return sampling.memory_model(facts, 4)


# --- streams

#: Micro-batches that the events are replayed in.
REPLAYED = 6


def _late_sql() -> str:
    delayed = f"SELECT *, ts_ms + event_id * 7919 % {8 * HOUR} AS arrival FROM ({EVENTS})"
    batch = f"SELECT *, (row_number() OVER (ORDER BY arrival, event_id) - 1) // 200 AS batch FROM ({delayed})"
    marks = f"SELECT batch, max(m) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {HOUR} AS mark FROM (SELECT batch, max(ts_ms) AS m FROM b GROUP BY batch)"
    missed = f"SELECT count(*) FILTER (WHERE (ts_ms // {S1} - k) * {S1} + {W1} <= mark) AS missed FROM b JOIN m USING (batch), range({W1 // S1}) g(k) GROUP BY event_id"
    return f"WITH b AS ({batch}), m AS ({marks}), x AS ({missed}) SELECT count(*) AS records, count(*) FILTER (WHERE missed = {W1 // S1}) AS late, count(*) FILTER (WHERE missed BETWEEN 1 AND {W1 // S1 - 1}) AS partly_missed FROM x"


def _batches(spark, sf_dir, size: int) -> DataFrame:
    rows = events(spark, sf_dir).withColumn("arrival", F.col("ts_ms") + F.col("event_id") * 7919 % (8 * HOUR))
    return arrival.batches(rows, size, ["event_id"])


@query(_late_sql())
def stream_late_records(spark, sf_dir):
    return jobs.late_counts(_batches(spark, sf_dir, 200), W1, S1, HOUR)


@query(TAXI_1)
def stream_taxi_1(spark, sf_dir):
    """The flagship as a stream, replayed out of order within the watermark's delay, in REPLAYED batches whatever the size: equal to the
    batch run."""
    rows = _batches(spark, sf_dir, -(-max(1, events(spark, sf_dir).count()) // REPLAYED)).drop("arrival", "value", "prop")
    far = 4_102_444_800_000
    last = lambda i: spark.range(4).select(F.lit(-1).cast("bigint").alias("event_id"), F.lit(-1).cast("bigint").alias("user_id"), F.when(F.col("id") % 2 == 0, "click").otherwise("view").alias("event_type"), (F.lit(far + i * 10 * DAY)).cast("bigint").alias("ts_ms"))
    stream = jobs.replayed(spark, rows, last, "9 hours")
    marks = [f"c{i}" for i in range(4)]
    side = lambda kind, b: stream.where(F.col("event_type") == kind).select("ts", "user_id", *[(F.col("event_id") % 2 + 2 * b == i).cast("bigint").alias(f"c{i}") for i in range(4)])
    joined = jobs.count_join(side("click", 0), side("view", 1), "user_id", marks, "6 hours", "1 hour")
    return jobs.collected(joined, "stream-taxi-1").where("user_id >= 0")
