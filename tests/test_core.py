import argparse
import random
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyflow import cli
from tallyflow.functions import algebra, hashing
from tallyflow.functions.time import millis, window_starts
from tallyflow.operators import provenance, sampling
from tallyflow.operators.flow import tag
from tallyflow.operators.index import TemporalIndex, versioning, with_shares
from tallyflow.operators.tiers import TwoTier, sharded_answer
from tallyflow.plans import dataflows, star
from tallyflow.sources import arrival, generate, readers, sinks
from tallyflow.streaming import jobs, monitor

GOLDEN = [(1, 1, 4), (2, 1, 4), (3, 1, 2), (4, 3, 3), (5, 3, 0), (6, 2, 1)]


def outputs(spark, rows):
    return spark.createDataFrame(rows, "ts_ms bigint, c0 bigint, c1 bigint")


def one(df, *names):
    return tuple(df.select(*names).first())


def value(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


# --- the index: golden values


def test_range_sums(spark):
    for bucket in (1, 2, 1000):
        index = TemporalIndex.build(outputs(spark, GOLDEN), 2, bucket=bucket)
        assert one(index.how_much(3, 5), "c0", "c1", "n", "is_defined") == (7, 5, 3, True)
        assert one(index.how_much(-5, 0), "c0", "c1", "is_defined") == (0, 0, False)
        assert one(index.scan(3, 5), "c0", "c1") == (7, 5)
    with pytest.raises(ValueError):
        index.how_much(5, 3)
    assert index.count_in(5, 3).first().n == 0 and index.count_in(1, 6).first().n == 6


def test_random_ranges_equal_direct_sums(spark):
    r = random.Random(4)
    rows = [(r.randint(-50, 400), r.randint(0, 5), r.randint(0, 5)) for _ in range(300)]
    asked = [(i, a := r.randint(-80, 430), a + r.randint(-3, 90)) for i in range(200)]
    queries = spark.createDataFrame(asked, "query_id int, lo bigint, hi bigint")
    found = {x.query_id: x for x in TemporalIndex.build(outputs(spark, rows), 2, bucket=37).answer(queries).collect()}
    for i, a, b in asked:
        hit = [x for x in rows if a <= x[0] <= b]
        assert (found[i].c0, found[i].c1, found[i].n, found[i].is_defined) == (sum(x[1] for x in hit), sum(x[2] for x in hit), len(hit), bool(hit))


def test_saved_index_answers_alike(spark, tmp_path):
    index = TemporalIndex.build(outputs(spark, GOLDEN), 2, bucket=2).save(str(tmp_path / "i"))
    assert one(index.how_much(3, 5), "c0", "c1") == (7, 5) and index.digest().first() == TemporalIndex.build(outputs(spark, GOLDEN[::-1]), 2).digest().first()


def test_summaries_interpolate(spark):
    index = TemporalIndex.build(outputs(spark, GOLDEN), 2).summarize_before(4, 3)
    assert index.buckets.rows.count() == 1
    got = one(index.how_much(3, 5), "c0", "c1")
    assert got == pytest.approx((7, 19 / 3))
    assert tuple(index.memory().first()) == (3, 1, 3 * 24 + 32)
    assert one(index.how_much(1, 6), "c0", "c1") == (11, 14)


def test_expiry(spark):
    index = TemporalIndex.build(outputs(spark, GOLDEN), 2).expire_before(4)
    assert index.records().first().records == 3 and one(index.how_much(4, 6), "c0", "c1") == (8, 4)
    with pytest.raises(ValueError):
        index.how_much(2, 5)


def test_answers_after_expiry_are_undefined_before_the_horizon(spark):
    whole = TemporalIndex.build(outputs(spark, GOLDEN), 2)
    ask = spark.createDataFrame([(0, 2, 5), (1, 4, 6), (2, 1, 3), (3, 5, 5)], "query_id int, lo bigint, hi bigint")
    for index in (whole.expire_before(4), whole.expire_before(4).summarize_before(5, 1)):
        rows = {r.query_id: (r.c0, r.c1, r.n, r.is_defined) for r in index.answer(ask).collect()}
        assert rows == {0: (None, None, None, False), 1: (8, 4, 3, True), 2: (None, None, None, False), 3: (3, 0, 1, True)}
    deltas = versioning(whole.expire_before(4).answer(ask), whole.answer(ask), 2).orderBy("query_id").collect()
    assert [r.is_defined for r in deltas] == [False, True, False, True] and deltas[0].delta0 is None


def test_look_ups_in_a_saved_index_read_the_folders_of_their_bounds(spark, tmp_path):
    rows = [(day * 10 + k, 1, k) for day in range(50) for k in range(5)]
    index = TemporalIndex.build(outputs(spark, rows), 2, bucket=10).save(str(tmp_path / "i"))
    ask = spark.createDataFrame([(0, 100, 304)], "query_id int, lo bigint, hi bigint")
    found = index.answer(ask)
    assert one(found, "c0", "c1", "n") == (105, 210, 105)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    before = sum(1 for _ in (tmp_path / "i" / "rows").glob("bucket=*"))
    assert before == 50


def test_append_goes_on_from_the_last_sums(spark):
    index = TemporalIndex.build(outputs(spark, GOLDEN[:3]), 2, bucket=2)
    grown = index.append(outputs(spark, GOLDEN[3:5])).append(outputs(spark, GOLDEN[5:])).append(outputs(spark, []))
    whole = TemporalIndex.build(outputs(spark, GOLDEN), 2, bucket=2)
    assert sorted(map(tuple, grown.rows.collect())) == sorted(map(tuple, whole.rows.collect()))
    with pytest.raises(ValueError):
        grown.append(outputs(spark, [(6, 1, 1)]))
    assert TemporalIndex.build(outputs(spark, []), 2).append(outputs(spark, GOLDEN)).how_much(3, 5).first().c0 == 7


def test_selftest_of_the_command_line(spark):
    rows = cli.selftest(spark).collect()
    assert len(rows) == 7 and all(r.passed for r in rows)


def test_hashes_keep_nulls_and_equal_plain_loops(spark):
    texts = [None, "", "a", "é🙂 mixed", "x" * 300, "user:17"]

    def fnv(t):
        h = 0xCBF29CE484222325
        for b in t.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        return h - 2**64 if h >> 63 else h

    def java(t):
        h = 0
        raw = t.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (31 * h + raw[i] + 256 * raw[i + 1]) % 2**32
        return h - 2**32 if h >> 31 else h

    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    rows = frame.select("i", "t", hashing.fnv1a64("t").alias("f"), hashing.java_hash("t").alias("j")).orderBy("i").collect()
    assert [(r.f, r.j) for r in rows] == [(None, None) if t is None else (fnv(t), java(t)) for t in texts]
    longs = spark.createDataFrame([(None,), (2**62 + 1,), (-5,)], "x long").coalesce(1).select("x", hashing.splitmix64("x").alias("h")).collect()
    assert longs[0].h is None and longs[1].h == value(spark, hashing.splitmix64(F.lit(2**62 + 1)))


def test_versioning_and_shares(spark):
    index = TemporalIndex.build(outputs(spark, [(1, 2, 2), (3, 6, 2), (9, 0, 0)]), 2)
    ask = lambda *x: spark.createDataFrame([(i, *y) for i, y in enumerate(x)], "query_id int, lo bigint, hi bigint")
    rows = versioning(index.answer(ask((1, 2), (1, 2), (1, 2))), index.answer(ask((3, 4), (5, 6), (9, 9))), 2).orderBy("query_id").collect()
    assert tuple(rows[0])[1:] == (4, 0, 0.25, -0.25, True)
    assert tuple(rows[1])[1:] == (None, None, None, None, False)
    assert tuple(rows[2])[1:] == (-2, -2, None, None, True)
    zero = index.answer(ask((9, 9)))
    assert with_shares(zero, 2).first().share0 is None and with_shares(zero, 2, zero=True).first().share0 == 0


def test_two_tiers(spark):
    tiers = TwoTier.empty(outputs(spark, []), 2).add(outputs(spark, GOLDEN)).advance(4).advance(2)
    ask = spark.createDataFrame([(0, 1, 4), (1, 3, 6), (2, 50, 60), (3, 5, 1)], "query_id int, lo bigint, hi bigint")
    rows = {x.query_id: (x.c0, x.c1, x.is_defined, x.is_final) for x in tiers.answer(ask).collect()}
    assert rows == {0: (6, 13, True, True), 1: (9, 6, True, False), 2: (0, 0, False, False), 3: (0, 0, False, True)}
    after = tiers.add(outputs(spark, [(4, 9, 9), (7, 1, 1)]))
    assert after.n_late() == 1 and tiers.watermark == 4
    more = {x.query_id: x.c0 for x in after.advance(9).answer(ask).collect()}
    assert more[1] == 9  # the late output is not indexed, ts 7 lies outside


def test_shards_share_the_lowest_watermark(spark):
    shards = outputs(spark, GOLDEN).withColumn("shard", F.col("ts_ms") % 2)
    marks = spark.createDataFrame([(0, 6), (1, 3)], "shard bigint, watermark bigint")
    ask = spark.createDataFrame([(0, 1, 3), (1, 1, 4)], "query_id int, lo bigint, hi bigint")
    rows = sharded_answer(shards, marks, ask, 2).orderBy("query_id").collect()
    assert [(r.c0, r.is_final) for r in rows] == [(3, True), (6, False)]


# --- annotations


def test_counter_algebra(spark):
    a, b = F.array(*map(F.lit, (1, 0, 3))), F.array(*map(F.lit, (0, 0, 2)))
    assert value(spark, algebra.add(a, b)) == [1, 0, 5] and value(spark, algebra.total(a)) == 4
    assert value(spark, algebra.shares(a)) == [0.25, 0, 0.75] and value(spark, algebra.shares(F.array(F.lit(0)))) == [None]
    assert value(spark, algebra.one_hot(F.lit(1), 3)) == [0, 1, 0]
    s = algebra.sparse(a)
    assert value(spark, s) == {0: 1, 2: 3} and value(spark, algebra.dense(s, 4)) == [1, 0, 3, 0]
    assert value(spark, algebra.add_sparse(s, algebra.sparse(b))) == {0: 1, 2: 5}


def test_polynomials(spark):
    x, y = algebra.variable(F.lit(4)), algebra.variable(F.lit(7))
    both = algebra.times(algebra.plus(x, y), algebra.plus(x, y))  # x2 + 2xy + y2
    terms = {tuple((v.v, v.e) for v in t.vars): t.coef for t in value(spark, both)}
    assert terms == {((4, 2),): 1, ((4, 1), (7, 1)): 2, ((7, 2),): 1}
    assert value(spark, algebra.project_polynomial(both, 2)) == [2 + 2, 2 + 2]
    minus = algebra.combine_like(F.concat(x, F.transform(x, lambda t: F.struct((-t["coef"]).alias("coef"), t["vars"].alias("vars")))).cast(algebra.POLYNOMIAL))
    assert value(spark, minus) == []


def test_tries(spark):
    nodes = algebra.trie_nodes(F.lit(5).cast("bigint"), 3)
    assert value(spark, nodes) == [1, 3, 5, 13]
    trie = F.create_map(*[F.lit(x).cast("bigint") for x in (1, 3, 2, 2, 3, 1, 4, 2, 6, 0, 5, 1)])
    assert value(spark, algebra.trie_consistent(trie, 2)) and not value(spark, algebra.trie_consistent(F.map_filter(trie, lambda k, _: k != 5), 2))
    assert value(spark, algebra.prefix_count(trie, 2, 1)) == 1 and value(spark, algebra.trie_to_dense(trie, 2)) == [2, 1, 0, 0]


def rides(spark, n=3000, seed=1):
    r = random.Random(seed)
    rows = [(r.randint(0, 20), i * 9_000 + r.randint(0, 8000), r.choice([1, 1, 2, 3, 4]), r.randint(0, 999), r.choice(["CRD", "CSH", "OTH"]), r.random() * 30, r.random() * 5) for i in range(n)]
    return spark.createDataFrame(rows, readers.SCHEMAS["taxis"])


def test_schemes_agree_on_taxi_1(spark):
    rows = rides(spark)
    key = lambda df: sorted(tuple(r) for r in df.select("taxi_id", "ts_ms", "solo_count", "crowded_count", "c0", "c1", "c2", "c3").collect())
    dense = dataflows.taxi_1(rows, "counters").dense()
    want = key(dense)
    assert len(want) > 100 and all(r[2] + r[3] == sum(r[4:]) for r in want)
    for scheme in ("sparse", "prefix", "poly"):
        assert key(dataflows.taxi_1(rows, scheme).dense()) == want
    graph = dataflows.taxi_1(rows, "graph").df
    assert sorted(r[0] for r in graph.select(F.size("src")).collect()) == sorted(sum(r[4:]) for r in want)
    assert dataflows.taxi_1(rows, "none").df.count() == len(want)
    assert all((t + 1) % 600_000 == 0 for _, t, *_ in want)


def test_every_dataflow_on_its_own_schema(spark):
    r = random.Random(3)
    tweets = spark.createDataFrame([(i, i * 60_000, r.choice(["a|b", "", "a", "|c|"]), r.randint(0, 9), r.randint(0, 9), r.random() < 0.5, False, r.choice(["", "x"])) for i in range(500)], readers.SCHEMAS["tweets"])
    people, auctions = generate.persons(spark, 200, 40_000_000), generate.auctions(spark, 800, 200, 40_000_000)
    road = spark.createDataFrame([(0, t, v, 0, 0, 1, 0, 1, 77) for v in (1, 2) for t in range(0, 240, 30)], readers.SCHEMAS["linear_road"])
    meters = spark.createDataFrame([(h, f"m{m}", 0 if m < 9 and h < 24 else 30) for h in range(72) for m in range(12)], readers.SCHEMAS["smart_grid"])
    cars = spark.createDataFrame([(t, 1, 39.915 + t / 5e7, 116.30) for t in range(0, 600_000, 2500)], readers.SCHEMAS["cars_cloud"])
    assert dataflows.taxi_2(rides(spark)).dense().count() > 0
    for by_source in (False, True):
        assert dataflows.twitter_1(tweets, by_source=by_source).dense().count() > 0
    assert dataflows.twitter_2(tweets).dense().count() > 0
    assert dataflows.nexmark_1(people, auctions).dense().count() > 0
    assert {x.state for x in dataflows.nexmark_2(people, auctions).dense().collect()} <= {"OR", "ID", "CA"}
    assert [x.vehicles for x in dataflows.linear_road(road).dense().collect()][:1] == [2]
    black, odd = dataflows.smart_grid(meters)
    assert [x.n for x in black.dense().collect()] == [9] and {x.apart for x in odd.dense().collect()} == {690}
    speeds = [x.speed for x in dataflows.fast_cars(dataflows.located(cars, "counters"), above=5).dense().collect()]
    assert speeds and all(s == pytest.approx(2e-8 * dataflows.LAT_M * 1000 * 3.6) for s in speeds)
    assert dataflows.cars_in_region(dataflows.located(cars, "none")).df.count() > 0
    view = readers.scale_view(rides(spark, 300), "taxi_zone", 4)
    for scheme in ("counters", "sparse"):
        assert dataflows.count_sum(view, 4, scheme, 3_600_000).dense().agg(F.sum(F.col("c0") + F.col("c1") + F.col("c2") + F.col("c3"))).first()[0] == 300
    assert dataflows.nested(generate.synthetic(spark, 4000, step_ms=100), 64, "counters").dense().count() > 0


def test_sliding_panes_equal_direct_windows(spark):
    rows = spark.createDataFrame([(i * 37 - 500, i % 3, float(i)) for i in range(200)], "ts_ms bigint, k int, v double")
    flow = tag(rows, F.col("k"), 3, "counters")
    got = flow.aggregate(["k"], {"n": ("count", None), "s": ("sum", "v"), "a": ("avg", "v"), "lo": ("min", "v"), "hi": ("max", "v")}, 600, 100).dense()
    direct = rows.withColumn("w", F.explode(window_starts(F.col("ts_ms"), 600, 100))).groupBy("w", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.avg("v").alias("a"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    key = lambda df, t: sorted(tuple(r) for r in df.select(t, "k", "n", "s", F.round("a", 9), "lo", "hi").collect())
    assert key(got, "ts_ms") == key(direct, F.col("w") + 599)


def test_time_before_the_epoch(spark):
    df = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.9996' t union all select timestamp_ntz'1970-01-01 00:00:01.0019'")
    assert sorted(r[0] for r in df.select(millis("t")).collect()) == [-1, 1001]


def test_time_of_day_in_any_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert spark.sql("select timestamp_ntz'2024-07-01 00:00:00' t").select(millis("t")).first()[0] == 1719792000000
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


# --- provenance, sampling, sources


def test_forward_graph_and_encoders(spark):
    src = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "id bigint, ts_ms bigint")
    flow = tag(src, F.lit(0), 1, "graph", F.col("id")).aggregate([], {"n": ("count", None)}, 25)
    graph = provenance.forward_graph(flow, F.col("ts_ms"), src, "id", "ts_ms", 45, 20)
    got = sorted((r.kind, r.id, r.other) for r in graph.collect())
    assert got == [("ACK", "1", None), ("ACK", "2", None), ("EDGE", "1", "24"), ("EDGE", "2", "24"), ("EDGE", "3", "49"), ("SINK", "24", None), ("SINK", "49", None), ("SOURCE", "1", None), ("SOURCE", "2", None), ("SOURCE", "3", None)]
    assert "EDGE ::: 1 -> 24" in {r.value for r in provenance.encode_text(graph).collect()}
    assert provenance.encode_text(graph, stamped=True).count() == 10 and provenance.encode_gexf(graph).count() == 8
    assert provenance.backward(flow).orderBy("ts_ms").first().sources == [1, 2]
    made = generate.sinks_with_sources(spark, 4, 5, 2)
    assert made.select(F.explode("src")).distinct().count() == 4 * 3 + 2


def test_hashes(spark):
    # published values: FNV-1a of "" and "a"; String.hashCode of "hello"; first output of splitmix64 seeded with 0
    assert value(spark, hashing.fnv1a64(F.lit("a"))) == np.uint64(0xAF63DC4C8601EC8C).view(np.int64)
    assert value(spark, hashing.java_hash(F.lit("hello"))) == 99162322
    assert hashing.line_hash(np.array([0]), 0)[0] == 0xE220A8397B1DCDAF
    ids = spark.range(1000).withColumnRenamed("id", "x")
    whole = {r.x for r in sampling.bottom_k(ids, "x", 20, 7).collect()}
    parts = sampling.bottom_k(ids.where("x < 500"), "x", 20, 7).union(sampling.bottom_k(ids.where("x >= 500"), "x", 20, 7))
    assert {r.x for r in sampling.bottom_k(parts, "x", 20, 7).collect()} == whole
    assert sampling.captured(ids.withColumn("y", F.lit(1)).union(ids.withColumn("y", F.lit(0))), parts, "x").where("y = 0").count() == 40


def test_output_log_keeps_each_output_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 5), (1, "a", 5), (2, "b", 6)], "ts bigint, k string, v int")
    ids = sampling.output_ids(rows, "op", "ts", "k", ["v"])
    path = str(tmp_path / "log")
    sinks.append_log(ids, path)
    sinks.append_log(ids.limit(2), path)
    assert sinks.read_log(spark, path).count() == 3
    sinks.append_segment(rows, str(tmp_path / "seg"), 1)
    sinks.append_segment(rows, str(tmp_path / "seg"), 1)
    sinks.append_segment(rows, str(tmp_path / "seg"), 2)
    assert sinks.read_segments(spark, str(tmp_path / "seg")).count() == 6
    assert sinks.discard(tag(rows, F.lit(0), 2, "counters", time="ts").df) == {"rows": 3, "annotation_bytes": 48}


def test_parsers(spark, tmp_path):
    lines = ["1,10,a|b||c,1,2,true,false,Paris, France", "2,20,,0,0,false,false,", "bad line", "x,1,a,1,1,true,true,y", ""]
    (tmp_path / "t.txt").write_text("\n".join(lines))
    rows = readers.read(spark, str(tmp_path / "t.txt"), "tweets").orderBy("tweet_id").collect()
    assert [(r.tweet_id, r.location, r.is_verified) for r in rows] == [(1, "Paris, France", True), (2, "", False)]
    assert value(spark, readers.hashtags(F.lit("a|b||c"))) == ["a", "b", "c"] and value(spark, readers.hashtags(F.lit(""))) == []


def test_arrival(spark):
    rows = arrival.numbered(spark.range(500).select((F.col("id") * 1_000_003).alias("ts_ms"), "id"), "ts_ms", ["id"])
    assert sorted((r.line, r.id) for r in rows.collect()) == [(i, i) for i in range(500)]
    late = arrival.disordered(rows, F.col("line"), 9999, 5).withColumn("d", F.col("arrival") - F.col("ts_ms"))
    lo, hi, n = late.agg(F.min("d"), F.max("d"), F.count_distinct("d")).first()
    assert 0 <= lo < 1000 and 9000 < hi <= 9999 and n > 400
    slow = arrival.slowed(late, arrival.reader_of(F.col("line"), 4), 1, 3).where("line % 4 <> 1")
    assert slow.exceptAll(late.where("line % 4 <> 1")).count() == 0
    ranks = rows.select(arrival.zipf_rank(F.col("line"), 50, 1.2, 9).alias("r")).groupBy("r").count().orderBy(F.desc("count")).first()
    assert ranks.r == 0
    assert generate.prefix(rows.select("ts_ms"), 0.1).count() == 50
    rides_ = generate.taxi_rides(rides(spark, 50).select("taxi_id", "ts_ms", "passengers"), rides(spark, 50).select("taxi_id", "ts_ms", "fare", "tip"))
    assert 0 < rides_.count() <= 50


# --- streams


def test_stream_restart_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    rows = spark.range(1000).select((F.col("id") * 1000).alias("ts_ms"), (F.col("id") % 5).alias("k"))

    def run():
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "5 seconds")
        return jobs.collected(jobs.counted(stream, "k", [], "100 seconds", "50 seconds"), "r", check, out)

    rows.where("ts_ms < 400000").coalesce(1).write.parquet(folder)
    first = run().count()
    rows.where("ts_ms >= 400000").coalesce(1).write.mode("append").parquet(folder)
    spark.createDataFrame([(10**10, 0)], rows.schema).coalesce(1).write.mode("append").parquet(folder)
    again = run().collect()
    starts = rows.select(F.explode(window_starts(F.col("ts_ms"), 100_000, 50_000)).alias("w"), "k").groupBy("w", "k").count().count()
    assert 0 < first < len(again) == starts


def test_acks_come_when_the_watermark_has_passed(spark, tmp_path):
    folder = str(tmp_path / "in")
    for i, rows in enumerate([[(1000, 1), (2000, 2)], [(100_000, 3)], [(200_000, 4)], [(300_000, 5)]]):
        spark.createDataFrame(rows, "ts_ms bigint, source bigint").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("ts_ms bigint, source bigint").option("maxFilesPerTrigger", 1).parquet(folder).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "1 second")
    got = sorted((r.kind, r.source) for r in jobs.collected(jobs.source_acks(stream.select("ts", "source"), 10_000), "acks").collect())
    assert [x for x in got if x[0] == "SOURCE"] == [("SOURCE", i) for i in range(1, 6)]
    assert {("ACK", 1), ("ACK", 2), ("ACK", 3)} <= set(got) and ("ACK", 5) not in got


def test_trace_of_a_query(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.range(100).select((F.col("id") * 1000).alias("ts_ms"), (F.col("id") % 5).alias("k")).coalesce(1).write.parquet(folder)
    with monitor.Trace(spark) as trace:
        stream = spark.readStream.schema("ts_ms bigint, k bigint").parquet(folder).withColumn("ts", F.timestamp_millis("ts_ms")).withWatermark("ts", "5 seconds")
        jobs.collected(jobs.counted(stream, "k", [], "10 seconds", "10 seconds"), "t", str(tmp_path / "c"), str(tmp_path / "o"))
        for _ in range(50):
            if trace.rows:
                break
            time.sleep(0.1)
    assert sum(r["rows"] for r in trace.frame().collect()) == 100
    delays = monitor.finality_delay(spark.createDataFrame([(5,), (50,)], "ts_ms bigint"), spark.createDataFrame([(0, 2, 9), (1, 7, 14)], "batch bigint, watermark bigint, latest bigint"))
    assert {r.ts_ms: r.delay for r in delays.collect()} == {5: 9, 50: None}


def test_lateness(spark):
    rows = spark.createDataFrame([(0, 1000), (0, 50_000), (1, 1500), (1, 39_000), (1, 45_000)], "batch bigint, ts_ms bigint")
    got = {r.ts_ms: (r.missed, r.late) for r in jobs.lateness(rows, 20_000, 10_000, 5_000).where("batch = 1").collect()}
    assert got == {1500: (2, True), 39_000: (1, False), 45_000: (0, False)}
    assert tuple(jobs.late_counts(rows, 20_000, 10_000, 5_000).first()) == (5, 1, 1)


def test_index_segments_from_a_stream(spark, tmp_path):
    write = jobs.index_sink(str(tmp_path / "seg"), 2)
    write(outputs(spark, GOLDEN[:3]), 0)
    write(outputs(spark, GOLDEN[3:]), 1)
    write(outputs(spark, GOLDEN[3:]), 1)
    rows = spark.read.parquet(str(tmp_path / "seg")).groupBy(F.col("ts_ms").alias("ts")).agg(*[F.sum(c).alias(c) for c in ("c0", "c1", "n")])
    assert one(TemporalIndex.of_times(rows, 2).how_much(3, 5), "c0", "c1") == (7, 5)


def test_command_line(spark, tmp_path):
    (tmp_path / "o.csv").write_text("\n".join(",".join(map(str, r)) for r in GOLDEN))
    args = lambda *x: cli.parser().parse_args([x[0], str(tmp_path / "o.csv"), *map(str, x[1:])])
    assert one(cli.run(spark, args("query", 3, 5)), "c0", "c1") == (7, 5)
    assert cli.run(spark, args("delta", 1, 2, 3, 5)).first().delta0 == 5
    assert cli.run(spark, args("bench", 10)).first().queries == 10
    assert isinstance(args("bench", 1), argparse.Namespace)


# --- the registered queries against DuckDB

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(star.QUERIES))
def test_query(spark, duck, name):
    df = star.QUERIES[name](spark, SF)
    if name not in star.SQL:
        assert df.count() > 0
        return
    want = duck.sql(star.SQL[name])
    cols = sorted(want.columns)
    assert sorted(df.columns) == cols
    plain = lambda v: round(v, 4) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    ref = sorted((tuple(plain(r[want.columns.index(c)]) for c in cols) for r in want.fetchall()), key=repr)
    assert got == ref


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() >= 0 and {*__spark_entry__.oracle_sql()} <= {*__spark_entry__.queries()}
