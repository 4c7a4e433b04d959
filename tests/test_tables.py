"""Table functions, registries, databases and streams with state."""

import datetime
import threading
import time

import pytest
from pyspark.sql import functions as F

from folioscope import plans
from folioscope.operators import text
from folioscope.plans import dashboards, registry
from folioscope.sources import eav
from folioscope.streaming import state, windows


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_passages_in_sql_are_the_registered_query(spark, sf):
    assert rows(plans.QUERIES["passages_sql"](spark, sf)) == rows(plans.QUERIES["passages"](spark, sf))
    words = " ".join(f"w{k}" for k in range(40))
    docs = spark.createDataFrame([(k, "\n\n".join([words] * k + ["end here."])) for k in range(30)] + [(99, "")], "item_id long, text string")
    got = spark.sql("SELECT * FROM passages(TABLE(SELECT * FROM {p}) PARTITION BY item_id ORDER BY (pos, k), 100, 130, 60)", p=text.pieces(docs, 130))
    want = text.passages(docs, 100, 130, 60)
    assert rows(got) == rows(want) and want.count() > 40
    with pytest.raises(Exception, match="number of words"):
        spark.sql("SELECT * FROM passages(TABLE(SELECT * FROM {p}), 'x', 130, 60)", p=text.pieces(docs)).collect()


def test_builders_of_ones_own(spark, sf):
    registry.register("own_query", lambda s, d: s.range(3), "SELECT * FROM range(3) t(id)")
    try:
        assert plans.QUERIES["own_query"](spark, sf).count() == 3 and "own_query" in plans.SQL
        with pytest.raises(ValueError, match="already"):
            registry.register("own_query", lambda s, d: s.range(1))
        registry.register("own_query", lambda s, d: s.range(1), replace=True)
        assert plans.QUERIES["own_query"](spark, sf).count() == 1 and "own_query" not in plans.SQL
        with pytest.raises(TypeError):
            registry.register("other", "no builder")
    finally:
        plans.QUERIES.pop("own_query"), plans.SQL.pop("own_query", None)
    dashboards.register_chart("sizes", lambda c, m, _: m.groupBy("entity").agg(F.count(F.lit(1)).alias("n")))
    try:
        made = registry.bridge.load(spark, sf)
        charts = dashboards.charts(made, "projects", spark.createDataFrame([], "item_id long, country string"), ("sizes",))
        assert list(charts) == ["sizes"] and charts["sizes"].count() == 25
        with pytest.raises(ValueError, match="already"):
            dashboards.register_chart("timeline", lambda c, m, _: m)
    finally:
        dashboards.CHARTS.pop("sizes")


@pytest.fixture(scope="module")
def database(spark, tmp_path_factory):
    """A file database."""
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/items;create=true"
    made = {
        "resource": spark.range(1, 1001).select("id", (F.col("id") % 2).cast("int").alias("is_public")),
        "item_site": spark.range(1, 501).select(F.col("id").alias("item_id"), F.lit(7).cast("long").alias("site_id")),
        "media": spark.range(0).select("id", F.lit(1).cast("long").alias("item_id")),
    }
    for name, df in made.items():
        df.toDF(*[c.upper() for c in df.columns]).coalesce(1).write.jdbc(url, name, mode="overwrite")  # names that need no quotes
    return url, made


def test_tables_are_read_by_ranges_of_ids(spark, database):
    url, made = database
    found = eav.read_jdbc(spark, url, parts=4, ids_per_part=100, tables=tuple(made))
    assert {t: df.rdd.getNumPartitions() for t, df in found.items()} == {"resource": 4, "item_site": 4, "media": 1}
    assert all(rows(found[t].select(*df.columns)) == rows(df) for t, df in made.items())
    assert min(len(p) for p in found["resource"].rdd.glom().collect()) == 250
    assert eav.read_jdbc(spark, url, parts=4, ids_per_part=5000, tables=("resource",))["resource"].rdd.getNumPartitions() == 1


def test_a_scan_is_cancelled_by_its_tag(spark, database):
    scan = eav.read_jdbc(spark, database[0], parts=2, ids_per_part=100, tables=("resource",))["resource"]
    failed = []

    def slow():
        with eav.under_tag(spark, "slow-scan"):
            try:
                scan.rdd.map(lambda r: time.sleep(0.2)).count()
            except Exception as e:  # noqa: BLE001
                failed.append(str(e))

    other = threading.Thread(target=slow)
    began = time.time()
    other.start()
    while not failed and time.time() - began < 60:
        time.sleep(0.5)
        eav.cancel(spark, "slow-scan")
    other.join(60)
    assert failed and "cancel" in failed[0].lower() and time.time() - began < 60
    assert scan.count() == 1000  # other jobs go on


def edits(spark, seed=4):
    import random

    rng = random.Random(seed)
    start = datetime.datetime(2026, 1, 1, tzinfo=datetime.timezone.utc)
    made = [(rng.randrange(4), start + datetime.timedelta(seconds=rng.randrange(20_000)), rng.random() < 0.3) for _ in range(200)]
    return sorted(made, key=lambda r: r[1])


SCHEMA = "site_id long, ts timestamp, withdrawn boolean"


def test_stateful_refreshes_are_those_of_the_batch(spark, tmp_path):
    """Edits come in four files, some late within the watermark, and one file twice."""
    made = edits(spark)
    spark.conf.set(*state.STORE)
    try:
        parts = [made[:60], made[70:130], made[60:70] + made[130:], [(9, made[-1][1] + datetime.timedelta(days=9), False)]]
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        query = state.due_refreshes(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        got = rows(spark.read.parquet(f"{tmp_path}/out").where("site_id != 9"))
        assert got == rows(windows.settled(spark.createDataFrame(made, SCHEMA))) and len(got) > 20
    finally:
        spark.conf.unset(state.STORE[0])


def test_repeated_batches_count_once(spark, tmp_path):
    made = spark.createDataFrame(edits(spark, 5), SCHEMA)
    write = state.refresh_counts(f"{tmp_path}/counts", ["site_id"])
    halves = [made.where(f"minute(ts) % 2 = {k}") for k in (0, 1)]
    for batch, df in ((0, halves[0]), (1, halves[1]), (0, halves[0]), (1, halves[1])):
        write(df, batch)
    want = rows(made.groupBy("site_id").count())
    assert rows(state.counts(spark, f"{tmp_path}/counts", ["site_id"])) == want
    made.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second run has lost its checkpoint, and numbers its batches anew
        query = stream.writeStream.foreachBatch(state.refresh_counts(f"{tmp_path}/again", ["site_id"])).option("checkpointLocation", f"{tmp_path}/c{_}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert rows(state.counts(spark, f"{tmp_path}/again", ["site_id"])) == want
