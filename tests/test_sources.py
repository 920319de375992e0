import pytest
from pyspark.sql import functions as F

from tidemill import schemas
from tidemill.plans.inspect import plan_facts
from tidemill.plans.layout import compare_layouts, layout_of
from tidemill.sources import generate, tables


def test_csv_blanks_and_malformed_values_are_null(spark, tmp_path, rows):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("tenant_id,customer_id,name,email,country,signup_date\nt,c1,,x,US,2024-01-02\nt,,n,x,US,\nt,c3,n,x,US,not a date\n")
    df = tables.read_csv(spark, f"file://{tmp_path}/in", schemas.CUSTOMERS)
    assert rows(df, "customer_id", "name", F.col("signup_date").cast("string")) == sorted([("c1", None, "2024-01-02"), (None, "n", None), ("c3", "n", None)], key=repr)
    assert {t for _, t in tables.read_csv(spark, f"file://{tmp_path}/in").dtypes} == {"string"}


def test_optional_table_and_views(spark, tmp_path):
    tables.write_table(spark.range(3), f"file://{tmp_path}/there")
    found = {n: tables.read_optional(spark, f"file://{tmp_path}/{n}") for n in ("there", "absent")}
    assert tables.register_views(found) == ["there"]
    assert spark.sql("SELECT count(*) FROM there").first()[0] == 3


def test_json_lines_with_schema(spark, tmp_path, rows):
    (tmp_path / "j.json").write_text('{"op":"I","commit_ts":"2026-07-04T00:00:00Z","seq":1,"tenant_id":"t","order_id":"o"}\n')
    assert rows(tables.read_json(spark, f"file://{tmp_path}/j.json", schemas.CHANGES), "op", "seq", "status") == [("I", 1, None)]


def test_dynamic_overwrite_leaves_other_partitions(spark, tmp_path, rows):
    path = f"file://{tmp_path}/t"
    base = spark.range(8).select((F.col("id") % 4).alias("k"), "id")
    tables.write_table(base, path, ["k"])
    tables.write_table(spark.createDataFrame([(1, 100)], "k long, id long"), path, ["k"], dynamic=True)
    assert rows(spark.read.parquet(path), "k", "id") == sorted([(0, 0), (0, 4), (1, 100), (2, 2), (2, 6), (3, 3), (3, 7)], key=repr)


def test_static_overwrite_replaces_all(spark, tmp_path, rows):
    path = f"file://{tmp_path}/t"
    tables.write_table(spark.range(4).withColumn("k", F.col("id") % 2), path, ["k"])
    assert tables.write_table(spark.createDataFrame([(9, 1)], "id long, k long"), path, ["k"]).count() == 1


def test_self_overwrite_is_refused_before_anything_is_lost(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = tables.write_table(spark.range(5), path)
    with pytest.raises(tables.SelfOverwrite):
        tables.write_table(table.filter("id > 2"), path)
    assert spark.read.parquet(path).count() == 5


def test_replaced_window_drops_partitions_that_became_empty(spark, tmp_path, rows):
    path = f"file://{tmp_path}/m"
    days = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2), ("2026-01-03", 3)], "d string, n int").withColumn("d", F.col("d").cast("date"))
    tables.replace_window(days, path, "d", "2026-01-01", "2026-01-03")
    first = rows(spark.read.parquet(path), F.col("d").cast("string"), "n")
    tables.replace_window(days, path, "d", "2026-01-01", "2026-01-03")
    assert rows(spark.read.parquet(path), F.col("d").cast("string"), "n") == first
    tables.replace_window(days.filter("n = 2").withColumn("n", F.lit(20)), path, "d", "2026-01-02", "2026-01-03")
    assert rows(spark.read.parquet(path), F.col("d").cast("string"), "n") == [("2026-01-01", 1), ("2026-01-02", 20)]
    tables.replace_window(days.filter("n > 99"), path, "d", "2026-01-02", "2026-01-02")
    assert spark.read.parquet(path).count() == 1


def test_layouts_and_pruning(spark, tmp_path):
    df = spark.range(0, 200, numPartitions=4).select("id", (F.col("id") % 5).alias("k"))
    found = compare_layouts(df, f"file://{tmp_path}", {"plain": {"partition_by": ["k"]}, "tidy": {"partition_by": ["k"], "tidy": True}, "one": {"files": 1}, "small": {"files": 1, "max_records": 50}}, F.col("k") == 3)
    assert found["plain"]["folders"] == found["tidy"]["folders"] == found["tidy"]["files"] == 5
    assert found["plain"]["files"] == 20 and found["one"]["files"] == 1 and found["small"]["files"] == 4
    assert {f["rows"] for f in found.values()} == {40}
    facts = plan_facts(spark.read.parquet(f"file://{tmp_path}/tidy").filter("k = 3"))
    assert "k" in facts.partition_filters[0]
    assert layout_of(spark, f"file://{tmp_path}/tidy").bytes > 0


def test_verify_written(spark, tmp_path):
    df = spark.range(7)
    tables.write_table(df, f"file://{tmp_path}/v")
    assert tables.verify_written(df, f"file://{tmp_path}/v") == (7, 7, True)


def test_generators_do_not_depend_on_partitions(spark, rows):
    a = generate.orders(spark, 300, 40)
    b = generate.orders(spark, 300, 40).repartition(7)
    assert rows(a) == rows(b)
    bad = a.filter(F.abs(F.col("total_amount") - F.col("subtotal") - F.col("tax") - F.col("shipping")) > 0.006).count()
    assert bad == 0
    lines = generate.order_items(a)
    assert lines.join(a, ["tenant_id", "order_id"], "left_anti").count() == 0
    assert lines.groupBy("order_id").count().agg(F.min("count"), F.max("count")).first() == (1, 4)
    products = generate.products(spark, 5)
    assert products.groupBy("product_id").count().first()["count"] == len(generate.SHARES)


def test_generated_tenants_are_skewed_and_dirt_is_small(spark):
    orders = generate.orders(spark, 5000, 3000)
    share = orders.filter("tenant_id = 't_000'").count() / 5000
    assert 0.55 < share < 0.65
    dirty = generate.make_dirty(orders)
    assert 0.005 < dirty.filter("customer_id IS NULL OR total_amount < 0 OR order_date IS NULL").count() / 5000 < 0.03
    assert dirty.count() > 5000


def test_click_stream_and_baskets(spark):
    clicks = generate.clicks(spark, 100)
    assert clicks.schema.simpleString() == schemas.CLICKS.simpleString()
    assert clicks.agg(F.min("event_ts") >= F.lit("2026-07-04 12:00:00").cast("timestamp")).first()[0]
    assert {(r["order_id"], r["count"]) for r in generate.baskets(spark, [3, 10]).groupBy("order_id").count().collect()} == {(0, 3), (1, 10)}
