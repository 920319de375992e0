import pytest
from pyspark.sql import functions as F

from tidemill import bindings, catalog
from tidemill.plans import job_metrics, labs
from tidemill.plans.inspect import explained, plan_facts
from tidemill.session import broadcast_if_small, estimated_bytes, scoped_conf, scratch
from tidemill.sources.tables import write_table

SF = "/root/testdata/sf0.001"


def test_flagship_plan(spark):
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        facts = plan_facts(catalog.QUERIES["daily_revenue"](spark, SF))
    lineitem = next(c for c in facts.read_columns if "l_orderkey" in c)
    assert sorted(lineitem) == ["l_extendedprice", "l_orderkey", "l_partkey"]
    assert any("EqualTo(o_orderstatus,F)" in p for p in facts.pushed)
    assert facts.joins["BroadcastHashJoin"] == 2  # the dimensions, by their checked sizes
    text = explained(catalog.QUERIES["daily_revenue"](spark, SF), "formatted")
    assert "Expand" not in text  # the exact distinct count needs no expansion


def test_conf_is_restored(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with pytest.raises(RuntimeError), scoped_conf(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        raise RuntimeError
    assert spark.conf.get("spark.sql.shuffle.partitions") == before


def test_broadcast_follows_the_size(spark):
    df = bindings.products(spark, SF)
    assert estimated_bytes(df) > 0
    assert "broadcast" in broadcast_if_small(df)._jdf.queryExecution().analyzed().toString()
    assert "broadcast" not in broadcast_if_small(df, 1)._jdf.queryExecution().analyzed().toString()


def test_labs_agree_on_rows(spark):
    big, small = spark.range(2000).select((F.col("id") % 3).alias("k"), "id"), spark.range(3).withColumnRenamed("id", "k")
    sweep = labs.shuffle_sweep(spark, lambda: big.groupBy("k").count(), (2, 8))
    assert set(sweep) == {"static_2", "static_8", "adaptive_8"}
    assert set(labs.broadcast_against_merge(spark, big, small, ["k"])) == {"merge", "broadcast"}
    assert labs.salted_against_plain(spark, big, small, ["k"], 4, ["id"])["rows"] == 2000
    assert labs.partition_rows(big.repartition(4)).agg(F.sum("n")).first()[0] == 2000
    assert labs.spill_of(spark, big.orderBy("id"))["seconds"] > 0


def test_job_record_and_guard(spark, tmp_path):
    log = tmp_path / "log" / "metrics.jsonl"
    assert job_metrics.check_latest(log) is None

    def run():
        path = scratch(spark, "job")
        write_table(spark.range(10), path, files=1)
        return path

    record = job_metrics.measure(spark, "demo", {"items": spark.range(4)}, run)
    job_metrics.append_record(log, record)
    job_metrics.append_record(log, record | {"job": "other"})
    latest = job_metrics.latest_record(log, "demo")
    assert (latest["output_rows"], latest["output_files"], latest["input_items"], latest["shuffle_read_mb"]) == (10, 1, 4, None)
    assert set(job_metrics.check_latest(log, job="demo")) == {"output_rows", "input_items"}


def test_adaptive_execution_splits_a_skewed_join(spark):
    hot = spark.range(60_000).select(F.when(F.col("id") < 50_000, 0).otherwise(F.col("id")).alias("k"), F.lit("x" * 50).alias("pad"), "id")
    keys = spark.range(60_000).withColumnRenamed("id", "k")
    settings = {"spark__sql__autoBroadcastJoinThreshold": "-1", "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "16k", "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5", "spark__sql__adaptive__advisoryPartitionSizeInBytes": "16k", "spark__sql__shuffle__partitions": "8"}
    with scoped_conf(spark, **settings):
        joined = hot.repartition(16).join(keys, "k")
        joined.write.format("noop").mode("overwrite").save()
        assert joined.count() == 60_000
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()


def test_flagship_shuffles(spark):
    """Orders and items move once, on the order, and the folded rows once, by the mart's
    groups; the exact distinct count needs nothing more."""
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        facts = plan_facts(catalog.QUERIES["daily_revenue"](spark, SF))
    assert facts.exchanges == 3 and facts.joins["SortMergeJoin"] == 1
