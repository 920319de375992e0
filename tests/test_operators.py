import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.operators import affinity, changes, checks, features, joins, keyed, marts, quality
from tidemill.plans.inspect import explained, plan_facts
from tidemill.session import scoped_conf
from tidemill.sources import generate


def test_rank_ties(spark, rows):
    df = spark.createDataFrame([("g", 1, 100), ("g", 2, 100), ("g", 3, 90)], "g string, id int, v int")
    out = keyed.with_ranks(df, ["g"], [F.desc("v")], ["id"])
    assert rows(out, "id", "row_number", "rank", "dense_rank") == [(1, 1, 1, 1), (2, 2, 1, 1), (3, 3, 3, 2)]
    with pytest.raises(ValueError, match="tiebreak"):
        keyed.latest_per_key(df, ["g"], [F.desc("v")], [])


def test_top_n_limits_groups_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), "id")
    assert plan_facts(keyed.latest_per_key(df, ["g"], [F.desc("id")], ["id"])).group_limits >= 1
    assert "Window" in explained(keyed.top_n(df, ["g"], [F.desc("id")], ["id"], 3), "simple")


def _order(tenant="t", order="o", customer="c", ts="2026-01-01 00:00:00", date="2026-01-01", total=1.0):
    return (tenant, order, customer, ts, date, total)


def _orders(spark, data):
    df = spark.createDataFrame(data, "tenant_id string, order_id string, customer_id string, order_ts string, order_date string, total_amount double")
    return df.withColumns({"order_ts": F.col("order_ts").cast("timestamp"), "order_date": F.col("order_date").cast("date")})


def test_first_broken_rule_wins_and_zero_is_valid(spark, rows):
    data = [_order(order="a", customer=None, total=-1.0), _order(order="b", date=None), _order(order="c", total=-0.01), _order(order="d", total=0.0), _order(order=None), _order(tenant=None), _order(order="e", total=None)]
    tagged = quality.orders_contract().tag(_orders(spark, data))
    assert rows(tagged, "order_id", "rejection_reason") == sorted([("a", "null_customer"), ("b", "null_date"), ("c", "bad_total"), ("d", None), (None, "null_order_id"), ("o", "null_tenant"), ("e", "bad_total")], key=repr)


def test_quantity_zero_is_bad_but_revenue_zero_is_not(spark, rows):
    df = spark.createDataFrame([("t", "o", "i1", "p", 0, 1.0), ("t", "o", "i2", "p", 1, 0.0), ("t", "o", "i3", None, 1, 1.0)], "tenant_id string, order_id string, order_item_id string, product_id string, quantity int, item_revenue double")
    assert rows(quality.items_contract().tag(df), "order_item_id", "rejection_reason") == [("i1", "bad_quantity"), ("i2", None), ("i3", "null_product_id")]


def test_duplicates_lose_to_one_survivor_and_all_rows_reconcile(spark, rows):
    data = [_order(date="2026-01-02"), _order(date="2026-01-01"), _order(order="p"), _order(customer=None)]
    df, contract = _orders(spark, data), quality.orders_contract()
    valid, rejected = contract.split(df)
    assert rows(valid, "order_id", F.col("order_date").cast("string")) == [("o", "2026-01-01"), ("p", "2026-01-01")]
    assert rows(quality.breakdown(rejected)) == [("duplicate", 1), ("null_customer", 1)]
    assert quality.reconcile(df, contract.tag(df)).first() == (4, 2, 2, True)
    assert {tuple(r) for r in df.subtract(valid).collect()} == {tuple(r) for r in rejected.drop("rejection_reason").collect()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from(["t", None]), st.sampled_from(["a", "b", None]), st.sampled_from(["c", None]), st.sampled_from([1.0, -1.0, None])), max_size=12))
def test_contract_never_loses_a_row(spark, data):
    df = _orders(spark, [_order(t, o, c, total=x) for t, o, c, x in data]) if data else _orders(spark, []).limit(0)
    assert quality.reconcile(df, quality.orders_contract().tag(df)).first()["reconciled"]


def test_join_guards(spark):
    orders = spark.createDataFrame([("A", 1, 100.0), ("B", 1, 999.0)], "tenant_id string, customer_id int, total double")
    people = spark.createDataFrame([("A", 1, "Alice"), ("B", 1, "Bob")], "tenant_id string, customer_id int, name string")
    with pytest.raises(joins.UnderKeyed):
        joins.keyed_join(orders, people, ["customer_id"])
    assert joins.keyed_join(orders, people, ["customer_id"], required=()).count() == 4
    joined = joins.keyed_join(orders, people, ["tenant_id", "customer_id"], "left")
    assert joins.preserves_left(orders, joined)
    assert not joins.preserves_left(orders, joins.keyed_join(orders, people, ["customer_id"], required=()))


def test_salted_join_equals_plain_join(spark, rows):
    big = spark.createDataFrame([("mega", k) for k in range(4)] + [("small", k) for k in range(4, 6)], "tenant string, id int")
    small = spark.createDataFrame([(t, c) for t in ("mega", "small") for c in ("x", "y")], "tenant string, campaign string")
    salted = joins.salted_join(big, small, ["tenant"], 3, ["id"])
    assert rows(joins.salted_join(big, small, ["tenant"], 3, ["id"], hot_share=0.5), "tenant", "id", "campaign") == rows(salted, "tenant", "id", "campaign")
    assert rows(salted, "tenant", "id", "campaign") == rows(big.join(small, "tenant"), "tenant", "id", "campaign")
    assert salted.count() == 12


def test_join_strategies(spark):
    a, b = spark.range(1000), spark.range(100).withColumn("x", F.lit(1))
    with scoped_conf(spark, spark__sql__adaptive__enabled="false"):
        merge = plan_facts(joins.merge_join(a, b, ["id"]))
        assert merge.joins == {"SortMergeJoin": 1} and merge.exchanges == 2
        assert plan_facts(joins.enrich(a, b, ["id"])).joins == {"BroadcastHashJoin": 1}
    with scoped_conf(spark, spark__sql__adaptive__enabled="false", spark__sql__autoBroadcastJoinThreshold="-1"):
        assert "BroadcastHashJoin" not in plan_facts(joins.enrich(a, b, ["id"], limit=1)).joins


def test_orphans_overlap_and_skew(spark, rows):
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(joins.orphans(child, parent, ["k"])) == sorted([(1,), (None,)], key=repr)
    assert joins.key_overlap(child.dropna(), parent, ["k"]).first() == (2, 2, 1)
    assert checks.orphan_share(child, parent, ["k"]) == pytest.approx(2 / 3)
    assert rows(joins.skew_profile(parent.unionByName(parent.filter("k = 2")), F.col("k"), "k")) == [(2, 2, 2 / 3), (3, 1, 1 / 3)]


def _mart_tables(spark):
    orders = spark.createDataFrame([("t", 1, "2026-01-01", "COMPLETE"), ("t", 2, "2026-01-01", "COMPLETE"), ("t", 3, "2026-01-02", "PENDING")], "tenant_id string, order_id int, order_date string, status string").withColumn("order_date", F.col("order_date").cast("date"))
    items = spark.createDataFrame([("t", 1, "p", 10.0), ("t", 1, "p", 5.5), ("t", 2, "q", 1.0), ("t", 2, "lost", 2.0), ("t", 3, "p", 9.0), ("t", 9, "p", 7.0)], "tenant_id string, order_id int, product_id string, item_revenue double")
    products = spark.createDataFrame([("t", "p", "toys"), ("t", "q", "toys"), ("u", "lost", "books")], "tenant_id string, product_id string, category string")
    return items, orders, products


def test_daily_revenue_keeps_unknown_products_and_drops_orphans(spark, rows):
    mart = marts.daily_revenue(*_mart_tables(spark))
    assert rows(mart, F.col("order_date").cast("string"), "category", "revenue", "orders", "items_sold") == sorted([("2026-01-01", "toys", 16.5, 2, 3), ("2026-01-01", None, 2.0, 1, 1)], key=repr)


def test_incremental_mart_equals_full_mart(spark, tmp_path, rows):
    orders = generate.orders(spark, 400, 50, days=6)
    items, products = generate.order_items(orders), generate.products(spark)
    path, columns = f"file://{tmp_path}/mart", ("tenant_id", F.col("order_date").cast("string"), "category", "revenue", "orders", "items_sold")
    for start, end in (("2026-01-01", "2026-01-03"), ("2026-01-03", "2026-01-06"), ("2026-01-02", "2026-01-04")):
        table = marts.rebuild_daily_revenue(items, orders, products, path, start, end)
    assert rows(table, *columns) == rows(marts.daily_revenue(items, orders, products), *columns)
    assert checks.sums_agree(table, items.join(orders.filter("status = 'COMPLETE'"), ["tenant_id", "order_id"]), "revenue", "item_revenue").first()["agrees"]


def _history(spark, days):
    data = [("t", "c", d, "COMPLETE", 10.0) for d in days]
    return spark.createDataFrame(data, "tenant_id string, customer_id string, order_date string, status string, total_amount double").withColumn("order_date", F.col("order_date").cast("date"))


def test_point_in_time_windows_include_both_ends(spark):
    orders = _history(spark, ["2026-06-30", "2026-06-23", "2026-05-31", "2026-05-30", "2026-07-01"])
    people = spark.createDataFrame([("t", "c"), ("t", "quiet")], "tenant_id string, customer_id string")
    out = {r["customer_id"]: r for r in features.point_in_time_features(people, orders, "2026-06-30").collect()}
    c, quiet = out["c"], out["quiet"]
    assert (c["orders_7d"], c["orders_30d"], c["lifetime_orders"], c["days_since_last_order"]) == (2, 3, 4, 0)
    assert (c["revenue_7d"], c["revenue_30d"], c["lifetime_revenue"]) == (20.0, 30.0, 40.0)
    assert [quiet[k] for k in ("revenue_7d", "orders_7d", "revenue_30d", "orders_30d", "lifetime_revenue", "lifetime_orders")] == [0] * 6
    assert quiet["days_since_last_order"] is None and quiet["as_of_date"].isoformat() == "2026-06-30"
    lifetime = features.lifetime_features(orders, "2026-06-30").first()
    assert (lifetime["days_since_last_order"], lifetime["lifetime_orders"]) == (-1, 5)
    assert features.lifetime_features(orders, "2026-06-30", cut=True).first()["days_since_last_order"] == 0


@pytest.mark.parametrize(("day", "label"), [("2026-06-30", 0), ("2026-07-01", 1), ("2026-07-30", 1), ("2026-07-31", 0)])
def test_label_window_is_open_at_the_day_and_closed_at_its_end(spark, day, label):
    out = features.leakage_rows(_history(spark, ["2026-06-01", day]), "2026-06-30").first()
    assert out["label"] == label and out["recency"] >= 0
    assert (out["leaky_recency"] < 0) == (day > "2026-06-30")


def test_affinity_and_its_prediction(spark, rows):
    baskets = generate.baskets(spark, [3, 10, 50, 200])
    sizes = affinity.basket_sizes(baskets, ["order_id"])
    assert affinity.predict_pairs(sizes).first()["pairs"] == 3 + 45 + 1225 + 19900
    assert affinity.predict_pairs(sizes, 20).first()["pairs"] == 48
    pairs = affinity.affinity(baskets, ["order_id"], "product_id", [], least=2, cap=20)
    assert rows(pairs) == [(1, 2, 2), (1, 3, 2), (2, 3, 2)]
    assert affinity.affinity(baskets, ["order_id"], "product_id", [], least=1, max_ratio=1000).agg(F.sum("co_occurrences")).first()[0] == 21173
    with pytest.raises(affinity.PairExplosion):
        affinity.affinity(baskets, ["order_id"], "product_id", [], max_ratio=1)


def test_change_log_edge_cases(spark, rows):
    log = [("I", 0, 1, "a", "NEW"), ("U", 5, 2, "a", "DONE"), ("U", 1, 3, "only-update", "X"), ("D", 1, 4, "only-delete", None), ("U", 2, 5, "tie", "first"), ("U", 2, 6, "tie", "second"), ("I", 0, 7, "gone", "NEW"), ("D", 9, 8, "gone", None), (None, 9, 9, "no-op", "X")]
    df = spark.createDataFrame([(op, f"2026-07-04 00:{m:02d}:00", s, "t", k, v) for op, m, s, k, v in log], "op string, commit_ts string, seq long, tenant_id string, order_id string, status string").withColumn("commit_ts", F.col("commit_ts").cast("timestamp"))
    key = ["tenant_id", "order_id"]
    want = [("a", "DONE"), ("only-update", "X"), ("tie", "second")]
    assert rows(changes.current_state(df, key), "order_id", "status") == want
    assert rows(changes.current_state(df.unionByName(df).orderBy(F.rand(3)), key), "order_id", "status") == want
    assert rows(changes.current_state(df, key, as_of="2026-07-04 00:04:00"), "order_id", "status") == [("a", "NEW"), ("gone", "NEW"), ("only-update", "X"), ("tie", "second")]


def test_generated_change_log_counts(spark):
    orders = spark.range(1000).select(F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("order_id"), F.lit(1.0).alias("total_amount"), F.col("id").alias("n"))
    log = generate.change_log(orders)
    assert log.count() == 1780
    assert {r["op"]: r["count"] for r in log.groupBy("op").count().collect()} == {"I": 1000, "U": 700, "D": 80}
    assert changes.current_state(log, ["tenant_id", "order_id"]).count() == 920


def test_checks_and_bands(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 3.0, 2.0), (None, -1.0, 2.0)], "k string, w7 double, w30 double")
    assert checks.null_keys(df, ["k"]).first()["k"] == 1
    assert checks.duplicate_keys(df, ["k"]) == 1
    assert checks.negative_amounts(df, ["w7"]).first()["w7"] == 1
    assert checks.window_order(df, ["w7", "w30"]).first()[0] == 1
    bands = {"output_rows": checks.Band(8_000, 12_000)}
    assert checks.out_of_band({"output_rows": 12}, bands) == ["output_rows"]
    assert checks.out_of_band({}, bands) == ["output_rows"] and not checks.out_of_band({"output_rows": 9_000}, bands)


def test_empty_inputs(spark):
    items, orders, products = (df.limit(0) for df in _mart_tables(spark))
    assert marts.daily_revenue(items, orders, products).count() == 0
    assert affinity.predict_pairs(affinity.basket_sizes(items, ["order_id"])).first()["pairs"] == 0.0
    assert features.leakage_share(features.leakage_rows(_history(spark, ["2026-01-01"]).limit(0), "2026-01-01")).first()["negative_share"] is None
