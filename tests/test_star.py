import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from txnlens.operators import aggregates, checks, joins, keys, lattice, profile, star
from txnlens.plans import reports
from txnlens.sources import transactions, versions, warehouse

HEADER = (
    ",trans_date_trans_time,cc_num,merchant,category,amt,first,last,gender,street,city,state,zip,lat,long,city_pop,job,"
    "dob,trans_num,unix_time,merch_lat,merch_long,is_fraud"
)


def line(i, ts, cc, merchant, category, amt, city, zip, fraud):
    return f'{i},{ts},{cc},"{merchant}",{category},{amt},Ann,Lee,F,1 Main St,{city},TX,{zip},30.5,-97.25,1000,Nurse,1980-02-03,t{i},1500000000,30.0,-97.0,{fraud}'


TRAIN = [
    line(0, "2019-01-05 00:00:18", "4001", "Kutch, Hermiston", "grocery", 10.5, "Austin", "01234", 0),
    line(1, "2019-01-05 10:00:00", "4002", "Sporer", "travel", 20.0, "Waco", "76701", 1),
    line(2, "2019-01-04 23:59:59", "4001", "Kutch, Hermiston", "travel", 30.0, "Dallas", "76701", 1),
]
TEST = [
    line(3, "2019-02-01 12:30:00", "4003", "Zulu", "grocery", 5.0, "Plano", "76701", 0),
    line(4, "2019-02-02 12:30:00", "4002", "Sporer", "grocery", 7.0, "Waco", "76701", 0),
]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    for name, lines in (("train", TRAIN), ("test", TEST)):
        (root / f"{name}.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    return {name: str(root / f"{name}.csv") for name in ("train", "test")}


@pytest.fixture(scope="module")
def built(spark, files):
    return star.build_star(transactions.read_transactions(spark, files))


def test_read(spark, files):
    df = transactions.read_transactions(spark, files)
    assert not {"Unnamed: 0", "_c0"} & set(df.columns)
    ordered = df.orderBy("ord").select("trans_num", "split", "trans_ts", "cc_num", "zip", "dob", "amt").collect()
    assert [r["trans_num"] for r in ordered] == ["t0", "t1", "t2", "t3", "t4"]
    assert [r["split"] for r in ordered] == ["train"] * 3 + ["test"] * 2
    assert ordered[0]["trans_ts"] == dt.datetime(2019, 1, 5, 0, 0, 18)
    assert (ordered[0]["cc_num"], ordered[0]["zip"], ordered[0]["dob"]) == ("4001", "1234", dt.date(1980, 2, 3))
    raw = transactions.read_transactions(spark, files, keep_raw_ids=True)
    assert raw.filter("trans_num = 't0'").first()["zip"] == "01234"


def test_order_over_many_files_and_tasks(spark, tmp_path):
    """Row numbers follow the files even when one file is read in many pieces."""
    body = [line(i, "2019-01-05 00:00:18", "4001", "M", "c", 1.0, "x", "1", 0) for i in range(400)]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, *body[:250]]) + "\n")
    (tmp_path / "b.csv").write_text("\n".join([HEADER, *body[250:]]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = transactions.read_transactions(spark, {"all": str(tmp_path)})
        assert df.rdd.getNumPartitions() > 4
        slim = df.select("ord", "trans_num")
        assert slim.schema["ord"].dataType.simpleString() == keys.FILE_ORDER
        by_range = keys.row_ids(slim, "ord").select("transaction_id", "trans_num").collect()
        in_place = keys.numbered_rows(slim, "ord")
        assert "hashpartitioning" not in in_place._jdf.queryExecution().executedPlan().toString()
        in_place = in_place.select("transaction_id", "trans_num").collect()
        # With rows taken out the numbers are still dense.
        odd = keys.numbered_rows(slim.filter("substring(trans_num, 2) % 2 = 1"), "ord").select("transaction_id", "trans_num").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for got in (by_range, in_place):
        assert sorted((r[0], r[1]) for r in got) == [(i + 1, f"t{i}") for i in range(400)]
    assert sorted((r[0], r[1]) for r in odd) == [(i + 1, f"t{2 * i + 1}") for i in range(200)]


def test_bad_value_raises(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("\n".join([HEADER, TRAIN[0].replace("2019-01-05 00:00:18", "yesterday")]) + "\n")
    with pytest.raises(Exception):
        transactions.read_transactions(spark, {"train": str(tmp_path / "bad.csv")}).collect()


def test_missing_values_and_quotes(spark, tmp_path):
    odd = line(0, "2019-01-05 00:00:18", "4001", 'A ""B"" C', "NA", "NaN", "null", "76701", 0)
    (tmp_path / "odd.csv").write_text("\n".join([HEADER, odd]) + "\n")
    row = transactions.scan_csv(spark, str(tmp_path / "odd.csv")).first()
    assert (row["merchant"], row["category"], row["amt"], row["city"]) == ('A "B" C', None, None, None)
    (tmp_path / "bad.csv").write_text("\n".join([HEADER, odd.replace("NaN", "ten")]) + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        transactions.scan_csv(spark, str(tmp_path / "bad.csv")).collect()


def test_header_of_another_order_raises(spark, tmp_path):
    names = HEADER.split(",")
    a, b = names.index("first"), names.index("last")
    names[a], names[b] = names[b], names[a]
    (tmp_path / "a.csv").write_text("\n".join([HEADER, TRAIN[0]]) + "\n")
    assert transactions.scan_csv(spark, str(tmp_path)).count() == 1
    (tmp_path / "b.csv").write_text("\n".join([",".join(names), TRAIN[0]]) + "\n")
    with pytest.raises(Exception, match="header|Header"):
        transactions.scan_csv(spark, str(tmp_path)).collect()


def test_line_breaks_in_quotes(spark, tmp_path):
    odd = line(0, "2019-01-05 00:00:18", "4001", "Shop\nand more", "c", 1.0, "x", "76701", 0)
    (tmp_path / "odd.csv").write_text("\n".join([HEADER, odd, TRAIN[0]]) + "\n")
    got = transactions.scan_csv(spark, str(tmp_path / "odd.csv"), multi_line=True)
    assert got.count() == 2 and "Shop\nand more" in [r["merchant"] for r in got.collect()]


def test_missing_column_raises(spark, tmp_path):
    (tmp_path / "few.csv").write_text("cc_num,amt\n1,2\n")
    with pytest.raises(ValueError, match="columns missing"):
        transactions.scan_csv(spark, str(tmp_path / "few.csv"))


def test_star(built):
    assert rows(built.customer, "customer_id", "cc_num", "city") == [(1, "4001", "Austin"), (2, "4002", "Waco"), (3, "4003", "Plano")]
    assert rows(built.merchant, "merchant_id", "merchant_name") == [(1, "Kutch, Hermiston"), (2, "Sporer"), (3, "Zulu")]
    assert rows(built.category) == [(1, "grocery"), (2, "travel")]
    # Ids follow the first appearance, not the calendar.
    assert rows(built.date, "date_id", "trans_date", "day_of_week") == [
        (1, dt.date(2019, 1, 5), "Saturday"), (2, dt.date(2019, 1, 4), "Friday"),
        (3, dt.date(2019, 2, 1), "Friday"), (4, dt.date(2019, 2, 2), "Saturday"),
    ]
    assert rows(built.fact, "transaction_id", "trans_num", "customer_id", "merchant_id", "category_id", "date_id") == [
        (1, "t0", 1, 1, 1, 1), (2, "t1", 2, 2, 2, 1), (3, "t2", 1, 1, 2, 2), (4, "t3", 3, 3, 1, 3), (5, "t4", 2, 2, 1, 4),
    ]
    assert built.fact.columns == list(star.FACT_COLUMNS)


def test_star_checks_hold(built):
    for name in star.DIMENSIONS:
        assert checks.check_pk(built.dim(name), f"{name}_id").count() == 0
        assert checks.check_fk(built.fact, f"{name}_id", built.dim(name), f"{name}_id").count() == 0
    assert checks.check_unique(built.fact, "trans_num").count() == 0


def test_grains_add_up(built):
    totals = set()
    for grain in aggregates.GRAINS:
        r = aggregates.agg_fraud(built, grain).agg(F.sum("total_tx"), F.sum("fraud_tx"), F.sum("total_amount"), F.sum("fraud_amount")).first()
        totals.add(tuple(r))
    assert totals == {(5, 2, 72.5, 50.0)}
    daily = aggregates.agg_fraud(built, "daily")
    assert rows(aggregates.rollup_daily_to_monthly(daily)) == rows(aggregates.agg_fraud(built, "monthly"))
    marker = daily.limit(0)
    assert aggregates.metrics(built, "daily", {"daily": marker}) is marker


def test_reports(built):
    last = reports.last_fraud(built, 1).collect()
    assert [(r["trans_ts"], r["merchant_name"], r["amt"]) for r in last] == [(dt.datetime(2019, 1, 5, 10), "Sporer", 20.0)]
    top = reports.top_merchants(aggregates.agg_fraud(built, "merchant"), 2).collect()
    assert [r["merchant_name"] for r in top] == ["Kutch, Hermiston", "Sporer"]
    hours = rows(reports.hourly_fraud(built.fact))
    assert hours == [(10, 20.0, 1), (23, 30.0, 1)]


def test_last_fraud_fills_its_places(built):
    """A case without dimension row takes no place."""
    from dataclasses import replace

    cases = built.fact.filter("is_fraud = 1").orderBy(F.col("trans_ts").desc()).collect()
    gone = replace(built, merchant=built.merchant.filter(F.col("merchant_id") != cases[0]["merchant_id"]))
    left = [c for c in cases if c["merchant_id"] != cases[0]["merchant_id"]]
    assert [r["trans_ts"] for r in reports.last_fraud(gone, 1).collect()] == [left[0]["trans_ts"]]


def test_null_rate_ranks_first(spark):
    df = spark.createDataFrame([(1, "a", 2, 1, 0.5), (2, "b", 0, 0, None)], "merchant_id long, merchant_name string, total_tx long, fraud_tx long, fraud_rate double")
    assert [r["merchant_name"] for r in reports.top_merchants(df, 2).collect()] == ["b", "a"]


def test_view(built):
    view = star.star_view(built)
    assert len(view.columns) == len(set(view.columns))
    assert rows(view, "transaction_id", "first", "merchant_name", "category_name", "trans_date")[1] == (2, "Ann", "Sporer", "travel", dt.date(2019, 1, 5))


def test_save_load_snapshot(spark, built, tmp_path):
    root, snap, again = (str(tmp_path / n) for n in ("wh", "snap", "again"))
    warehouse.save_star(built, root)
    loaded = warehouse.load_star(spark, root)
    warehouse.refresh_aggregates(loaded, root)
    tables = warehouse.relations(loaded, warehouse.load_aggregates(spark, root))
    assert set(tables) == set(warehouse.RELATIONS)
    assert rows(loaded.fact) == rows(built.fact)
    warehouse.export_snapshot(tables, snap)
    restored = warehouse.restore_snapshot(spark, snap, again)
    for name, df in tables.items():
        assert rows(restored[name]) == rows(df)
    assert spark.sql("SELECT COUNT(*) FROM fact_transactions").first()[0] == 5
    # Months are directories, so a month is read alone.
    plan = loaded.fact.filter("year = 2019 AND month = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan


def test_loads_go_on(spark, files, tmp_path):
    """Two loads give the keys of both, unique, and no fact without its dimension rows."""
    root = str(tmp_path / "wh")
    txn = transactions.read_transactions(spark, files)
    half = txn.filter("split = 'train'")
    warehouse.save_star(star.build_star(half), root)
    first = warehouse.load_star(spark, root)
    before = {name: rows(first.dim(name)) for name in star.DIMENSIONS}
    n = first.fact.count()
    warehouse.append_transactions(txn.filter("split <> 'train'").withColumn("merchant", F.when(F.col("merchant") != "x", F.col("merchant"))), root)
    both = warehouse.load_star(spark, root)
    assert both.fact.count() == txn.count() and n < txn.count()
    for name in star.DIMENSIONS:
        dim, key = both.dim(name), f"{name}_id"
        assert set(before[name]) <= set(rows(dim))
        assert checks.check_pk(dim, key).count() == 0 and checks.check_unique(dim, star.STORED_KEYS[name]).count() == 0
        assert checks.check_fk(both.fact, key, dim, key).count() == 0
    assert checks.check_pk(both.fact, "transaction_id").count() == 0
    assert both.fact.agg(F.max("transaction_id")).first()[0] == txn.count()
    # The same transactions again: no new keys, numbers go on.
    again = warehouse.append_transactions(half, root)
    assert [again.dim(name).count() for name in star.DIMENSIONS] == [0] * 4
    assert rows(warehouse.load_star(spark, root).fact, "transaction_id") == [(i,) for i in range(1, txn.count() + n + 1)]


def test_null_keys_of_later_loads(spark):
    from txnlens.operators.keys import continue_keys, surrogate_keys

    def load(names, start):
        return spark.createDataFrame([(start + i, n) for i, n in enumerate(names)], "ord long, name string")

    table = surrogate_keys(load(["a", "b", "a"], 0), "name", "ord", "id")
    for names, every, new in (
        (["c", None, "a", "d"], [(None, 0), ("a", 1), ("c", 3), ("d", 4)], [(None, 0), ("c", 3), ("d", 4)]),
        (["b", "b"], [("b", 2)], []),
        ([], [], []),
    ):
        got = continue_keys(surrogate_keys(load(names, 10), "name", "ord", "id"), "name", "id", table.keys.select("name", "id"))
        assert [rows(t.keys, "name", "id") for t in got] == [every, new]
    stored = spark.createDataFrame([(None, 0), ("a", 1)], "name string, id long")
    every, new = continue_keys(surrogate_keys(load([None, "z"], 10), "name", "ord", "id"), "name", "id", stored)
    assert rows(every.keys, "name", "id") == [(None, 0), ("z", 2)] and rows(new.keys, "name", "id") == [("z", 2)]


def test_a_write_that_dies_changes_nothing(spark, built, tmp_path):
    root = str(tmp_path / "wh")
    warehouse.save_star(built, root)
    warehouse.refresh_aggregates(warehouse.load_star(spark, root), root)
    before = {name: rows(df) for name, df in warehouse.relations(warehouse.load_star(spark, root), warehouse.load_aggregates(spark, root)).items()}
    fails = F.raise_error(F.lit("lost")).cast("string")
    bad = star.Star(built.customer.limit(1), built.merchant.withColumn("merchant_name", fails), built.category, built.date, built.fact)
    with pytest.raises(Exception, match="lost"):
        warehouse.save_star(bad, root)  # dies after the first dimension
    with pytest.raises(Exception, match="lost"):
        warehouse.refresh_aggregates(bad, root)
    after = warehouse.relations(warehouse.load_star(spark, root), warehouse.load_aggregates(spark, root))
    assert {name: rows(df) for name, df in after.items()} == before
    # A reader that began before a replacement still sees its version.
    old = warehouse.load_star(spark, root)
    warehouse.save_star(star.Star(built.customer.limit(1), built.merchant, built.category, built.date, built.fact), root)
    assert old.customer.count() == len(before["dim_customer"]) and warehouse.load_star(spark, root).customer.count() == 1
    assert versions.drop_unused(spark, root, keep=1) >= 5
    assert warehouse.load_star(spark, root).customer.count() == 1 and rows(warehouse.load_aggregates(spark, root)["daily"]) == before["agg_daily_fraud"]


def test_writers_do_not_overwrite_each_other(spark, built, tmp_path):
    root = str(tmp_path / "wh")
    warehouse.save_star(built, root)
    base = versions.current(spark, root)
    warehouse.write_relation(built.category.limit(1), root, "dim_category")
    with pytest.raises(RuntimeError, match="another writer"):
        warehouse.publish({"dim_category": built.category}, root, base=base)
    assert warehouse.load_star(spark, root).category.count() == 1
    with pytest.raises(ValueError, match="no relation"):
        warehouse.load_aggregates(spark, root)


def test_aggregates_come_from_one_scan(spark, built, tmp_path):
    path = str(tmp_path / "fact")
    built.fact.write.parquet(path)
    stored = star.Star(built.customer, built.merchant, built.category, built.date, spark.read.parquet(path))
    plan = aggregates.partial_sums(stored, {"date": "date_id", "merchant": "merchant_id", "category": "category_id"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.index("partial_count") > 0
    found = aggregates.agg_all(stored)
    for grain, df in found.items():
        assert path not in df._jdf.queryExecution().optimizedPlan().toString() and [f for f in df.inputFiles() if path in f] == []
        assert rows(df) == [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in rows(aggregates.agg_fraud(stored, grain))]


def test_smallest_sufficient_aggregate(spark, built, tmp_path):
    path = str(tmp_path / "fact")
    built.fact.write.parquet(path)
    stored = star.Star(built.customer, built.merchant, built.category, built.date, spark.read.parquet(path))
    found = {k: v.cache() for k, v in aggregates.agg_all(stored).items()}
    known = lattice.catalog({**found, "ratios": found["daily"].select("year", "fraud_rate")})
    pick = lambda groups, where=None: getattr(lattice.smallest(known, groups, where), "name", None)
    assert pick(["year"]) == "monthly" and pick(["year"], {"is_weekend": None}) == "daily"
    assert pick(["day_of_week"]) == "daily" and pick(["merchant_name"]) == "merchant" and pick([]) in ("category", "merchant", "monthly")
    assert pick(["year", "merchant_name"]) is None and pick(["hour"]) is None
    weekend = {"is_weekend": lambda c: c}
    for groups, where in ((["year"], None), (["day_of_week"], weekend), (["merchant_name"], None), ([], weekend), (["year", "category_name"], weekend), (["hour", "job"], None)):
        got = lattice.metrics_by(stored, groups, where, known)
        same = [tuple(pytest.approx(v) if isinstance(v, float) else v for v in r) for r in rows(lattice.from_star(stored, groups, where))]
        assert rows(got) == same and same
        uses_fact = any(path in f for f in got.inputFiles())
        assert uses_fact == (lattice.smallest(known, groups, where) is None)
    with pytest.raises(ValueError, match="no such column"):
        lattice.metrics_by(stored, ["nothing"])


def test_damaged_snapshot_raises(spark, built, tmp_path):
    root, snap = str(tmp_path / "wh"), str(tmp_path / "snap")
    warehouse.save_star(built, root)
    star_ = warehouse.load_star(spark, root)
    warehouse.refresh_aggregates(star_, root)
    warehouse.export_snapshot(warehouse.relations(star_, warehouse.load_aggregates(spark, root)), snap)
    warehouse.write_relation(star_.category.limit(1), snap, "dim_category")
    with pytest.raises(ValueError, match="manifest"):
        warehouse.restore_snapshot(spark, snap, root)


def test_overflow_raises(spark):
    bad = spark.createDataFrame([(1,)], "x int").select(F.lit(1).alias("date_id"), F.current_date().alias("trans_date"), F.lit(3000000000).alias("year"), F.lit(1).alias("month"), F.lit(1).alias("day"), F.lit("x").alias("day_of_week"), F.lit(True).alias("is_weekend"), F.lit("x").alias("year_month"))
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        warehouse.conform(bad, "dim_date").collect()


# --- keys and joins under skew -----------------------------------------------------------------


def skewed(spark, n=5000, n_keys=300):
    """One key holds over a third of the rows, a tenth have none."""
    rng = random.Random(7)
    data = []
    for i in rng.sample(range(n), n):
        p = rng.random()
        key = None if p < 0.1 else "hot" if p < 0.5 else f"k{rng.randrange(n_keys)}"
        data.append((i, key, float(i)))
    return data, spark.createDataFrame(data, "ord long, key string, v double").repartition(7)


def first_appearance(data):
    ids = {}
    for _, key, _ in sorted(data):
        if key is not None:
            ids.setdefault(key, len(ids) + 1)
    return ids


def test_surrogate_keys_and_attach(spark):
    data, df = skewed(spark)
    want = first_appearance(data)
    table = keys.surrogate_keys(df, "key", "ord", "key_id")
    got = {r["key"]: r["key_id"] for r in table.keys.collect()}
    assert got == {**want, None: 0}
    assert (table.n_keys, table.n_rows) == (len(want) + 1, len(data))
    attached = keys.attach_key(df, table, "key", "key_id", "ord")
    assert {(r["ord"], r["key_id"]) for r in attached.collect()} == {(o, want.get(k, 0)) for o, k, _ in data}


def test_key_tables_of_several_columns(spark):
    data, df = skewed(spark)
    df = df.withColumn("parity", F.col("ord") % 2).withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("ord") % 10).cast("int")))
    tables = keys.key_tables(df, {"key_id": "key", "parity_id": "parity", "day_id": "day"}, "ord")
    assert rows(tables["parity_id"].keys, "parity", "parity_id", "first_ord") == [(0, 1, 0), (1, 2, 1)]
    assert rows(tables["day_id"].keys, "day", "day_id") == [(dt.date(2024, 1, 1) + dt.timedelta(i), i + 1) for i in range(10)]
    assert {r["key"]: r["key_id"] for r in tables["key_id"].keys.collect()} == {**first_appearance(data), None: 0}


def test_empty_input(spark):
    empty = spark.createDataFrame([], "ord long, key string")
    assert keys.row_ids(empty, "ord").count() == 0
    assert keys.surrogate_keys(empty, "key", "ord", "key_id").keys.count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("known", [True, False])
def test_lookup_join_spreads_hot_keys(spark, how, known):
    data, df = skewed(spark)
    want = first_appearance(data)
    some = {k: v for k, v in want.items() if v % 5}  # orphans on the fact side
    sizes = {k: sum(1 for _, key, _ in data if key == k) for k in some}
    dim = spark.createDataFrame([(k, v, f"n{v}", sizes[k]) for k, v in some.items()], "key string, id long, name string, w long")
    dim = dim if known else dim.drop("w")
    out = joins.lookup_join(df, dim, "key", how, spread="ord", weight="w" if known else None, broadcast_bytes=10)
    got = {(r["ord"], r["key"], r["id"], r["name"]) for r in out.collect()}
    full = {(o, k, some.get(k), f"n{some[k]}" if k in some else None) for o, k, _ in data}
    assert got == (full if how == "left" else {r for r in full if r[2] is not None})
    assert out.count() == len(got)
    assert sorted(out.columns) == sorted(["ord", "key", "v", "id", "name"])


def test_lookup_join_balances_tasks(spark):
    """In the shuffle join no task gets the hot key, whose rows and the null ones are spread."""
    data, df = skewed(spark)
    dim = spark.createDataFrame([(k, v) for k, v in first_appearance(data).items()], "key string, id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = joins.lookup_join(df, dim, "key", "left", spread="ord", broadcast_bytes=10)
        sizes = [r[1] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == len(data) and max(sizes) < len(data) / 3


def test_star_view_counts_large_dimensions_once(spark, built, monkeypatch):
    small = rows(star.star_view(built).select("trans_num", "first", "merchant_name", "category_name", "year_month"))
    assert "Broadcast" in star.star_view(built)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(star, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(joins, "BROADCAST_BYTES", 0)
    counted = []
    monkeypatch.setattr(star, "key_counts", lambda facts, keys: counted.append(keys) or joins.key_counts(facts, keys))
    large = star.star_view(built)
    assert rows(large.select("trans_num", "first", "merchant_name", "category_name", "year_month")) == small
    assert counted == [[f"{d}_id" for d in star.DIMENSIONS]]


def test_fact_stays_where_it_is(spark):
    """After numbering, keys are looked up in broadcast tables: the fact is not exchanged again."""
    from txnlens.plans import bindings

    txn = bindings.event_features(spark, "/root/testdata/sf0.001")
    numbered = keys.numbered_rows(txn, "ord")
    fact = star.fact_transactions(numbered, star.star_keys(numbered, "transaction_id"))
    fact.collect()
    plan = fact._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 4
    assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan


# --- checks and profiles -----------------------------------------------------------------------


def test_checks_find_faults(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "b"), (2, None), (3, None)], "id int, name string")
    assert rows(checks.check_pk(df, "id")) == [(None, 1), (1, 2)]
    assert rows(checks.check_unique(df, "name")) == [("b", 2)]
    dim = spark.createDataFrame([(1,)], "id int")
    assert rows(checks.check_fk(df, "id", dim, "id")) == [(2, 1), (3, 1)]
    wide = spark.createDataFrame([("F", 1), ("FM", 40000), (None, None)], "g string, n int")
    assert rows(checks.check_width(wide, "g", 1), "g") == [("FM",)]
    assert rows(checks.check_smallint(wide, "n"), "n") == [(40000,)]
    with pytest.raises(ValueError, match="id"):
        checks.require_empty(checks.check_pk(df, "id"), "id")


def test_null_audit_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None)], "x double, s string")
    assert rows(checks.null_audit(df)) == [("s", 2), ("x", 2)]
    assert rows(checks.null_audit(df.limit(0))) == [("s", 0), ("x", 0)]


def test_profile(spark):
    df = spark.createDataFrame([(1, True, "a"), (None, False, "b"), (4, True, "c")], "n int, b boolean, s string")
    assert rows(profile.profile(df.withColumn("d", F.lit("1.50").cast("decimal(5,2)")))) == [
        ("b", 3, 0.0, pytest.approx(2 / 3), 1.0), ("d", 3, 1.5, 1.5, 1.5), ("n", 3, 1.0, 2.5, 4.0),
    ]
