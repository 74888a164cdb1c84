"""Steps whose memory, shuffles or time once grew faster than their input, on small tables."""

import duckdb
from pyspark.sql import functions as F

from codeweft import catalog, fixtures
from codeweft.operators import graph, measures
from codeweft.plans import business, rebuild
from codeweft.sources import classes as nested

D = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_edges_of_odd_tables(spark, tmp_path):
    """Parts without a brand or given twice, orders without a customer, and lines without a part or supplier."""
    for t in ("region", "nation", "supplier"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    customer, part, orders, lines = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("customer", "part", "orders", "lineitem"))
    customer.where("c_custkey % 7 <> 0").write.parquet(f"{tmp_path}/customer.parquet")
    brand = F.when(F.col("p_partkey") % 5 > 1, F.col("p_brand"))
    odd = part.withColumn("p_brand", brand)
    odd.unionByName(odd.where("p_partkey % 3 = 0").withColumn("p_brand", F.lit("Brand#2"))).unionByName(odd.where("p_partkey % 4 = 0")).write.parquet(f"{tmp_path}/part.parquet")
    orders.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 6 > 0, F.col("o_orderpriority"))).write.parquet(f"{tmp_path}/orders.parquet")
    lines.withColumn("l_partkey", F.when(F.col("l_linenumber") != 3, F.col("l_partkey"))).withColumn("l_suppkey", F.when(F.col("l_linenumber") != 4, F.col("l_suppkey"))).write.parquet(f"{tmp_path}/lineitem.parquet")
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(map(repr, db.execute(fixtures.with_views("SELECT * FROM edges")).fetchall()))
    assert rows(fixtures.frame(spark, str(tmp_path), "edges")) == want
    assert any("(None, 'ext." in row for row in want)


def test_edges_move_keys_and_not_texts(spark):
    """F15 to F21: before, FQNs of orders were joined as texts, from tables written for that."""
    df = fixtures._derived(spark, D, "edges")
    assert not any("/graph-" in path for path in df.inputFiles())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_partitions_of_edges_follow_every_table(spark, tmp_path, monkeypatch):
    """F16 to F20: before, partitions followed line items alone, and orders without any were hashed in few of them."""
    monkeypatch.setattr(fixtures, "WIDE_ROWS", 100)
    for large in fixtures.WIDE_TABLES:
        for t in fixtures.WIDE_TABLES:
            spark.range(5000 if t == large else 10).write.parquet(f"{tmp_path}/{large}/{t}.parquet")
        assert fixtures._wide(spark, f"{tmp_path}/{large}").conf.get("spark.sql.shuffle.partitions") == "51"


def test_dependencies_are_not_written_twice():
    assert "dependencies" not in fixtures.WRITTEN and fixtures.WRITTEN.index("edges")


def planned(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_prefixes_are_not_sent_to_the_driver(spark):
    """before, all prefixes of all targets were what was broadcast, as they were taken for few."""
    classes = spark.createDataFrame([("a",), ("a.B",), ("none",)], "fqn string")
    summaries = spark.createDataFrame([("a.B.f()",), ("a",), ("a.Bc",), ("",), (None,)], "target_fqn string")
    out = business.by_prefix(classes, summaries)
    assert rows(out) == rows(spark.createDataFrame([("a", "a.B.f()"), ("a.B", "a.B.f()"), ("a", "a.Bc"), ("a.B", "a.Bc")], "fqn string, target_fqn string"))
    assert "strategy=broadcast" in planned(out).split("Generate explode")[0]


def test_models_are_asked_by_all_tasks(spark):
    """before, the texts of one small file were one task's."""
    texts = spark.range(100).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("text")).coalesce(1)
    out = business.asked(texts.withColumn("at", F.lit(0)), F.col("text"), "answer", lambda x: x.str.upper(), F.lit("else"))
    assert sorted(r["answer"] for r in out.collect()) == sorted(f"T{k}" for k in range(100))
    assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert business.spread(texts, rows=5).rdd.getNumPartitions() == 21


def test_refresh_counts_of_odd_tables(spark):
    """before, the affected symbols were found twice and nothing of them was written or counted."""
    symbols = spark.createDataFrame([("p.A", None), ("p.A.f()", "p.A"), ("p.A.g()", "p.A"), ("p.A.g()", "p.A"), ("p.B.h()", "p.B")], "fqn string, parent_fqn string")
    edges = spark.createDataFrame([("p.B.h()", "p.A.f()", "calls"), ("p.B.h()", "p.A.g()", "calls"), ("x", "p.A.g()", "inherits")], "from_fqn string, to_fqn string, relation string")
    summaries = spark.createDataFrame([("p.A.f()", False), ("p.B.h()", True)], "target_fqn string, is_stale boolean")
    sources = spark.createDataFrame([("p.A.f()", "x"), ("p.A.g()", "y"), ("p.A.g()", "z"), ("p.B.h()", "h"), ("p.A", "")], "fqn string, content string")
    out = business.refresh_result(symbols, edges, summaries, sources, symbols.where("parent_fqn = 'p.A'"))
    assert out.first().asDict() == {"regenerated": 3, "skipped": 1, "changed": 2, "affected": 4}
    hit = planned(graph.affected(symbols, edges, symbols.where("parent_fqn = 'p.A'")))
    assert "strategy=broadcast" in hit


def test_layers_send_the_chain_to_the_symbols(spark):
    """before, all symbols were shuffled for the layers of a few."""
    chain = spark.createDataFrame([("s", 0, "a", "p.XService.f()"), ("s", 1, "p.XService.f()", "no.such()"), ("s", 0, "a", None)], "source string, depth int, from_fqn string, to_fqn string")
    symbols = spark.createDataFrame([("p.XService.f()", "f", None), ("b", "b", None)], "fqn string, name string, annotations array<string>")
    out = graph.with_layers(chain, symbols)
    assert sorted((str(r["to_fqn"]), str(r["layer"])) for r in out.collect())[1:] == [("no.such()", "unknown"), ("p.XService.f()", "service")]
    assert out.count() == 3 and "strategy=broadcast" in planned(out)


def test_coverage_shuffles_edges_once(spark):
    """before, edges were shuffled to be made distinct and once more to meet their callers."""
    symbols = spark.createDataFrame([("a", "src/test/java/A.java"), ("b", None), ("b", "src/main/B.java"), ("c", "src/main/C.java")], "fqn string, file_path string")
    edges = spark.createDataFrame([("a", "t", "calls"), ("a", "t", "inherits"), ("b", "t", "calls"), ("none", "t", "calls"), (None, "t", "calls"), ("c", None, "calls")], "from_fqn string, to_fqn string, relation string")
    out = measures.coverage(symbols, edges)
    assert rows(out) == sorted(map(repr, [("t", 3, 1, 33.33), (None, 1, 0, 0.0)]))
    plan = measures.coverage(symbols, edges)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 3  # edges, symbols, targets


def test_later_steps_look_for_deleted_symbols_alone(spark):
    """before, every step looked for all symbols in every table."""
    symbols = spark.createDataFrame([("a", None), ("b", "gone"), ("c", "b"), ("d", "c"), ("twice", "gone"), ("twice", None), (None, "a")], "fqn string, parent_fqn string")
    edges = spark.createDataFrame([("a", "b"), ("b", "x"), ("a", "a"), ("a", "twice"), ("d", "a"), ("a", None)], "from_fqn string, to_fqn string")
    notes = spark.createDataFrame([("d", 1), ("d", 2), ("z", 3), ("twice", 4), (None, 5)], "source_fqn string, n int")
    after, plan = rebuild.clean_plan({"symbols": symbols, "edges": edges, "notes": notes}, {"symbols": {"parent_fqn": "delete"}, "edges": {"from_fqn": "delete", "to_fqn": "delete"}, "notes": {"source_fqn": "null"}})
    assert rows(plan.select("step", "table_name", "column_name", "n_rows")) == sorted(map(repr, [(1, "symbols", "parent_fqn", 2), (1, "edges", "to_fqn", 1), (1, "notes", "source_fqn", 1), (2, "symbols", "parent_fqn", 1), (2, "edges", "to_fqn", 1), (3, "symbols", "parent_fqn", 1), (4, "edges", "from_fqn", 1), (4, "notes", "source_fqn", 2)]))
    assert sorted(str(r["fqn"]) for r in after["symbols"].collect()) == ["None", "a", "twice"]
    assert rows(after["edges"]) == sorted(map(repr, [("a", "a"), ("a", "twice"), ("a", None)]))
    assert rows(after["notes"]) == sorted(map(repr, [(None, 1), (None, 2), (None, 3), ("twice", 4), (None, 5)]))


def test_no_row_holds_a_large_class(spark):
    """F1 of round 4: before, one row held all methods of a class with their calls, millions in a service class."""
    own = spark.createDataFrame([("p.Big", "class", None), ("p.Small", "interface", None), ("p.None", "enum", None), ("p.Small.f()", "method", "p.Small"), ("p.Small.g()", "method", "p.Small"), ("gone.f()", "method", "gone"), (None, "method", "p.Small"), ("free()", "method", None)], "fqn string, kind string, parent_fqn string")
    big = spark.range(5000).select(F.format_string("p.Big.m%04d()", "id").alias("fqn"), F.lit("method").alias("kind"), F.lit("p.Big").alias("parent_fqn"))
    symbols = own.unionByName(big).withColumn("annotations", F.array(F.lit("a")))
    calls = spark.range(12_000).select(F.format_string("p.Big.m%04d()", F.col("id") % 4000).alias("from_fqn"), F.format_string("t%05d", 12_000 - F.col("id")).alias("to_fqn"), F.lit("calls").alias("relation"))
    edges = calls.unionByName(spark.createDataFrame([("p.Small.f()", "y", "calls"), ("p.Small.f()", "x", "calls"), ("p.Small.f()", None, "calls"), ("p.Small.g()", "x", "uses"), (None, "x", "calls"), ("gone.f()", "x", "calls")], "from_fqn string, to_fqn string, relation string"))
    out = nested.nest(symbols, edges).cache()
    assert out.selectExpr("max(size(methods))").first()[0] < 1200
    assert sorted(r["part"] for r in out.where("fqn = 'p.Big'").collect()) == list(range(5))
    assert rows(out.where("fqn <> 'p.Big'").selectExpr("fqn", "type", "annotations", "part", "to_json(methods)")) == sorted(map(repr, [
        ("p.None", "enum", ["a"], 0, "[]"),
        ("p.Small", "interface", ["a"], 0, '[{"calls":[]},{"fqn":"p.Small.f()","calls":["x","y"]},{"fqn":"p.Small.g()","calls":[]}]'),
    ]))
    flat = out.where("fqn = 'p.Big'").selectExpr("inline(methods)")
    want = [(f"p.Big.m{k:04d}()", [f"t{12_000 - n:05d}" for n in (k + 8000, k + 4000, k)] if k < 4000 else []) for k in range(5000)]
    assert rows(flat) == sorted(map(repr, want))
    outline = nested.outline(symbols, edges.where("to_fqn is not null"))
    assert rows(nested.light_index(out)) == rows(nested.light_index(outline)) and rows(nested.totals(out)) == rows(nested.totals(outline)) == [repr((3, 5003, 12_002))]


def test_nested_classes_of_repeated_symbols(spark, tmp_path, monkeypatch):
    """Parts of a class are put together as the SQL has them, also where parts are given twice or have no brand."""
    monkeypatch.setattr(nested.nest, "__defaults__", (7,))
    for t in ("region", "nation", "supplier", "customer", "orders", "lineitem"):
        spark.read.parquet(f"{D}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    part = spark.read.parquet(f"{D}/part.parquet").withColumn("p_brand", F.when(F.col("p_partkey") % 5 > 0, F.col("p_brand")))
    part.unionByName(part.where("p_partkey % 3 = 0")).write.parquet(f"{tmp_path}/part.parquet")
    db = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = db.sql(catalog.SQL["a10_nested_classes"])
    out = catalog.QUERIES["a10_nested_classes"](spark, str(tmp_path))
    assert out.columns == want.columns and rows(out) == sorted(map(repr, want.fetchall()))
