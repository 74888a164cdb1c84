"""Small cases of the scalar functions, traversal, ingest and limiter."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeweft import catalog as queries
from codeweft.functions import scalars
from codeweft.operators import graph, jobs, mutations, relations, testmap
from codeweft.plans import business, rules
from codeweft.plans.impact import impact
from codeweft.sources import classes, files
from codeweft.streaming.limits import Limiter, limited, limited_stream
from codeweft.streaming.progress import stream_totals


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("base", "path", "want"), [("/api", "/users", "/api/users"), ("/api/", "users", "/api/users"), ("/api", "/api/x", "/api/x"), ("/api", "", "/api"), ("", "x", "/x"), (None, None, "/")])
def test_http_path(spark, base, path, want):
    assert one(spark, scalars.http_path(F.lit(base).cast("string"), F.lit(path).cast("string"))) == want


def test_risk(spark):
    assert one(spark, scalars.risk_score(F.lit(21), F.lit(6), F.lit(6))) == 100
    assert one(spark, scalars.risk_level(F.lit(69))) == "HIGH"


def test_traversal_stops_at_cycles_and_depth(spark):
    edges = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "b", "calls")], "from_fqn string, to_fqn string, relation string")
    start = spark.createDataFrame([("a",)], "fqn string")
    rows = graph.traverse(edges, start, max_depth=3).collect()
    assert sorted((r["depth"], r["from_fqn"], r["to_fqn"]) for r in rows) == [(0, "a", "b"), (1, "b", "c"), (2, "c", "a"), (3, "a", "b")]
    assert graph.traverse(edges, spark.createDataFrame([("x",)], "fqn string")).count() == 0


def test_rule_and_unknown_rule(spark):
    symbols = spark.createDataFrame(
        [("p.AController", "class", "AController", None, None), ("p.AController.f()", "method", "f", "p.AController", None), ("q.BMapper", "class", "BMapper", None, None), ("q.BaseMapper", "class", "BaseMapper", None, ["Mapper"])],
        "fqn string, kind string, name string, parent_fqn string, annotations array<string>",
    )
    edges = spark.createDataFrame([("p.AController.f()", "q.BMapper.g(java.lang.Long)", "calls"), ("p.AController.f()", "q.BaseMapper.h()", "calls")], "from_fqn string, to_fqn string, relation string")
    found = rules.detect(symbols, edges)
    assert [r["to_fqn"] for r in found.collect()] == ["q.BMapper.g(java.lang.Long)"]
    assert rules.check(found, spark.createDataFrame([("p.AController.f()",)], "fqn string")).count() == 1
    with pytest.raises(ValueError):
        rules.detect(symbols, edges, "none")
    with pytest.raises(ValueError):
        relations.related(symbols, edges, "p.AController", "sideways")


def test_ingest(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"fqn":"p.A","classBasePath":"/a","inheritance":[{"fqn":"p.B","kind":"extends"}],"methods":[{"fqn":"p.A.f(x.Y)","isRestEndpoint":true,"apiPath":"g","isScheduled":true,"scheduledCron":"0","calls":[{"toFqn":"java.util.List.add()"},{"toFqn":"p.C.h()"}]}]}')
    got = classes.read_classes(spark, str(tmp_path))
    assert {(r["fqn"], r["name"]) for r in classes.flatten_symbols(got).collect()} == {("p.A", "A"), ("p.A.f(x.Y)", "f")}
    assert {(r["to_fqn"], r["relation"]) for r in classes.flatten_edges(got).collect()} == {("p.B", "inherits"), ("p.C.h()", "calls")}
    assert {(r["entry_type"], r["http_path"]) for r in classes.entry_points(got).collect()} == {("http_api", "/a/g"), ("scheduled", None)}


def test_limiter_counts_accepted_requests_only(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, "c", start + dt.timedelta(milliseconds=900 * i)) for i in range(24)]
    got = {r["request_id"]: r["allowed"] for r in limited(spark.createDataFrame(rows, "request_id long, client string, ts timestamp")).collect()}
    assert sorted(i for i in got if not got[i]) == [10, 11, 22, 23]


def test_impact_finds_tests_by_path(spark):
    main = "src/main/java/p/"
    symbols = [("p.T.t()", None), ("p.A.a()", main + "A.java"), ("p.A.b()", main + "A.java"), ("p.B.b()", main + "B.java"), ("p.C.c()", None), ("p.ATest.x()", "src/test/java/p/ATest.java"), ("p.AIT.x()", "src/test/java/p/AIT.java")]
    edges = [("p.A.a()", "p.T.t()"), ("p.A.b()", "p.T.t()"), ("p.B.b()", "p.T.t()"), ("p.B.b()", "p.A.a()"), ("p.C.c()", "p.B.b()"), ("p.ATest.x()", "p.A.a()")]
    frames = [spark.createDataFrame(symbols, "fqn string, file_path string"), spark.createDataFrame([(*e, "calls") for e in edges], "from_fqn string, to_fqn string, relation string"), spark.createDataFrame([("p.C.c()",)], "symbol_fqn string")]
    got = impact(*frames, spark.createDataFrame([("p.T.t()",), ("p.C.c()",)], "fqn string")).orderBy("source").collect()
    assert [tuple(r)[:6] for r in got] == [("p.C.c()", 0, 0, 0, 0, 0), ("p.T.t()", 7, 1, 1, 5, 55)]
    assert got[1]["risk_level"] == "HIGH" and abs(got[1]["confidence"] - 0.9) < 1e-9


def test_all_orphan_checks_are_made(spark):
    got = {r["table_name"] for r in queries.QUERIES["c10_all_orphans"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {"edges_from", "edges_to", "entry_points", "external_dependencies", "summaries", "glossary", "constraints", "anti_patterns"}


def test_external_calls(spark, tmp_path):
    gone = ["java.", "javax.", "jdk.", "sun.", "com.sun.", "org.w3c.", "org.xml.", "org.omg.", "org.ietf.", "org.slf4j.", "org.apache.", "org.springframework.", "com.fasterxml.", "com.google.", "org.hibernate."]
    calls = ",".join(f'{{"toFqn":"{p}X.f()"}}' for p in [*gone, "jakarta.", "org.mine."])
    (tmp_path / "c.json").write_text('{"fqn":"p.A","methods":[{"fqn":"p.A.f()","calls":[' + calls + "]}]}")
    edges = classes.flatten_edges(classes.read_classes(spark, str(tmp_path)))
    assert {r["to_fqn"] for r in edges.collect()} == {"jakarta.X.f()", "org.mine.X.f()"}


def test_limiter_against_brute_force(spark):
    """Every request is allowed if each window has fewer accepted ones before it than its limit."""
    pick, now, rows = random.Random(4), 0, []
    for i in range(3000):
        now += pick.choice((0, 1, 200_000, 900_000, 5_000_000))
        rows.append((i, i % 3, dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=now)))
    windows = ((10, 4), (60, 15), (600, 90))
    accepted: dict[int, list] = {0: [], 1: [], 2: []}
    want = {}
    for i, client, ts in rows:
        want[i] = all(sum(t > ts - dt.timedelta(seconds=s) for t in accepted[client]) < n for s, n in windows)
        if want[i]:
            accepted[client].append(ts)
    frame = spark.createDataFrame(rows, "request_id long, client long, ts timestamp")
    assert {r["request_id"]: r["allowed"] for r in limited(frame, windows).collect()} == want
    assert {True, False} == set(want.values())


def test_limiter_state_is_what_the_windows_hold():
    one, two = Limiter(((10, 3), (60, 5))), Limiter(((10, 3), (60, 5)))
    for k in range(200):
        us = k * 1_700_000
        two = Limiter(((10, 3), (60, 5)), two.times())
        assert one.accept(us) == two.accept(us) and len(two.times()) <= 5


def test_limiter_on_a_stream(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 2, start + dt.timedelta(milliseconds=700 * i)) for i in range(90)]
    schema = "request_id long, client long, ts timestamp"
    for k in range(3):
        spark.createDataFrame(rows[30 * k : 30 * k + 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = limited_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r["request_id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["request_id"]: r["allowed"] for r in limited(spark.createDataFrame(rows, schema)).collect()}
    assert got == want


def test_progress_of_a_stream(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.json").write_text("".join(f'{{"fqn":"p.A{k}{i}","methods":[{{"fqn":"p.A{k}{i}.f()","calls":[{{"toFqn":"x.y()"}}]}}]}}\n' for i in range(3)))
    seen: list[dict] = []
    stream = spark.readStream.schema(classes.SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    stream_totals(stream, seen.append, 7).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start().awaitTermination(120)
    assert [(s["total_classes"], s["total_calls"], s["percentage"]) for s in seen] == [(3, 3, 42), (6, 6, 85)]


def test_ingest_in_full(spark, tmp_path):
    (tmp_path / "c.json").write_text(
        '{"fqn":"p.A$B","nodeType":"interface","fields":[{"name":"x","type":"int"},{"type":"int"}],"inheritance":[{"fqn":"q.C"},{"fqn":"q.D","kind":"implements"}],"methods":[{"fqn":"p.A$B.f(x.Y)","lineNumber":7,"isEntryPoint":true,"entryPointType":"other","annotations":["@KafkaListener(x)","@JmsListener"],"attributes":{"queue":"k","scheduled_cron":"5"},"isScheduled":true,"calls":[{"toFqn":"io.grpc.Stub.call(a.B)","line":3},{"toFqn":"q.UserDao.get(java.lang.Long)"},{"toFqn":""}]}]}'
    )
    got = classes.pipeline(classes.read_classes(spark, str(tmp_path)), spark.createDataFrame([("p.A", "p/A.java")], "fqn string, file_path string"))
    assert {(r["fqn"], r["kind"], r["line_number"], r["file_path"]) for r in got["symbols"].collect()} == {("p.A$B", "interface", None, "p/A.java"), ("p.A$B.f(x.Y)", "method", 7, "p/A.java"), ("p.A$B.x", "field", None, "p/A.java")}
    assert {(r["to_fqn"], r["relation"]) for r in got["edges"].collect()} == {("q.C", "inherits"), ("q.D", "implements"), ("io.grpc.Stub.call(a.B)", "calls"), ("q.UserDao.get(java.lang.Long)", "calls")}
    assert {(r["entry_type"], r["cron_expression"], r["mq_queue"]) for r in got["entry_points"].collect()} == {("scheduled", "5", None), ("mq_consumer", None, "k")}
    assert {(r["dependency_type"], r["strength"]) for r in got["dependencies"].collect()} == {("rpc", "strong"), ("mysql", "strong")}


def test_sources(spark, tmp_path):
    for name in ("src/main/java/p/A.java", "src/java/p/A.java", "src/q/B.java"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("class X")
    found = files.read_sources(spark, str(tmp_path))
    index = {r["fqn"]: r["file_path"] for r in files.source_index(found).collect()}
    assert set(index) == {"p.A", "q.B"} and index["p.A"].endswith("src/java/p/A.java")
    assert files.changed_files(found, dt.datetime(2000, 1, 1)).count() == 3 and files.changed_files(found, dt.datetime(2100, 1, 1)).count() == 0


def test_merge_takes_the_last_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", 1, 5), ("z", 9, 5), (None, 0, 5)], "k string, v int, made int")
    new = spark.createDataFrame([("a", 2, 0, 1), ("a", 3, 0, 2), ("b", 4, 0, 1), ("b", 5, 0, 0), (None, 7, 0, 0)], "k string, v int, made int, at int")
    got = {(r["k"], r["v"], r["made"]) for r in mutations.merge(old, new, ["k"], keep=("made",), order="at").collect()}
    assert got == {("a", 3, 5), ("b", 4, 0), ("z", 9, 5), (None, 7, 5)}


def test_cascade(spark):
    frames = {
        "symbols": spark.createDataFrame([("a",), ("b",)], "fqn string"),
        "edges": spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "from_fqn string, to_fqn string"),
        "summaries": spark.createDataFrame([("a", "s")], "target_fqn string, summary string"),
        "glossary": spark.createDataFrame([("t", "a")], "code_term string, source_fqn string"),
        "anti_patterns": spark.createDataFrame([("b", "a"), ("a", "b")], "from_fqn string, to_fqn string"),
    }
    got = mutations.cascade_delete(frames, spark.createDataFrame([("a",)], "fqn string"))
    assert {k: sorted(map(tuple, v.collect()), key=str) for k, v in got.items()} == {"symbols": [("b",)], "edges": [("b", "c")], "summaries": [], "glossary": [("t", None)], "anti_patterns": [("b", None)]}


def test_jobs(spark):
    schema = "job_id string, mode string, status string, progress int, created_at timestamp, started_at timestamp, completed_at timestamp"
    first = jobs.create(spark.createDataFrame([], schema), spark.createDataFrame([("x", "full")], "job_id string, mode string"))
    row = jobs.advance(first, "x", status="running", progress=3).first()
    assert row["status"] == "running" and row["started_at"] is not None and row["completed_at"] is None and row["progress"] == 3
    with pytest.raises(ValueError):
        jobs.create(first, spark.createDataFrame([("x", "full")], "job_id string, mode string"))


def test_tests_beside_a_folder(spark):
    known = spark.createDataFrame([("lib/test/ATest.java", "@Test void one() x @Test public void testTwo() y void testThree() z"), ("lib/test/A.java", "")], "path string, content string")
    got = testmap.tests_of_files(spark.createDataFrame([("lib/code/A.java", "p.A"), ("other/code/A.java", "q.A")], "file_path string, fqn string"), known).collect()
    assert [(r["file_path"], r["path"], r["additional_tests"]) for r in got] == [("lib/code/A.java", "lib/test/ATest.java", ["lib/test/A.java"])]
    methods = known.select(scalars.test_methods(F.col("content")).alias("m")).first()["m"]
    assert methods == ["one", "testTwo", "testThree"]


def test_scrub_is_greedy(spark):
    assert one(spark, scalars.scrubbed(F.lit(" a /* print this */ b /* c */ d // the Key\n e "))) == "a  d"
    assert one(spark, scalars.string_array(F.lit('["a", 1]'))) == [] and one(spark, scalars.string_array(F.lit("{"))) == [] and one(spark, scalars.string_array(F.lit('["a"]'))) == ["a"]


def test_a_model_that_fails_gets_a_fallback(spark):
    def model(texts):
        if texts.str.contains("bad").any():
            raise ValueError
        return "摘要: ok"  + texts.str.slice(0, 0)

    rows = spark.createDataFrame([("p.A.bad", "bad", "p.A", None, ["static"], None, "x"), ("p.A.good", "good", "p.A", None, None, None, "y")], "fqn string, name string, parent_fqn string, signature string, modifiers array<string>, annotations array<string>, content string")
    assert {r["fqn"]: r["summary"] for r in business.summarized(rows, model).collect()} == {"p.A.bad": "Static method: bad", "p.A.good": "ok"}
    with pytest.raises(ValueError):
        business.embedded(spark.createDataFrame([(1, " ")], "id long, text string"), model)
    got = business.embedded(spark.createDataFrame([(1, "ab")], "id long, text string"), lambda t: t.map(lambda x: [float(len(x))])).first()
    assert list(got["embedding"]) == [2.0]


def test_rule_by_annotation_and_base(spark):
    symbols = spark.createDataFrame([("p.AController", "class", "AController", None, None), ("p.AController.f()", "method", "f", "p.AController", None), ("q.Store", "class", "Store", None, ["@Repository"]), ("q.BaseStore", "class", "BaseStore", None, ["@Repository"]), ("q.Plain", "class", "Plain", None, None)], "fqn string, kind string, name string, parent_fqn string, annotations array<string>")
    edges = spark.createDataFrame([("p.AController.f()", t, "calls") for t in ("q.Store.g(a.B)", "q.Store.g(a.B)", "q.BaseStore.g()", "q.Plain.g()")], "from_fqn string, to_fqn string, relation string")
    assert [r["to_fqn"] for r in rules.detect(symbols, edges).collect()] == ["q.Store.g(a.B)"] * 2
