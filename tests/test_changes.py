"""Versions, rebuilds, modules, jobs with several takers, streams that restart, models that fail, and mends."""

import collections
import datetime as dt
import hashlib
import json
import shutil
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from codeweft import fixtures
from codeweft.operators import jobs, mutations
from codeweft.plans import business, rebuild
from codeweft.scratch import create_new, cut, listed, read_small, shared_folder, tidied
from codeweft.sources import classes as classes_of
from codeweft.sources import modules as modules_of
from codeweft.sources.versions import Conflict, Unfit, Versions
from codeweft.streaming import progress
from codeweft.streaming.limits import limited


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(versions, name, number=None):
    return sorted(r["v"] for r in versions.read(name, number=number)[0].collect())


def test_versions(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.current() == 0 and versions.recover() == []
    with pytest.raises(LookupError):
        versions.read("a")
    assert versions.publish({"a": numbers(spark, 1), "b": numbers(spark)}) == 1
    assert versions.publish({"a": numbers(spark, 1, 2), "b": numbers(spark, 7)}) == 2
    assert held(versions, "a") == [1, 2] and held(versions, "a", 1) == [1] and held(versions, "b") == [7] and versions.tables(2) == ["a", "b"]
    with pytest.raises(Conflict):  # derived from a version that has been followed
        versions.publish({"a": numbers(spark, 9)}, after=1)
    with pytest.raises(Unfit, match="empty"):
        versions.publish({"a": numbers(spark)}, check=lambda t: "empty" if t["a"].isEmpty() else None)
    assert versions.current() == 2 and versions.recover() == []  # what failed has left nothing
    for k in range(3):
        versions.change(("a",), lambda a, k=k: {"a": a.unionByName(numbers(spark, 10 + k))})
    assert held(versions, "a") == [1, 2, 10, 11, 12]
    assert versions.retain(2) == [1, 2] and sorted(versions.marks()) == [3, 4, 5] and held(versions, "a", 3) == [1, 2, 10]
    assert len([x for x in listed(spark, versions.root) if x.startswith("set-")]) == 3


def test_a_failing_second_table_leaves_the_old_pair(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    versions.publish({"summaries": numbers(spark, 1), "vectors": numbers(spark, 1)})
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        versions.publish({"summaries": numbers(spark, 2), "vectors": numbers(spark, 2).select((F.col("v") / F.lit(0)).alias("v"))})
    assert versions.current() == 1 and held(versions, "summaries") == held(versions, "vectors") == [1]
    assert len([x for x in listed(spark, versions.root) if x.startswith("set-")]) == 1


def test_recovery_in_three_cases(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    versions.publish({"a": numbers(spark, 1)})
    numbers(spark, 2).write.parquet(f"{versions.root}/set-lost/a")  # crashed before its mark
    create_new(spark, f"{versions.root}/marks/2", "")  # crashed while it was made
    assert versions.current() == 1 and held(versions, "a") == [1]
    assert sorted(versions.recover()) == ["marks/2", "set-lost"]
    versions.publish({"a": numbers(spark, 3)})
    shutil.rmtree(f"{versions.root}/{versions.marks()[2]}/a")  # its set is gone
    assert versions.recover()[0] == "marks/2" and versions.current() == 1 and held(versions, "a") == [1]
    versions.publish({"a": numbers(spark, 4)})
    (tmp_path / "v" / versions.marks()[2] / "a" / "_SUCCESS").unlink()
    assert versions.recover()[0] == "marks/2" and versions.recover() == []


def test_one_of_several_writers_wins(spark, tmp_path):
    versions, done = Versions(spark, str(tmp_path / "v")), []
    versions.publish({"a": numbers(spark, 0)})

    def write(k):
        try:
            done.append((k, versions.publish({"a": numbers(spark, k)}, after=1)))
        except Conflict:
            done.append((k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winners = [k for k, number in done if number == 2]
    assert len(done) == 4 and len(winners) == 1 and held(versions, "a") == winners

    def add(k):
        versions.change(("a",), lambda a: {"a": a.unionByName(numbers(spark, k))}, attempts=20)

    threads = [threading.Thread(target=add, args=(k,)) for k in range(10, 13)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert held(versions, "a") == [*winners, 10, 11, 12]


def board(spark, folder):
    rows = [(f"j{k}", "pending" if k else "complete", dt.datetime(2024, 1, 1 + k), 0, None, None) for k in range(5)]
    return jobs.Board(spark.createDataFrame(rows, "job_id string, status string, created_at timestamp, progress int, error_message string, completed_at timestamp"), str(folder))


def test_each_job_has_one_taker(spark, tmp_path):
    got: list[str] = []

    def work():
        own = board(spark, tmp_path)
        while (job := own.take_next()) is not None:
            got.append(job["job_id"])

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == ["j1", "j2", "j3", "j4"]
    assert {r["job_id"]: r["status"] for r in board(spark, tmp_path).jobs().collect()} == {"j0": "complete"} | {f"j{k}": "running" for k in range(1, 5)}


def test_acquired_jobs_end(spark, tmp_path):
    own = board(spark, tmp_path)
    assert own.jobs().where("status = 'pending'").count() == 4
    with own.acquire("j1") as job:
        assert job["status"] == "running" and own.jobs().where("job_id = 'j1'").first()["status"] == "running"
        with pytest.raises(ValueError, match="available"), own.acquire("j1"):
            pass
    with pytest.raises(KeyError), own.acquire("j2"):
        raise KeyError("broken")
    rows = {r["job_id"]: r for r in own.jobs().collect()}
    assert (rows["j1"]["status"], rows["j1"]["progress"], rows["j2"]["status"]) == ("complete", 100, "failed") and "broken" in rows["j2"]["error_message"]
    assert rows["j1"]["completed_at"] is not None and rows["j3"]["status"] == "pending" and rows["j3"]["completed_at"] is None
    for known in ("j0", "j2"):
        with pytest.raises(ValueError, match="available"), own.acquire(known):
            pass
    with pytest.raises(ValueError, match="no job"):
        own.take("nobody")
    assert own.take_next()["job_id"] == "j3"


def nested(spark, rows):
    """Classes of ``fqn, parent, callees``; each has one method ``f``."""
    made = [(f, [(p, "extends")] if p else [], [{"fqn": f"{f}.f()", "calls": [(c, "invokevirtual", 1, None, False) for c in calls]}]) for f, p, calls in rows]
    text = [json.dumps({"fqn": f, "inheritance": [{"fqn": a, "kind": b} for a, b in i], "fields": [], "methods": [{"fqn": m["fqn"], "annotations": ["@KafkaListener"], "calls": [{"toFqn": c[0], "kind": c[1]} for c in m["calls"]]} for m in ms]}) for f, i, ms in made]
    return spark.createDataFrame([(t,) for t in text], "value string").select(F.from_json("value", classes_of.SCHEMA).alias("c")).select("c.*")


def sources(classes):
    return classes.select(classes_of.outer_name(F.col("fqn")).alias("fqn")).distinct().select("fqn", F.concat("fqn", F.lit(".java")).alias("file_path"))


def listing(spark, **sizes):
    return spark.createDataFrame([(f"p.{k}.java", v) for k, v in sizes.items()], "file_path string, size int")


OLD = [("p.A", None, ["p.B.f()", "q.UserDao.get()"]), ("p.B", "p.A", ["p.C.f()"]), ("p.C", "p.B", []), ("p.C$In", "p.C", ["p.A.f()"]), ("p.D", None, ["p.C.f()"])]
NEW = [("p.A", None, ["p.B.f()", "q.UserDao.get()"]), ("p.C", "p.A", ["p.E.f()"]), ("p.D", None, ["p.C.f()"]), ("p.E", "p.C", ["org.springframework.web.client.RestTemplate.getForObject()"])]  # B gone, C changed and without In, E new


def as_rows(df):
    return sorted((tuple(map(str, r)) for r in df.select(sorted(df.columns)).collect()))


def test_incremental_equals_full(spark, tmp_path):
    old, new = nested(spark, OLD), nested(spark, NEW)
    versions = Versions(spark, str(tmp_path / "v"))
    assert rebuild.rebuild_full(versions, old, sources(old), listing(spark, A=1, B=1, C=1, D=1))["version"] == 1
    assert rebuild.rebuild_incremental(versions, old, sources(old), listing(spark, A=1, B=1, C=1, D=1))["reason"] == "no_changes"
    other = listing(spark, A=1, B=1, C=1, D=1).unionByName(spark.createDataFrame([("p.txt", 1)], "file_path string, size int"))
    assert rebuild.rebuild_incremental(versions, old, sources(old), other) == {"status": "skipped", "reason": "no_java_files", "version": 1}
    done = rebuild.rebuild_incremental(versions, new, sources(new), listing(spark, A=1, C=2, D=1, E=1))
    assert done == {"status": "success", "type": "incremental", "changed_files": 3, "version": 2}
    full = rebuild.extracted(new, sources(new))
    for name, df in full.items():
        assert as_rows(versions.read(name)[0]) == as_rows(df), name
    assert versions.read("dependencies")[0].count() == 2
    with pytest.raises(Unfit):
        rebuild.rebuild_full(versions, new.unionByName(new), sources(new), listing(spark))
    assert versions.current() == 2


def test_what_hangs_on_changed_symbols(spark):
    old, new = nested(spark, OLD), nested(spark, NEW)
    tables = rebuild.extracted(old, sources(old))
    tables["summaries"] = spark.createDataFrame([(f, False) for f in ("p.A", "p.B", "p.C", "p.C$In", "p.D.f()", "far.away")], "target_fqn string, is_stale boolean")
    tables["glossary"] = spark.createDataFrame([("b", "p.B"), ("c", "p.C"), ("n", None)], "code_term string, source_fqn string")
    changed = rebuild.changes(listing(spark, A=1, B=1, C=1, D=1), listing(spark, A=1, C=2, D=1, E=1))
    assert {r["file_path"]: r["change"] for r in changed.collect()} == {"p.B.java": "removed", "p.C.java": "changed", "p.E.java": "added"}
    after = rebuild.incremental(tables, changed, new, sources(new))
    assert {r["target_fqn"]: r["is_stale"] for r in after["summaries"].collect()} == {"p.A": False, "p.C": True, "p.D.f()": False, "far.away": False}
    assert {r["code_term"]: r["source_fqn"] for r in after["glossary"].collect()} == {"b": None, "c": "p.C", "n": None}


def test_cleaning_goes_on_until_nothing_is_lost(spark):
    frames = {
        "symbols": spark.createDataFrame([("a", None), ("b", "a"), ("c", "gone"), ("d", "c"), ("e", "d")], "fqn string, parent_fqn string"),
        "edges": spark.createDataFrame([("a", "b"), ("a", "e"), ("x", "a")], "from_fqn string, to_fqn string"),
        "constraints": spark.createDataFrame([("k", "e"), ("l", None)], "name string, source_fqn string"),
    }
    rules = mutations.CASCADE | {"symbols": {"parent_fqn": "delete"}}
    after, plan = rebuild.clean_plan(frames, rules)
    assert [tuple(r) for r in plan.orderBy("step", "table_name").collect()] == [(1, "edges", "from_fqn", "delete", 1), (1, "symbols", "parent_fqn", "delete", 1), (2, "symbols", "parent_fqn", "delete", 1), (3, "symbols", "parent_fqn", "delete", 1), (4, "constraints", "source_fqn", "null", 1), (4, "edges", "to_fqn", "delete", 1)]
    assert sorted(r["fqn"] for r in after["symbols"].collect()) == ["a", "b"] and after["edges"].count() == 1
    assert {r["name"]: r["source_fqn"] for r in after["constraints"].collect()} == {"k": None, "l": None} and frames["symbols"].count() == 5
    assert rebuild.clean_plan(after, rules)[1].isEmpty()


def test_modules_are_extracted_when_they_change(spark, tmp_path):
    (tmp_path / "in" / "module=one").mkdir(parents=True)
    (tmp_path / "in" / "module=two's").mkdir()

    def put(module, *lines):
        (tmp_path / "in" / f"module={module}" / "c.json").write_text("\n".join(lines))

    def run(**stamps):
        files = spark.createDataFrame([(m.replace("_", "'"), f"{m}.class", s, 1) for m, s in stamps.items()], "module string, path string, modified long, size long")
        return {r["module"]: r for r in own.extract(modules_of.read_modules(spark, str(tmp_path / "in")), None, files).collect()}

    own = modules_of.Modules(spark, str(tmp_path / "out"))
    assert own.hashes().isEmpty() and own.read("symbols").isEmpty()
    put("one", '{"fqn":"a.A","methods":[{"fqn":"a.A.f()","annotations":["@JmsListener"],"calls":[{"toFqn":"a.UserMapper.insert()"}]}]}')
    put("two's", '{"fqn":"b.B"}', '{"fqn":"b.C","inheritance":[{"fqn":"b.B"}]}')
    first = run(one=1, two_s=1)
    assert (first["one"]["status"], first["one"]["n_symbols"], first["one"]["n_entry_points"], first["one"]["n_dependencies"]) == ("extracted", 2, 1, 1)
    assert (first["two's"]["status"], first["two's"]["n_symbols"], first["two's"]["n_edges"]) == ("extracted", 2, 1)
    assert {r["status"] for r in run(one=1, two_s=1).values()} == {"skipped"}

    put("one", '{"fqn":"a.A"}')  # its entry point and call are gone
    put("two's", '{"fqn":"b.B"}', "{broken", '{"methods":[]}')
    second = run(one=2, two_s=2)
    assert second["one"]["status"] == "extracted" and second["one"]["n_entry_points"] == 0 and second["two's"]["status"] == "error" and "broken" in second["two's"]["error"]
    assert own.read("entry_points").isEmpty() and sorted(r["fqn"] for r in own.read("symbols").collect()) == ["a.A", "b.B", "b.C"]
    summary = modules_of.project_result(own.extract(modules_of.read_modules(spark, str(tmp_path / "in")), None, spark.createDataFrame([("one", "one.class", 2, 1), ("two's", "two_s.class", 2, 1)], "module string, path string, modified long, size long"))).first()
    assert not summary["success"] and summary["modules"] == 2 and summary["errors"][0].startswith("two's: ")

    put("two's", '{"fqn":"b.B"}')
    assert {m: r["status"] for m, r in run(one=2, two_s=2).items()} == {"one": "skipped", "two's": "extracted"}  # tried again, as its hash isn't stored
    assert own.sweep() > 0 and own.sweep() == 0 and sorted(r["fqn"] for r in own.read("symbols").collect()) == ["a.A", "b.B"]
    assert list(run(one=2)) == ["one"] and [r["fqn"] for r in own.read("symbols").collect()] == ["a.A"]


def test_hashes_follow_the_listing(spark):
    rows = [("m", f"{k}.class", k, 1) for k in range(600)] + [("n", "x.class", 1, 1)]
    files = spark.createDataFrame(rows, "module string, path string, modified long, size long")
    one = {r["module"]: r["hash"] for r in modules_of.module_hashes(files).collect()}
    assert one == {r["module"]: r["hash"] for r in modules_of.module_hashes(files.orderBy(F.desc("path")).repartition(3)).collect()} and len(one["m"]) == 64
    moved = files.withColumn("modified", F.when(F.col("path") == "77.class", 0).otherwise(F.col("modified")))
    assert [one[r["module"]] == r["hash"] for r in modules_of.module_hashes(moved).orderBy("module").collect()] == [False, True]
    parts = collections.defaultdict(list)
    import zlib

    for _, path, modified, size in rows[:-1]:
        parts[zlib.crc32(path.encode()) % 256].append(f"{path}\t{modified}\t{size}")
    lines = sorted(f"{p:04d}\t{hashlib.sha256(chr(10).join(sorted(x)).encode()).hexdigest()}" for p, x in parts.items())
    assert one["m"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_class_folders(spark, tmp_path):
    for path in ("shop/target/classes/a/B.class", "shop/target/classes/a/C.class", "web/build/classes/java/main/D.class", "web/build/classes/java/test/E.class", "src/F.class"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(b"x")
    found = modules_of.read_class_files(spark, str(tmp_path))
    assert sorted((r["module"], r["path"].rsplit("/", 1)[1], r["size"]) for r in found.collect()) == [("shop", "B.class", 1), ("shop", "C.class", 1), ("web", "D.class", 1)]
    assert sorted(r["path"].rsplit("/", 1)[1] for r in modules_of.first_files(found, 1).collect()) == ["B.class", "D.class"] and modules_of.module_hashes(found).count() == 2


def test_a_restarted_stream_goes_on(spark, tmp_path):
    def put(k, *extra):
        (tmp_path / "in").mkdir(exist_ok=True)
        lines = [f'{{"fqn":"p.A{k}{i}","methods":[{{"fqn":"p.A{k}{i}.f()","calls":[{{"toFqn":"x.y()"}}]}}]}}' for i in range(3)]
        (tmp_path / "in" / f"{k}.json").write_text("\n".join([*lines, *extra]))

    def run(name, seen):
        schema = modules_of.StructType.fromDDL(f"{classes_of.SCHEMA}, _broken string")
        stream = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", "_broken").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        progress.stream_totals(stream, seen.append, 9, str(tmp_path / name)).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start().awaitTermination(120)

    broken: list[dict] = []
    put(0)
    run("halting", broken)
    put(1, "{no class")
    put(2)
    run("halting", broken)  # a new query, from the checkpoint
    run("halting", broken)  # with nothing to do
    unbroken: list[dict] = []
    run("unbroken", unbroken)
    shown = ("event", "total_classes", "total_methods", "total_calls", "total_errors", "percentage")
    assert sorted(tuple(e[k] for k in shown) for e in broken)[-1] == ("progress", 9, 9, 9, 1, 100) and len(broken) == len(unbroken) == 3
    both = [[tuple(r[k] for k in shown) for r in progress.events(spark, str(tmp_path / name), 9).orderBy("batch", "event").collect()] for name in ("halting", "unbroken")]
    assert both[0][0][0] == "start" and both[0][-2][0] == "complete" and both[0][-1] == both[1][-1] == ("progress", 9, 9, 9, 1, 100)
    assert [r["error"] for r in progress.errors(spark, str(tmp_path / "halting")).collect()] == ["no JSON: {no class"]
    assert progress.errors(spark, str(tmp_path / "none")).isEmpty() and progress.events(spark, str(tmp_path / "none"), 9).count() == 1


class Flaky:
    """Fails for each text of a kind until it was asked for so many times; remembers how many calls are under way."""

    def __init__(self, folder, times, error):
        self.folder, self.times, self.error = folder, times, error

    def __call__(self, texts):
        import os

        for text in texts:
            path = f"{self.folder}/{text}"
            with open(path, "a") as f:
                f.write(".")
            if text.startswith("flaky") and os.path.getsize(path) <= self.times:
                raise self.error("not now")
            if text.startswith("never"):
                raise self.error("not ever")
        time.sleep(0.01)
        return pd.Series([None if t == "nothing" else t.upper() for t in texts])


def test_a_model_that_fails_twice(spark, tmp_path):
    texts = [f"t{k}" for k in range(30)] + ["flaky1", "never", "nothing", "flaky2"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    calls = business.Calls(together=4, threads=3, attempts=3, wait=0.01, longest=0.02)
    said = cut(rows.withColumn("said", business.responses(F.col("text"), Flaky(str(tmp_path), 2, ConnectionError), calls)))
    got = {r["text"]: r["said"] for r in said.collect()}
    assert all(got[t]["answer"] == t.upper() and not got[t]["failed"] for t in texts if t[0] == "t" or t.startswith("flaky"))
    assert got["never"]["failed"] and got["never"]["answer"] is None and got["nothing"]["answer"] is None and not got["nothing"]["failed"]
    assert got["t0"]["attempts"] == 1 and got["never"]["attempts"] == 6
    counts = business.call_counts(said).first()
    assert (counts["total"], counts["success"], counts["failed"]) == (34, 33, 1) and counts["retries"] == counts["calls"] - 34 > 0


def test_errors_that_are_not_worth_another_call(spark, tmp_path):
    rows = spark.createDataFrame([("flaky",), ("fine",)], "text string").coalesce(1)
    said = rows.withColumn("said", business.responses(F.col("text"), Flaky(str(tmp_path), 1, ValueError), business.Calls(wait=0.01))).collect()
    assert {r["text"]: (r["said"]["failed"], r["said"]["attempts"]) for r in said} == {"flaky": (False, 2), "fine": (False, 2)}  # together once, then alone
    assert rows.limit(0).withColumn("said", business.responses(F.col("text"), Flaky(str(tmp_path), 1, ValueError))).isEmpty()
    out = business.asked(rows.unionByName(spark.createDataFrame([("never",)], "text string")).coalesce(1), F.col("text"), "answer", Flaky(str(tmp_path), 0, ValueError), F.lit("else"))
    assert {r["text"]: r["answer"] for r in out.collect()} == {"flaky": "FLAKY", "fine": "FINE", "never": "else"} and out.columns == ["text", "answer"]


def test_structured_answers(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("no",)], "t string")
    assert [r["a"] for r in rows.select(business.structured(F.col("t"), "a int")["a"].alias("a")).collect()] == [1, None]
    with pytest.raises(Exception, match="MALFORMED"):
        rows.select(business.structured(F.col("t"), "a int", strict=True)["a"].alias("a")).collect()


def joined(texts):
    """A stand-in for a model: what it says is the listed parts in one line; it must not be given too many."""
    lists = texts.str.split("parts:\n").str[1].str.split("\n")
    assert lists.str.len().max() <= 3
    return lists.map(lambda lines: "+".join(line.removeprefix("- ") for line in lines))


def test_roll_up_in_a_tree(spark):
    rows = [("p.A", "A", f"m{k:02d}", f"s{k}") for k in range(20)] + [("p.B", "B", "m", "one"), ("p.C", "C", "m", "N/A"), ("p.C", "C", "n", ""), ("p.D", "D", None, None)]
    parts = spark.createDataFrame(rows, "fqn string, name string, part string, summary string")
    got = {r["fqn"]: r["summary"] for r in business.rolled_up(parts, "(class)", joined, fan_in=3).collect()}
    assert got == {"p.A": "+".join(f"s{k}" for k in range(20)), "p.B": "one", "p.C": "C (class)", "p.D": "D (class)"}
    plain = {r["fqn"]: r["summary"] for r in business.rolled_up(parts, "(class)").collect()}
    assert plain["p.B"] == "- one" and plain["p.D"] == "D (class)" and plain["p.A"].count("\n") == 19


def test_embedding_in_batches(spark):
    sizes = []

    def model(texts):
        assert len(texts) <= 4
        return texts.map(lambda t: [float(len(t))])

    rows = spark.createDataFrame([(k, "x" * (k + 1)) for k in range(11)], "id int, text string")
    assert {r["id"]: r["embedding"] for r in business.embedded(rows, model, together=4).collect()} == {k: [k + 1.0] for k in range(11)} and not sizes
    with pytest.raises(ValueError, match="empty"):
        business.embedded(spark.createDataFrame([(1, " ")], "id int, text string"), model)


def test_clients_without_a_number(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(k, None, start + dt.timedelta(milliseconds=k)) for k in range(50)] + [(100 + k, 7, start + dt.timedelta(milliseconds=k)) for k in range(12)]
    got = limited(spark.createDataFrame(rows, "request_id long, client long, ts timestamp")).collect()
    assert sum(r["allowed"] for r in got if r["client"] is None) == 10 and sum(r["allowed"] for r in got if r["client"] == 7) == 10


def test_vector_ids_of_repeated_keys(spark):
    old = spark.createDataFrame([("a", "v1", True), ("a", "v2", True), ("b", "v3", True), (None, None, True)], "target_fqn string, vector_id string, is_stale boolean")
    ids = spark.createDataFrame([("b", "new"), ("c", "other")], "target_fqn string, vector_id string")
    got = sorted((tuple(r) for r in mutations.set_vector_ids(old, "target_fqn", ids).select("target_fqn", "vector_id", "is_stale").collect()), key=str)
    assert got == [("a", "v1", True), ("a", "v2", True), ("b", "new", False), (None, None, True)]


def test_written_tables_follow_their_source(spark, tmp_path):
    for name in fixtures.TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    before = fixtures.frame(spark, str(tmp_path), "part_method").count()
    some = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(3).toPandas()
    shutil.rmtree(f"{tmp_path}/part.parquet")
    spark.createDataFrame(some).write.parquet(f"{tmp_path}/part.parquet")
    assert before > 3 and fixtures.frame(spark, str(tmp_path), "part_method").count() == 3


def test_small_files_and_tidying(spark, tmp_path):
    path = str(tmp_path / "x" / "mark")
    assert create_new(spark, path, "a\n") and not create_new(spark, path, "b\n") and read_small(spark, path) == "a\n" and listed(spark, str(tmp_path / "none")) == []
    outside = cut(numbers(spark, 1))
    with tidied(spark):
        cut(numbers(spark, 2))
        inside = set(listed(spark, shared_folder(spark)))
    assert outside.count() == 1 and len(inside - set(listed(spark, shared_folder(spark)))) == 1


class Counting:
    """Says how many calls were under way, itself with them."""

    def __init__(self):
        self.active = 0

    def __call__(self, texts):
        self.active += 1
        now = self.active
        time.sleep(0.03)
        self.active -= 1
        return pd.Series([f"{t} {now}" for t in texts])


def test_calls_under_way_are_bounded(spark):
    rows = spark.createDataFrame([(k, f"t{k}") for k in range(40)], "id int, text string").coalesce(1)
    said = rows.withColumn("said", business.responses(F.col("text"), Counting(), business.Calls(together=2, threads=3))).collect()
    assert all(r["said"]["answer"].split()[0] == r["text"] for r in said)
    assert 1 < max(int(r["said"]["answer"].split()[1]) for r in said) <= 3
