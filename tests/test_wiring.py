"""Descriptors, annotation handlers, and injection points with their beans, rule by rule."""

import pytest
from pyspark.sql import functions as F

from codeweft.functions import descriptors
from codeweft.plans import handlers, wiring


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(
    ("text", "arguments", "returns"),
    [
        ("()V", [], "void"),
        ("(I[J[[Ljava/util/Map$Entry;ZLa/B;)[La/C;", ["int", "long[]", "java.util.Map$Entry[][]", "boolean", "a.B"], "a.C[]"),
        ("(LI;LV;[[D)I", ["I", "V", "double[][]"], "int"),
        ("no descriptor", [], None),
        (None, None, None),
    ],
)
def test_descriptors(spark, text, arguments, returns):
    value = F.lit(text).cast("string")
    assert one(spark, descriptors.argument_types(value)) == arguments and one(spark, descriptors.return_type(value)) == returns
    if arguments is not None:
        assert one(spark, descriptors.signature(value)) == f"({', '.join(arguments)})"


def test_names_and_flags(spark):
    assert one(spark, descriptors.modifiers(F.lit(0x1 | 0x8 | 0x10 | 0x400))) == ["public", "static", "final", "abstract"]
    assert one(spark, descriptors.modifiers(F.lit(0x20))) == [] and one(spark, descriptors.modifiers(F.lit(None).cast("int"))) == []
    plain = {x: one(spark, descriptors.is_plain(F.lit(x).cast("string"))) for x in ("int", "java.lang.String", "java.lang.Long", "void", "int[]", "a.B", None)}
    assert plain == {"int": True, "java.lang.String": True, "java.lang.Long": True, "void": False, "int[]": False, "a.B": False, None: True}
    assert one(spark, descriptors.dotted(F.lit("a/B$C"))) == "a.B$C" and one(spark, descriptors.internal(F.lit("a.B$C"))) == "a/B$C"
    assert one(spark, descriptors.package_name(F.lit("a.b.C"))) == "a.b" and one(spark, descriptors.package_name(F.lit("C"))) == ""
    proxies = {(n, f, i): one(spark, descriptors.proxy_type(*map(F.lit, (n, f, i)))) for n in (True, False) for f in (True, False) for i in (True, False)}
    assert proxies == {(n, f, i): ("cglib" if f or not i else "jdk_or_cglib") if n else None for n, f, i in proxies}


def test_every_handler_takes_its_markers(spark):
    assert len(handlers.HANDLERS) == 32
    rows = []
    for h in handlers.HANDLERS:
        for marker in h.markers:
            full = marker + "Any" if marker.endswith(".") else marker
            rows += [(f"{h.name}/{full}", h.scope, a) for a in (f"@{full}", f'@{full}(value = "x")', f"L{full.replace('.', '/')};")]
    got = handlers.handled(spark.createDataFrame(rows, "owner string, scope string, annotation string")).collect()
    assert len(got) == len(rows)
    for r in got:
        wanted = r["owner"].split("/")[0]
        if wanted == "Pointcut":  # another handler takes it first
            wanted = "Aop"
        elif r["owner"].startswith("MyBatisPlus/") or r["owner"].startswith("MyBatis/"):
            assert r["handler"] in ("MyBatis", "MyBatisPlus") and r["priority"] in (72, 75)
            continue
        assert r["handler"] == wanted


def test_annotations_without_a_handler(spark):
    rows = [("a", "class", "@Override"), ("a", "class", None), ("a", "method", "@Service"), ("a", "nowhere", "@Service"), ("a", "class", "@my.own.Service"), ("a", "class", "@Service"), ("a", "class", "@Mapper")]
    got = handlers.handled(spark.createDataFrame(rows, "owner string, scope string, annotation string")).collect()
    assert sorted((r["annotation"], r["handler"]) for r in got) == [("@Mapper", "MyBatisMapper"), ("@Service", "SpringBean")]


def test_notes_of_one_owner(spark):
    rows = [
        ("m", "method", '@PostMapping("/a")'), ("m", "method", '@Bean("b")'), ("m", "method", "@Async"),
        ("c", "class", "@org.mapstruct.Mapper"), ("c", "class", "@org.apache.ibatis.annotations.Mapper"), ("c", "class", "@Lazy"),
        ("n", "class", "@com.baomidou.mybatisplus.annotation.TableName"), ("f", "field", '@Value("${a.b:1}")'),
    ]
    got = {r["owner"]: r for r in handlers.noted(spark.createDataFrame(rows, "owner string, scope string, annotation string")).collect()}
    assert got["m"]["attributes"] == {"isRestEndpoint": "true", "httpMethod": "POST", "apiPath": "/a", "isEntryPoint": "true", "entryPointType": "rest_endpoint", "isBean": "true", "beanName": "b", "isAsync": "true"}
    assert got["c"]["attributes"] == {"mapStructMapper": "true", "lazy": "true"} and not got["c"]["needs_proxy"]
    assert got["n"]["attributes"] == {} and got["f"]["attributes"] == {"configKey": "a.b"}


def test_words_of_annotations(spark):
    methods = {a: one(spark, handlers.http_method(F.lit(a))) for a in ("@GetMapping", "@org.x.PatchMapping(\"/\")", "@RequestMapping", "@Mapping", "@Get")}
    assert list(methods.values()) == ["GET", "PATCH", "ALL", "", ""]
    operations = {a: one(spark, handlers.mapper_operation(F.lit(a))) for a in ("@Select", "@InsertProvider", "@Options", "@Results", "@com.baomidou.mybatisplus.annotation.TableName", "@SqlProvider")}
    assert list(operations.values()) == ["select", "insert", "other", "results", "mybatis_plus", "provider"]
    calls = {a: one(spark, handlers.base_mapper_operation(F.lit(a))) for a in ("a.UserMapper.insert(x.Y)", "a.UserMapper.insertAll()", "a.UserMapper.updateById()", "a.UserMapper.deleteBatchIds()", "a.UserDao.selectById()")}
    assert list(calls.values()) == ["INSERT", None, "UPDATE", "DELETE", None]


CLASS = (
    "fqn string, annotations array<string>, inheritance array<struct<fqn:string,kind:string>>, "
    "fields array<struct<name:string,type:string,annotations:array<string>>>, methods array<struct<fqn:string,signature:string,annotations:array<string>,attributes:map<string,string>>>"
)


def classes(spark):
    rows = [
        ("a.Base", [], [("a.Api", "implements")], [], []),
        ("a.One", ["@Service"], [("a.Base", "extends")], [], []),
        ("a.Two", ['@Component("zwei")', "@Primary"], [("a.Base", "extends"), ("a.Other", "implements")], [], []),
        ("a.Three", ["@Service", '@Qualifier("q3")'], [("a.Other", "implements")], [], []),
        ("a.Plain", [], [("a.Other", "implements")], [], []),
        ("a.Loop", None, [("a.Knot", "extends")], None, None), ("a.Knot", None, [("a.Loop", "extends")], None, None),
        ("a.Config", ["@Configuration"], None, [], [("a.Config.clock(int)", "(Ia/b;)Ljava/time/Clock;", ["@Bean"], None), ("a.Config.made()", "()La/Made;", ['@Bean("made1")', "@Primary"], {}), ("a.Config.other()", "()La/Made;", ["@Bean", "@Primary"], {})]),
        ("a.User", [], None, [
            ("api", "a.Api", ["@Autowired"]), ("other", "a.Other", ["@Inject", "@Resource"]), ("three", "La/Other;", ["@Autowired", '@Qualifier("q3")']), ("x", "a.Other", ["@Autowired", '@Qualifier("none")']),
            ("clock", "java.time.Clock", ["@Autowired"]), ("made", "a.Made", ["@Autowired"]), ("gone", "a.Gone", ["@Autowired"]), ("idle", "a.One", []), ("n", "int", []), ("s", "java.lang.String", ["@Value"]), ("loop", "a.Loop", ["@Autowired"]),
        ], [
            ("a.User.<init>(a.One, a.Other)", "(La/One;La/Other;)V", ["@Autowired"], {"qualifier.1": "zwei"}),
            ("a.User.setIt(a.Api)", "(La/Api;)V", ["@Autowired", '@Qualifier("one")'], None),
            ("a.User.plain(a.One[])", "([La/One;)La/One;", None, None),
        ]),
    ]
    return spark.createDataFrame(rows, CLASS)


def test_beans_and_supertypes(spark):
    found = {r["bean"]: (r["type"], r["name"], r["qualifier"], r["is_primary"]) for r in wiring.beans_of(classes(spark)).collect()}
    assert found["a.Two"] == ("a.Two", "zwei", None, True) and found["a.Three"] == ("a.Three", "three", "q3", False)
    assert found["a.Config.made()"] == ("a.Made", "made1", None, True) and found["a.Config.clock(int)"][:2] == ("java.time.Clock", "clock") and "a.Plain" not in found
    above = {(r["type"], r["super"]) for r in wiring.supertypes(classes(spark)).collect()}
    assert {s for t, s in above if t == "a.Two"} == {"a.Base", "a.Api", "a.Other"} and ("a.Loop", "a.Knot") in above and ("a.Loop", "a.Loop") not in above


def test_each_rule_of_resolution(spark):
    rows = wiring.wired(wiring.points_of(classes(spark)), wiring.beans_of(classes(spark)), wiring.supertypes(classes(spark))).collect()
    got = {r["member"]: (r["kind"], r["n_candidates"], r["how"], r["bean"]) for r in rows}
    assert got["api"] == ("field:autowired", 2, "primary", "a.Two")
    assert got["other"] == ("field:resource", 2, "primary", "a.Two")
    assert got["three"] == ("field:autowired", 2, "qualifier", "a.Three")
    assert got["x"][2:] == ("missing", None) and got["gone"][1:] == (0, "missing", None) and got["loop"][2] == "missing"
    assert got["clock"][1:] == (1, "type", "a.Config.clock(int)")
    assert got["made"][1:] == (2, "ambiguous", None)  # two primary beans
    assert got["<init>#0"] == ("constructor:autowired", 1, "type", "a.One") and got["<init>#1"][2:] == ("qualifier", "a.Two")
    assert got["setIt#0"] == ("setter:autowired", 2, "qualifier", "a.One") and "idle" not in got
    assert len(rows) == len(got) == 9 + 3 + 1 - 1


def test_a_field_named_like_a_bean(spark):
    beans = spark.createDataFrame([("x.A", "x.A", "a", None, False), ("x.B", "x.B", "b", None, False), ("x.B", "x.B", "b", None, False)], "bean string, type string, name string, qualifier string, is_primary boolean")
    above = spark.createDataFrame([("x.A", "x.I"), ("x.B", "x.I")], "type string, super string")
    points = spark.createDataFrame([("u", "b", "field:inject", "x.I", None), ("u", "c", "field:inject", "x.I", None), (None, None, None, None, None)], "class_fqn string, member string, kind string, type string, qualifier string")
    got = {r["member"]: (r["n_candidates"], r["how"], r["bean"]) for r in wiring.wired(points, beans, above).collect()}
    assert got == {"b": (2, "name", "x.B"), "c": (2, "ambiguous", None), None: (0, "missing", None)}
    assert wiring.wired(points.limit(0), beans, above).isEmpty()


def test_edges_of_members(spark):
    fields = {(r["from_fqn"], r["kind"], r["qualifier"]) for r in wiring.field_edges(wiring.fields_of(classes(spark))).collect()}
    assert ("a.Api", "class:autowired", None) in fields and ("a.One", "class", None) in fields and ("a.Other", "class:autowired", "q3") in fields and ("a.Other", "class:resource", None) in fields
    assert not {x for x, *_ in fields} & {"int", "java.lang.String"}
    methods = wiring.methods_of(classes(spark))
    members = {(r["from_fqn"], r["to_fqn"], r["kind"], r["place"]) for r in wiring.member_edges(methods).collect()}
    assert ("a.One", "a.User.plain(a.One[])", "return", None) in members and ("a.One[]", "a.User.plain(a.One[])", "argument", 0) in members
    assert ("java.time.Clock", "a.Config.clock(int)", "return", None) in members and not [m for m in members if m[0] in ("int", "void")]
    injected = {(r["from_fqn"], r["kind"], r["qualifier"]) for r in wiring.injection_edges(methods).collect()}
    assert injected == {("a.One", "constructor:autowired", None), ("a.Other", "constructor:autowired", "zwei"), ("a.Api", "setter:autowired", "one"), ("int", "bean_dependency", None)}


def test_quartz(spark):
    schema = "fqn string, inheritance array<struct<fqn:string,kind:string>>, methods array<struct<fqn:string,signature:string>>"
    job, bean, run = "org.quartz.Job", "org.springframework.scheduling.quartz.QuartzJobBean", "(Lorg/quartz/JobExecutionContext;)V"
    rows = [("a", [(job, "implements")], [("a.execute(x)", run), ("a.execute()", "()V"), ("a.executeInternal(x)", run)]), ("b", [(bean, "extends")], [("b.executeInternal(x)", run), ("b.execute(x)", run)]), ("c", None, [("c.execute(x)", run)])]
    got = {(r["symbol_fqn"], r["entry_type"]) for r in handlers.quartz_entries(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a.execute(x)", "quartz_job"), ("b.executeInternal(x)", "quartz_job_spring")}
