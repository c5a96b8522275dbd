"""Operators of the engine on small tables: orders, limits, null keys, cycles and the known odd cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors
from codeloom.operators import context, graph, incremental, intent, maintain, memory, rerank, retrieve, stats, vector
from codeloom.sources import chunkers, java, scan


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# fixed values: questions and the intents they must get
GOLDEN = [
    ("who uses UserRepository", "IMPACT_ANALYSIS"), ("impact of removing PaymentService", "IMPACT_ANALYSIS"), ("what does checkout call", "TRACE_CALL_CHAIN"), ("walk me through the payment flow", "TRACE_CALL_CHAIN"),
    ("who calls processPayment", "TRACE_CALLERS"), ("where does processPayment get called", "TRACE_CALLERS"), ("how is the connection pool set up", "FIND_CONFIGURATION"), ("which classes extend BaseRepository", "UNDERSTAND_CONTRACT"),
    ("checkout isn't working properly", "DEBUG_ERROR"), ("is userId checked for null", "NULL_SAFETY"), ("what is the discount calculation rule", "UNDERSTAND_BUSINESS_RULE"), ("how is processPayment tested", "FIND_TESTS"),
    ("show me all GET mappings", "FIND_ENDPOINTS"), ("locate the retry logic", "FIND_IMPLEMENTATION"), ("", "FIND_IMPLEMENTATION"), (None, "FIND_IMPLEMENTATION"), ("xyzzy_unknown_pattern_12345", "FIND_IMPLEMENTATION"), ("WHO CALLS processPayment", "TRACE_CALLERS"),
]


def test_intents(spark):
    got = {r.id: r for r in intent.classify(spark.createDataFrame([(i, q) for i, (q, _) in enumerate(GOLDEN)], "id int, q string"), "q").collect()}
    assert [got[i].intent for i in range(len(GOLDEN))] == [w for _, w in GOLDEN]
    low = got[16]
    assert (low.confidence, low.tier, low.routed) == (0.3, "LOW", "GENERAL_UNDERSTANDING")
    one = intent.classify(spark.createDataFrame([("callers of processPayment",), ("who calls, callers of x",), ("where is the\ntest",)], "q string"), "q").collect()
    assert [(r.confidence, r.tier) for r in one][:2] == [(0.65, "MEDIUM"), (0.8, "HIGH")]


@pytest.mark.parametrize(
    "question,chunks,first,scores",
    [
        ("generic query", [("CODE", 0.6), ("CODE", 0.1), ("CODE", 0.4)], 1, [0.4, 0.9, 0.6]),
        ("what is the timeout configured?", [("CONFIG", 0.3), ("CODE", 0.15)], 0, [0.88, 0.85]),
        ("how does payment work?", [("TEST", 0.2), ("CODE", 0.3)], 1, [0.68, 0.78]),
        ("describe the orders table schema", [("CODE", 0.2), ("SCHEMA", 0.35)], 1, [0.8, 0.85]),
        ("what is the configured timeout?", [("CONFIG", 0.0)], 0, [1.0]),
        ("anything", [("CODE", None)], 0, [0.7]),
    ],
)
def test_rerank(spark, question, chunks, first, scores):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(chunks)], "rank int, chunk_type string, distance double")
    got = rerank.rerank(df, F.lit(question), 10).collect()
    assert got[0]["rank"] == first and {r["rank"]: r.score for r in got} == pytest.approx(dict(enumerate(scores)))


def test_rerank_ties_boost_and_bag(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate(["CODE", "CONFIG", "CODE", "CONFIG", "TEST", "CODE", "CODE"])], "rank int, chunk_type string").withColumn("distance", F.lit(0.5))
    assert [r["rank"] for r in rerank.rerank(df, F.lit("test"), 3).collect()] == [0, 1, 2]
    assert [r["rank"] for r in rerank.boost_by_type(df, "CONFIG", 5).collect()] == [1, 3, 0, 2, 4]
    assert rows(rerank.config_matches(df).select("part_no", "rank")) == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (1, 2), (1, 4)]


def test_full_rerank(spark):
    df = spark.createDataFrame([(i, "CODE", i / 20) for i in range(15)], "rank int, chunk_type string, distance double")
    judge = lambda d: d.withColumn("judged", F.when(F.col("distance") == 0.5, None).otherwise(F.col("distance") * 10))
    got = rerank.full_rerank(df, F.lit("x"), judge, 8).collect()
    assert len(got) == 8 and got[0].distance == 0.55 and all(r.distance != 0.5 for r in got)
    assert "judged" not in rerank.full_rerank(df.limit(3), F.lit("x"), judge, 8).columns


def test_vector_topk(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 1.0], "a"), (3, [0.0, 1.0], "a"), (4, [1.0, 0.0], "b"), (5, None, "a"), (6, [0.0, 0.0], "a")], "vec_id int, embedding array<float>, kind string")
    assert rows(vector.topk(df, [1, 0], 3, 0.5).select("vec_id", "similarity")) == [(1, 1.0), (2, 0.707107), (4, 1.0)]
    assert [r.vec_id for r in vector.topk(df, [1, 0], 5, 0.5, F.col("kind") == "a").collect()] == [1, 2]
    assert df.limit(1).select(vectors.rendered(F.col("embedding"))).first()[0].startswith("[1.0,")


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_listed_search_finds_nine_of_ten(spark, sf):
    from codeloom.plans import registry

    got = registry.QUERIES["vec_ann_topk"](spark, f"/root/testdata/{sf}").collect()
    e = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector")).withColumn("all", F.lit(1))
    want = {(r["query"], r["vec_id"]) for r in vector.topk_in_group(e.withColumn("all", F.lit(1)), q, "all", 10).collect()}
    assert len({(r["query"], r["vec_id"]) for r in got} & want) >= 0.9 * len(want)
    assert vector.listed(e, vector.centroids(e)).count() == e.count()


def test_listed_rows_without_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [0.0, 2.0])], "vec_id int, embedding array<float>")
    c = vector.centroids(df, lists=2)
    assert rows(vector.listed(df, c).select("vec_id").filter("list_no < 0")) == [(2,)] and vector.listed(df, c, probes=2).filter("vec_id = 1").count() == 2
    none = df.limit(0)
    assert vector.listed(none, vector.centroids(none)).count() == 0


@pytest.fixture(scope="module")
def small_graph(spark):
    n = spark.createDataFrame([(x, "s") for x in "abcde"], "qn string, service string")
    e = [(1, "CALLS", "a", "b"), (2, "CALLS", "b", "c"), (3, "CALLS", "c", "a"), (4, "CALLS", "a", "a"), (5, "CALLS", "a", "b"), (6, "OTHER", "d", "b")]
    return n, spark.createDataFrame(e, "edge_id int, kind string, src string, dst string")


def test_trails_use_an_edge_once(spark, small_graph):
    _, e = small_graph
    got = graph.trails(e.filter("kind = 'CALLS'"), spark.createDataFrame([("a",)], "root string"), 5).collect()
    assert all(len(set(r.path)) == len(r.path) == r.depth for r in got)
    assert sum(r.depth == 1 for r in got) == 3
    edges = {1: "ab", 2: "bc", 3: "ca", 4: "aa", 5: "ab"}

    def walk(at, used):
        return [used] * bool(used) + [p for k, (x, y) in edges.items() if x == at and k not in used and len(used) < 5 for p in walk(y, [*used, k])]

    assert sorted(r.path for r in got) == sorted(walk("a", []))


def test_one_hop_and_deletes(small_graph):
    n, e = small_graph
    assert rows(graph.one_hop(n, e, "CALLS", F.col("m.qn").contains("b"), "qn").select("qn", "edge_id")) == [("a", 1), ("a", 5)]
    assert rows(graph.one_hop(n, e, None, F.col("m.qn") == "b", "qn", reverse=False).select("qn")) == [("c",)]
    left, rest = graph.detach_delete(n, e, n.filter("qn = 'b'"), "qn")
    assert rows(left.select("qn")) == [("a",), ("c",), ("d",), ("e",)] and rows(rest.select("edge_id")) == [(3,), (4,)]
    assert rows(graph.unreachable(n, e, "qn", F.col("qn") == "d").select("qn")) == [("e",)]
    assert rows(graph.keep_first(e, ["src"], [F.col("edge_id")]).select("edge_id")) == [(1,), (2,), (3,), (6,)]


def test_change_sets(spark):
    f = lambda *x: spark.createDataFrame(list(x), "path string, sha256 string")
    ch = incremental.change_set(f(("a", "1"), ("b", "2"), ("c", "3")), f(("b", "2"), ("c", "0"), ("d", "4")))
    assert rows(ch) == [("a", "ADDED"), ("b", "UNCHANGED"), ("c", "MODIFIED"), ("d", "DELETED")]
    assert rows(incremental.change_counts(ch)) == [(1, 1, 1, 1, 3)]
    table = spark.createDataFrame([("b", 1), ("c", 2), ("d", 3)], "file_path string, v int")
    fresh = spark.createDataFrame([("a", 10), ("c", 20)], "file_path string, v int")
    assert rows(incremental.apply_changes(table, fresh, ch)) == [("a", 10), ("b", 1), ("c", 20)]


def test_upserts_and_scopes(spark):
    old = spark.createDataFrame([("a", "x", 1), (None, "y", 2)], "service_name string, status string, ingested_at int")
    new = spark.createDataFrame([("a", None, 9), ("b", "z", 3)], old.schema)
    assert rows(maintain.register(old, new)) == [("a", None, 1), ("b", "z", 3), (None, "y", 2)]
    assert rows(maintain.delete_scope(old, "service_name", "a")) == [(None, "y", 2)]
    assert rows(maintain.set_status(old, "a", "DELETING").select("status")) == [("DELETING",), ("y",)]
    docs = spark.createDataFrame([(1, '{"f":"a"}'), (2, '{"f":"b"}'), (3, "{}"), (4, None)], "id int, m string")
    assert rows(maintain.delete_json_scope(docs, "m", "f", "a").select("id")) == [(2,), (3,), (4,)]


def test_overwrite_of_touched_partitions_only(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    maintain.overwrite_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "service string, v int"), path, ["service"])
    maintain.overwrite_partitions(spark.createDataFrame([("a", 5)], "service string, v int"), path, ["service"])
    assert rows(spark.read.parquet(path).select("service", "v")) == [("a", 5), ("b", 2)]


def test_memory(spark):
    c = spark.createDataFrame([(1, k, f"t{min(k, 6)}") for k in range(8)] + [(2, 0, "x")], "conv_id int, turn int, text string")
    assert rows(memory.last_turns(c, 2).select("conv_id", "turn")) == [(1, 6), (1, 7), (2, 0)]
    assert rows(memory.turn_index(c).filter("conv_id = 1").select("turn", "turn_index"))[5:] == [(5, 5), (6, 5), (7, 5)]
    recalled = spark.createDataFrame([(1, 0, "t0"), (1, 6, "t6")], c.schema)
    assert rows(memory.merged_memory(recalled, c.filter("conv_id = 1")).select("part_no", "turn")) == [(0, 0), (1, 6), (1, 7)]
    h = spark.createDataFrame([(None,), (["a"],), (list("abcde"),)], "h array<string>")
    assert [r[0] for r in h.select(memory.appended(F.col("h"), F.lit("z"))).collect()] == [["z"], ["a", "z"], ["b", "c", "d", "e", "z"]]
    t = lambda m: datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=m)
    e = spark.createDataFrame([(1, k, t(m)) for k, m in enumerate([0, 30, 61, 62])], "user_id int, event_id int, ts timestamp")
    assert [r.session_no for r in memory.sessions(e).orderBy("event_id").collect()] == [1, 1, 2, 2]
    assert [r[0] for r in spark.createDataFrame([("x" * 500,), (None,)], "a string").select(F.length(memory.summary(F.col("a")))).collect()] == [400, 0]


def test_budget_in_parts_equals_one_pass(spark):
    import random

    rng = random.Random(2)
    df = spark.createDataFrame([(k % 3, k, rng.choice([0, 1, 50, 900])) for k in range(600)], "g int, k int, n int")
    for most in (0, 100, 7000):
        want = []
        for g in range(3):
            before = 0
            for i, (_, k, n) in enumerate(sorted((tuple(r) for r in df.filter(f"g = {g}").collect()), key=lambda r: r[1])):
                if before <= most:
                    want.append((g, k, i + 1, before))
                before += n
        assert rows(context.within_budget(df, ["g"], [F.col("k")], F.col("n"), most).select("g", "k", "ordinal", "before")) == sorted(want, key=str)


def test_embedding_of_a_column_equals_that_of_a_text(spark):
    from codeloom.functions import embed

    texts = ["a b a", "", None, "Straße 12, b-c", "b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(embed.embedded(F.col("t"))).collect()]
    assert got[2] is None and all(g == pytest.approx(embed.vector(t), abs=1e-6) for g, t in zip(got, texts) if t is not None)


def test_another_format(spark):
    mine = scan.Format("ini", 7, lambda p, c: p.endswith(".yml") & c.startswith("["), lambda f: f.select("path", F.lit("x").alias("element_name"), "content", F.lit("INI").alias("chunk_type")))
    files = spark.createDataFrame([("/a.yml", "[s]"), ("/b.yml", "k: v\n"), ("/c.yml", "openapi: [")], "path string, content string")
    got = rows(scan.chunks(files, "s", [*scan.FORMATS, mine]).select("path", "chunk_type"))
    assert got == [("/a.yml", "INI"), ("/b.yml", "CONFIG")]


def test_yaml_without_a_library(spark, monkeypatch):
    f = spark.createDataFrame([("/a.yml", "# c\nserver:\n  port: 80\nspring: app\n")], "path string, content string")
    whole = rows(chunkers.yaml_keys(f).select("element_name", "content"))
    monkeypatch.setattr(chunkers, "yaml", None)
    assert rows(chunkers.yaml_keys(f).select("element_name")) == [(k,) for k, _ in whole] == [("server",), ("spring",)]
    assert whole == [("server", "server:\n  port: 80\n"), ("spring", "spring:\napp\n")]


def test_sections_without_shuffling(spark):
    f = spark.createDataFrame([("/a.md", "## A\nx\n## B\n"), ("/b.md", ""), ("/c.md", None), ("/d.md", "only\ntext")], "path string, content string")
    assert rows(chunkers.markdown(f).select("path", "element_name", "start_line", "end_line")) == [("/a.md", "A", 1, 2), ("/d.md", "Introduction", 1, 2)]
    assert "Exchange" not in chunkers.markdown(f)._jdf.queryExecution().executedPlan().toString()


def test_context(spark):
    none = lambda s: spark.createDataFrame([], s)
    method = "rank int, class_name string, simple_name string, is_endpoint boolean, http_method string, endpoint_path string"
    chunks = spark.createDataFrame([(1, "C", "m", "CODE", "body"), (2, None, None, "CONFIG", "k: v")], "rank int, class_name string, element_name string, chunk_type string, content string")
    chain = spark.createDataFrame([(1, "C", "a", True, "GET", "/x"), (2, "D", "b", False, None, None)], method)
    args = [none("rank int, query string, answer string"), chunks, chain, none(method), none("rank int, simple_name string, node_type string"), none(method)]
    got = context.assemble(*args).first()["context"]
    assert got == "=== RELEVANT CODE CHUNKS ===\n\n--- Chunk 1 [C.m / CODE] ---\nbody\n\n--- Chunk 2 [CONFIG] ---\nk: v\n\n=== CALL CHAIN ===\n1. C.a [GET /x]\n2. D.b"
    args[1] = chunks.withColumn("content", F.repeat(F.lit("x"), 40000))
    long = context.assemble(*args).first()["context"]
    assert long.endswith(context.MARK) and len(long) == context.MAX_CHARS + len(context.MARK) and "CALL CHAIN" not in long
    whole = context.assemble(*args, most=None).first()["context"]
    assert whole == got.replace("body", "x" * 40000).replace("k: v", "x" * 40000)


def test_null_fill(spark):
    hits = spark.createDataFrame([(i, "null" if i in (3, 5) else "x") for i in range(1, 16)], "rank int, content string")
    assert [r["rank"] for r in retrieve.null_fill(hits).collect()] == [3, 5, 1, 2, 4, 6, 7, 8]
    many = hits.withColumn("content", F.when(F.col("rank") > 9, "Optional").otherwise("x"))
    assert [r["rank"] for r in retrieve.null_fill(many).collect()] == [10, 11, 12, 13, 14, 15]


def test_handlers(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], "s", "CODE", "Pay", "run", "code"), (2, [0.9, 0.1], "s", "TEST", "T", "t", "test"), (3, [1.0, 0.0], "other", "CODE", "X", "y", "z"), (4, [0.0, 1.0], "s", "CODE", "Far", "f", "far")], "vec_id int, embedding array<float>, service_name string, chunk_type string, class_name string, element_name string, content string")
    methods = spark.createDataFrame([("s.Pay.run()", "s", True), ("s.Top.go()", "s", False), ("s.Low.end()", "s", False)], "qualified_name string, service_name string, is_endpoint boolean")
    classes = spark.createDataFrame([("p.Pay", "s"), ("p.User", "s"), ("q.Else", "other")], "qualified_name string, service_name string")
    edges = spark.createDataFrame([(1, "CALLS", "s.Top.go()", "s.Pay.run()"), (2, "CALLS", "s.Pay.run()", "s.Low.end()"), (3, "DEPENDS_ON", "p.User", "p.Pay"), (4, "DEPENDS_ON", "q.Else", "p.Pay"), (5, "IMPLEMENTS", "q.Else", "p.Pay"), (6, "INHERITS", "p.User", "p.Pay")], "edge_id int, kind string, src string, dst string")
    s, q = retrieve.Store(chunks, methods, classes, edges), [1.0, 0.0]
    ask = lambda question: retrieve.answer(s, question, lambda _: q, "s")
    assert [r.vec_id for r in ask("which class is it, where is it")[1]["chunks"].collect()] == [1]
    assert rows(ask("who calls run and callers of it")[1]["callers"].select("qualified_name")) == [("s.Top.go()",)]
    assert rows(ask("call chain and execution flow")[1]["call_chain"].select("qualified_name")) == [("s.Low.end()",)]
    assert rows(ask("impact of this, what breaks")[1]["impacted"].select("qualified_name")) == [("p.User",)]
    assert [r.qualified_name for r in ask("what interface implements it")[1]["contract"].collect()] == ["q.Else", "p.User"]
    assert rows(ask("unit test coverage")[1]["chunks"].select("vec_id")) == [(2,)]
    assert rows(ask("endpoint routes")[1]["endpoints"].select("qualified_name")) == [("s.Pay.run()",)]
    assert ask("hm")[0] == "GENERAL_UNDERSTANDING"
    debug = ask("stacktrace of an exception")[1]
    assert rows(debug["callers"].select("qualified_name")) == [("s.Top.go()",)] and debug["call_chain"].count() == 2
    for name, handler in retrieve.HANDLERS.items():
        assert all(df.count() >= 0 for df in handler(s, "any", q, "s").values()), name


FILES = [
    ("/r/README.md", "intro\n\n## One\nbody\n## Two\n\n## Three\nx\ny"), ("/r/order-context.md", "## A\nb"), ("/r/application.yml", "# c\nserver:\n  port: 80\nspring: app\n"),
    ("/r/api.json", '{"openapi":"3","paths":{"/o":{"post":{"summary":"s"},"get":{}},"/o/{id}":{"get":{"description":"d"},"patch":{"summary":"no"}}}}'), ("/r/s.sql", "CREATE TABLE a (x int);\nCREATE INDEX i ON a(x);"), ("/r/x.txt", "n"),
]


def test_operations_of_yaml_descriptions(spark):
    text = "openapi: 3.0.0\npaths:\n  /o:\n    parameters: []\n    post: &p\n      summary: yes\n      description: |\n        a\n        b\n      responses: {200: {description: ok}}\n    get: {}\n    patch: {summary: n}\n  '/o/{id}':\n    get: {operationId: getO, summary: null}\n    put: *p\n"
    files = [("/r/openapi.yaml", text), ("/r/bad.yml", "swagger: [\n"), ("/r/none.yml", "swagger: 2\n"), *FILES]
    got = {(r.path, r.element_name): r.content for r in scan.chunks(spark.createDataFrame(files, "path string, content string"), "svc").filter("chunk_type = 'API_SPEC'").collect()}
    post = "Summary: yes\nDescription: a\nb\n\n"
    assert {k[1]: v for k, v in got.items() if k[0] == "/r/openapi.yaml"} == {"POST /o": "POST /o\n" + post, "PUT /o/{id}": "PUT /o/{id}\n" + post, "GET /o/{id}": "GET /o/{id}\nOperationId: getO\n"}
    assert {k for k in got if k[0] != "/r/openapi.yaml"} == {("/r/api.json", "GET /o/{id}"), ("/r/api.json", "POST /o")}


def test_chunks_of_files(spark):
    got = rows(scan.chunks(spark.createDataFrame(FILES, "path string, content string"), "svc").select("path", "element_name", "chunk_type"))
    want = [("README.md", "Introduction", "DOCUMENTATION"), ("README.md", "One", "DOCUMENTATION"), ("README.md", "Three", "DOCUMENTATION"), ("api.json", "GET /o/{id}", "API_SPEC"), ("api.json", "POST /o", "API_SPEC"), ("application.yml", "server", "CONFIG"), ("application.yml", "spring", "CONFIG"), ("order-context.md", "A", "BUSINESS_CONTEXT"), ("s.sql", "a", "SCHEMA"), ("s.sql", "i", "SCHEMA")]
    assert got == sorted(("/r/" + p, e, k) for p, e, k in want)
    md = {r.element_name: r for r in chunkers.markdown(spark.createDataFrame(FILES[:1], "path string, content string")).collect()}
    assert (md["One"].content, md["One"].start_line, md["One"].end_line) == ("## One\nbody", 3, 4)


def test_repository_scan(spark, tmp_path):
    for name, content in (("a/x.md", "## A\nb"), ("target/y.md", "## no\nb"), ("b/node_modules/z.sql", "SELECT 1;"), ("b/Z.java", "class Z {}")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    files = scan.repository(spark, f"file://{tmp_path}")
    assert sorted(r.path.rsplit("/", 1)[-1] for r in files.collect()) == ["Z.java", "x.md"]
    assert java.table(java.facts(files.filter("path LIKE '%.java'"), "s"), "class").first().qualified_name == "Z"


def test_java_facts(spark):
    source = """package p; import q.Other;
    /** About. */ @RestController @RequestMapping("/base") public class A extends q.Base<String> implements I {
      Other o; java.util.List<String> names = new ArrayList<>();
      /** Does it. @param x none
       * @param x the number
       * @throws E if bad */
      @GetMapping(path = "/{id}", produces = "j") @Scheduled(cron = "0") List<Map<String, Integer>> get(final int x, String... more) throws E {
        if (x > 1 && !done(x)) { return o.find(x); } else if (x == 0) { throw new E("bad"); }
        int[] a = {1, 2}; a[0] = x + o.size; o.name = (String) more;
        for (int i = 0; i < x; i++) { if (i == 2) continue; run(() -> hidden(i)); }
        do { x2(); } while (false);
        return null;
      }
      class Inner { void z() { } }
    }"""
    f = java.facts(spark.createDataFrame([("/s/A.java", source), ("/s/B.java", "class {"), ("/s/ATest.java", "class ATest { void t() { if (a) { b(); } } }")], "path string, content string"), "svc").cache()
    m = {r.simple_name: r for r in java.table(f, "method").collect()}
    g = m["get"]
    assert (g.qualified_name, g.http_method, g.endpoint_path, g.is_scheduled, g.cyclomatic_complexity) == ("p.A.get(int,String)", "GET", "/base/{id}", True, 5)
    assert m["t"].is_test_method and m["t"].cyclomatic_complexity == 0 and m["z"].class_name == "Inner"
    assert {r.path for r in f.filter("tag = 'unread'").collect()} == {"/s/B.java"}
    e = {(r.kind, r.dst) for r in java.table(f, "edge").collect()}
    assert {("INHERITS", "q.Base"), ("IMPLEMENTS", "p.I"), ("DEPENDS_ON", "q.Other"), ("CALLS", "p.o.find(?)"), ("CALLS", "p.A.done(?)"), ("CALLS", "p.A.run(?)"), ("CALLS", "p.A.hidden(?)")} <= e
    d = {(r["var"], r.def_type) for r in java.table(f, "def").collect()}
    assert {("x", "PARAMETER"), ("a", "LOCAL_DECL"), ("a", "ASSIGNMENT"), ("o.name", "ASSIGNMENT")} <= d
    u = {(r["var"], r.use_type) for r in java.table(f, "use").collect()}
    assert {("x", "CONDITION"), ("x", "METHOD_ARG"), ("o", "RETURN_VALUE"), ("o.size", "ASSIGNMENT_RHS"), ("more", "ASSIGNMENT_RHS")} <= u and not any(v == "hidden" for v, _ in u)
    docs = java.table(f, "chunk").filter("chunk_type = 'DOCUMENTATION'").first()
    assert "@throws E: if bad" in docs.content and docs.extra["has_throws_doc"] == "true"
    nodes, edges = java.table(f, "cfg_node"), java.table(f, "cfg_edge")
    assert nodes.filter("node_type = 'EXIT'").count() == edges.groupBy("method_qn").agg(F.max("dst")).count()
    assert java.flow_summary(java.table(f, "def"), java.table(f, "use")).filter("var = 'x'").count() == 1
    assert java.null_checked_before_use(java.table(f, "use")).filter("var = 'x'").count() > 0
    linked = java.linked_calls(java.table(f, "method"), java.table(f, "edge"))
    assert linked.count() == 0


def method_of(body):
    from codeloom.sources import java_syntax as J
    from codeloom.sources.java_flow import ControlFlow

    return ControlFlow(J.parse(f"class A {{ void m() {{ {body} }} }}").types[0].members[0])


def ways(flow):
    return [(flow.nodes[e["src"]]["code"], flow.nodes[e["dst"]]["code"], e["edge_type"], e["condition_text"], e["exception_type"]) for e in flow.edges if e["src"] and flow.nodes[e["dst"]]["node_type"] != "EXIT"]


def test_odd_cases_of_control_flow():
    plain = "UNCONDITIONAL"
    assert ways(method_of("if (a) { }")) == [("if (a)", "merge", plain, None, None), ("if (a)", "merge", "FALSE", "!(a)", None)]
    assert ways(method_of("if (a) { x = 1; } else { }")) == [("if (a)", "x = 1;", "FALSE", "!(a)", None), ("x = 1;", "merge", plain, None, None), ("if (a)", "merge", plain, None, None)]
    assert ways(method_of("while (a) { }")) == [("while (a)", "while (a)", "LOOP_BACK", None, None), ("while (a)", "after_while", "FALSE", "!(a)", None)]
    got = ways(method_of("if (a) { x = 1; } else { try { y = 2; } catch (E e) { z = 3; } }"))
    assert ("if (a)", "y = 2;", plain, None, None) in got and ("if (a)", "catch (E e)", "FALSE", "!(a)", "E") in got
    flow = method_of("return; x = 1;")
    assert [(e["src"], e["dst"]) for e in flow.edges] == [(0, 1), (1, 3), (3, 2), (2, 3)]
    got = ways(method_of("for (;;) { f(); } switch (k) { case 1, 2: g(); case 3: default: return; }"))
    assert ("for (true)", "after_for", "FALSE", "!(true)", None) in got and ("switch (k)", "case 1", "FALL_THROUGH", "k == 1", None) in got
    assert ("case 3", "switch_merge", plain, None, None) in got and not any(a == "return void" for a, *_ in got)


def test_no_java_text_ends_the_scan(spark):
    import random

    from codeloom.plans.java_queries import SOURCE
    from codeloom.sources import java_syntax as J

    rng, words = random.Random(4), [x.text for x in J.Reader(SOURCE).all]
    cut = [SOURCE[:k] for k in range(0, len(SOURCE), 3)] + [" ".join(rng.sample(words, 40)) for _ in range(60)] + [" ".join(words[:k] + words[k + 1 :]) for k in range(len(words))]
    for t in cut:
        try:
            java.FileFacts("/a/B.java", t, "s")
        except (J.SyntaxProblem, RecursionError):
            pass
    files = spark.createDataFrame([("/a/Good.java", "class Good { void f() { g(); } }"), ("/a/Bad.java", "class PayService extends"), ("/a/Deep.java", "class D { int x() { return " + "(" * 5000 + "1" + ")" * 5000 + "; } }"), ("/a/Null.java", None)], "path string, content string")
    f = java.facts(files, "s").cache()
    assert rows(java.table(f, "class").select("qualified_name").filter("qualified_name = 'Good'")) == [("Good",)]
    assert "/a/Bad.java" in {r.path for r in f.filter("tag = 'unread'").collect()} and java.table(f, "unread").first().reason


def test_statistics(spark):
    c = spark.createDataFrame([("s",), ("s",), ("t",)], "service_name string")
    m = spark.createDataFrame([("s", True, 10), ("s", False, 9), ("u", None, None)], "service_name string, is_endpoint boolean, cyclomatic_complexity int")
    assert rows(stats.service_stats(c, m)) == [("s", 2, 2, 1, 1), ("t", 1, 0, 0, 0), ("u", 0, 1, 0, 0)]
    assert [r[0] for r in spark.createDataFrame([("6/10",), ("10",), ("none",), (None,)], "a string").select(T.parsed_score(F.col("a"))).collect()] == [6.0, 10.0, 5.0, 5.0]


def test_lookups(spark):
    from codeloom.operators import lookup

    m = spark.createDataFrame([("s.A.f()", "A", "s", True, 12), ("s.B.g()", "B", "s", False, 3), ("t.C.h()", "C", "t", True, 10)], "qualified_name string, class_name string, service_name string, is_endpoint boolean, cyclomatic_complexity int")
    e = spark.createDataFrame([(1, "CALLS", "s.A.f()", "s.B.g()"), (2, "CALLS", "s.B.g()", "t.C.h()"), (3, "CALLS", "t.C.h()", "s.A.f()"), (4, "INHERITS", "X", "Y"), (5, "INHERITS", "Y", "Z"), (6, "DEPENDS_ON", "X", "Y")], "edge_id int, kind string, src string, dst string")
    c = spark.createDataFrame([("X", "s", "CONTROLLER"), ("Y", "s", "REST_CONTROLLER"), ("Z", "t", None)], "qualified_name string, service_name string, spring_stereotype string")
    assert rows(lookup.flagged(m, "s", "is_endpoint").select("qualified_name")) == [("s.A.f()",)]
    assert [r.qualified_name for r in lookup.complex_methods(m, "s", 3).collect()] == ["s.A.f()", "s.B.g()"]
    assert rows(lookup.callers(m, e, "B.g").select("qualified_name")) == [("s.A.f()",)]
    assert [(r.depth, r.node) for r in lookup.call_chain(m, e, "A.f", "s").collect()] == [(1, "s.B.g()"), (3, "s.A.f()")]
    assert rows(lookup.ancestors(e, "X")) == [("Y", 1), ("Z", 2)] and rows(lookup.transitive_dependencies(e, "X")) == [("Y", 1)]
    assert rows(lookup.subclasses(c, e, "Y").select("qualified_name")) == [("X",)] and lookup.overriding(m, e, "f").count() == 0
    assert lookup.controllers(c, "s").count() == lookup.beans(c, "s").count() == 2 and lookup.by_key(c, "qualified_name", "Z").count() == 1
    assert rows(lookup.dependents(c, e, "Y", "s").select("qualified_name")) == [("X",)] and lookup.of_class(m, "C", "t").count() == 1


def test_flow_questions(spark):
    from codeloom.operators import flow

    source = "class A { int f(int x) { if (x > 0) { while (x > 1) { x--; } send(x); } else { throw new E(x); } return x; } }"
    f = java.facts(spark.createDataFrame([("/A.java", source)], "path string, content string"), "s").cache()
    raw = java.table(f, "cfg_edge").unionByName(java.table(f, "cfg_edge").limit(1).withColumn("dst", F.lit(99)))
    nodes, edges = flow.flow_tables(java.table(f, "cfg_node"), raw)
    assert edges.count() == java.table(f, "cfg_edge").count() and nodes.select("node_id").distinct().count() == nodes.count()
    assert rows(flow.conditions_before(nodes, edges, F.col("called_method") == "send").select("condition_text")) == [("!(x > 1)",), ("x > 0",)]
    assert rows(flow.escaping(nodes, edges)) == [("A.f(int)", "new E(x)")]
    assert rows(flow.longest_path(nodes, edges)) == [("A.f(int)", 7)]
    d, u = java.table(f, "def"), java.table(f, "use")
    assert flow.tainted(d, u, F.col("use_type") == "METHOD_ARG").count() == 1 and flow.origins(d, u).count() > 0
    p = spark.createDataFrame([("q", "x" * 500, None, "/a/b.java")], "q string, c string, k string, p string").select(rerank.score_prompt(F.col("q"), F.col("c"), F.col("k"), F.col("p"))).first()[0]
    assert "File: b.java" in p and "x" * 400 + "..." in p
