"""The queries over the driver's tables and their SQL.

The tables are no source code, so each operator is shown by its relational shape: embeddings with their label as chunk type and
service, part-to-part edges between consecutive line items of an order, conversations as sessions, documents as files. Every
limit stands behind a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.functions import vectors
from codeloom.operators import context, graph, incremental, intent, lookup, maintain, memory, rerank, retrieve, stats, vector
from codeloom.sources import chunkers, java

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of (spark, tables) under its name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = lambda spark, sf_dir, f=f: f(spark, lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql is not None:
            ORACLES[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- vectors and scores

KINDS = ["CODE", "CONFIG", "SCHEMA", "API_SPEC", "BUSINESS_CONTEXT", "DOCUMENTATION", "TEST"]
QUESTION = "where is the timeout value of element12 configured and how does the event job commit"
SQL_KIND = "['CODE','CONFIG','SCHEMA','API_SPEC','BUSINESS_CONTEXT','DOCUMENTATION','TEST'][1 + label % 7]"
SQL_CHUNKS = f"""q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
chunks AS (SELECT vec_id, label, {SQL_KIND} AS chunk_type, 'svc' || label % 3 AS service_name, 'Class' || vec_id % 50 AS class_name, 'element' || vec_id % 100 AS element_name,
  list_cosine_similarity(embedding::DOUBLE[], v) AS sim FROM embeddings, q)"""


def chunk_table(t) -> DataFrame:
    e = t("embeddings")
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("label") % 7 + 1).cast("int"))
    return e.select("vec_id", "embedding", "label", kind.alias("chunk_type"), F.concat(F.lit("svc"), F.col("label") % 3).alias("service_name"), F.concat(F.lit("Class"), F.col("vec_id") % 50).alias("class_name"), F.concat(F.lit("element"), F.col("vec_id") % 100).alias("element_name"))


def first_vector(t, where: str = "vec_id = 0") -> list[float]:
    return t("embeddings").filter(where).orderBy("vec_id").select("embedding").first()["embedding"]


@query(f"WITH {SQL_CHUNKS} SELECT vec_id, label, round(sim, 6) AS similarity FROM chunks WHERE sim > 0 ORDER BY round(sim, 6) DESC, vec_id LIMIT 20")
def vec_topk(spark, t):
    return vector.topk(t("embeddings"), first_vector(t), 20, 0.0).select("vec_id", "label", "similarity")


@query(f"WITH {SQL_CHUNKS} SELECT vec_id, label, round(sim, 6) AS similarity FROM chunks WHERE sim > 0.5 ORDER BY round(sim, 6) DESC, vec_id LIMIT 8")
def vec_topk_threshold_050(spark, t):
    return vector.topk(t("embeddings"), first_vector(t), 8, vector.ANY_TYPE).select("vec_id", "label", "similarity")


@query(f"WITH {SQL_CHUNKS} SELECT vec_id, chunk_type, round(sim, 6) AS similarity FROM chunks WHERE sim > 0.35 AND chunk_type = 'CODE' ORDER BY round(sim, 6) DESC, vec_id LIMIT 20")
def vec_topk_type_035(spark, t):
    return vector.topk(chunk_table(t), first_vector(t), 20, vector.CODE_ONLY, F.col("chunk_type") == "CODE").select("vec_id", "chunk_type", "similarity")


@query(f"WITH {SQL_CHUNKS} SELECT vec_id, chunk_type, round(sim, 6) AS similarity FROM chunks WHERE sim > 0.4 AND chunk_type = 'BUSINESS_CONTEXT' ORDER BY round(sim, 6) DESC, vec_id LIMIT 8".replace("WHERE vec_id = 0", "WHERE label = 4 ORDER BY vec_id LIMIT 1"))
def vec_topk_context_040(spark, t):
    return vector.topk(chunk_table(t), first_vector(t, "label = 4"), 8, vector.CONTEXT_ONLY, F.col("chunk_type") == "BUSINESS_CONTEXT").select("vec_id", "chunk_type", "similarity")


@query("""WITH q AS (SELECT vec_id AS query, label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT q.query, e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.v), 6) AS similarity FROM embeddings e JOIN q ON e.label = q.label),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM s) SELECT query, vec_id, similarity, rank FROM r WHERE rank <= 5""")
def vec_knn_in_group(spark, t):
    e = t("embeddings")
    q = e.filter("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return vector.topk_in_group(e, q, "label", 5).select("query", "vec_id", "similarity", "rank")


@query()
def vec_ann_topk(spark, t):
    """Approximate: held against the exact search in the tests."""
    e = t("embeddings")
    c = vector.centroids(e)
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("q_vector"))
    return vector.topk_listed(vector.listed(e, c), q, c, 10).select("query", "vec_id", "similarity", "rank")


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1000) AS BIGINT)::VARCHAR), ',') || ']' AS rendered, round(CASE WHEN vec_id % 7 = 0 THEN 0.7 ELSE 1 - vec_id % 10 / 10.0 END, 6) AS similarity FROM embeddings")
def vec_rendering(spark, t):
    e = t("embeddings")
    thousandths = F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long"))
    distance = F.when(F.col("vec_id") % 7 == 0, None).otherwise((F.col("vec_id") % 10) / 10.0)
    return e.select("vec_id", vectors.rendered(thousandths).alias("rendered"), F.round(vectors.similarity(distance), 6).alias("similarity"))


def _sql_has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


def _sql_score(question: str) -> str:
    gain = lambda cond, col, value, amount: f" + CASE WHEN {cond} AND {col} = '{value}' THEN {amount} ELSE 0 END"
    s = "sim + CASE WHEN contains(q, lower(element_name)) THEN 0.30 ELSE 0 END + CASE WHEN contains(q, lower(class_name)) THEN 0.15 ELSE 0 END"
    have = ("chunk_type", "language", *FLAGS)
    for words, gains in rerank.RULES:
        for col, value, amount in gains:
            if col in have:
                s += gain(_sql_has(words), col, value, amount)
    s += gain(f"NOT {_sql_has(rerank.TEST_WORDS)}", "chunk_type", "TEST", rerank.TEST_LOSS)
    starts = "(" + " OR ".join(f"starts_with(q, '{w}')" for w in rerank.QUESTION_STARTS) + ")"
    for col, value, amount in rerank.QUESTION_GAINS:
        s += gain(starts, col, value, amount)
    return f"least({s}, 1.0)"


def _sql_score_of_chunks(question: str) -> str:
    """The score of rows that have no flags."""
    s = _sql_score(question)
    for flag in FLAGS:
        s = s.replace(f"{flag} = 'true'", "FALSE")
    return s.replace("language = 'YAML'", "FALSE")


FLAGS = {"is_endpoint": 3, "is_scheduled": 4, "is_transactional": 5, "is_event_handler": 6, "has_throws_doc": 7, "is_doc_chunk": 8}
SQL_FLAGS = ", ".join(f"CASE WHEN vec_id % {k} = 0 THEN 'true' END AS {name}" for name, k in FLAGS.items()) + ", CASE WHEN vec_id % 9 = 0 THEN 'YAML' ELSE 'yaml' END AS language"
#: A question that every rule has a word of.
EVERY_RULE = "what is the configured timeout, which endpoint has the table, why should the exception roll back the transaction of the cron job when a kafka message is written to element12 of class7"
def _sql_scored(question: str) -> str:
    return f"WITH {SQL_CHUNKS}, f AS (SELECT *, {SQL_FLAGS}, lower('{question}') AS q FROM chunks), scored AS (SELECT vec_id, chunk_type, round(sim, 6) AS similarity, round({_sql_score(question)}, 6) AS score FROM f)"


SQL_SCORED = _sql_scored(QUESTION)


def scored(t, question: str = QUESTION) -> DataFrame:
    c = chunk_table(t)
    q = F.array(*[F.lit(float(x)) for x in first_vector(t)])
    c = c.withColumn("sim", vectors.cosine(F.col("embedding"), q)).withColumn("distance", 1 - F.col("sim")).withColumn("similarity", F.round("sim", 6))
    for name, k in FLAGS.items():
        c = c.withColumn(name, F.when(F.col("vec_id") % k == 0, "true"))
    c = c.withColumn("language", F.when(F.col("vec_id") % 9 == 0, "YAML").otherwise("yaml"))
    return c.withColumn("score", F.round(rerank.metadata_score(c, F.lit(question)), 6))


@query(f"{SQL_SCORED} SELECT * FROM scored")
def rerank_metadata_score(spark, t):
    return scored(t).select("vec_id", "chunk_type", "similarity", "score")


@query(f"{_sql_scored(EVERY_RULE)} SELECT * FROM scored")
def rerank_every_rule(spark, t):
    return scored(t, EVERY_RULE).select("vec_id", "chunk_type", "similarity", "score")


@query(f"{SQL_SCORED} SELECT * FROM scored ORDER BY score DESC, vec_id LIMIT 10")
def rerank_topk_stable(spark, t):
    return scored(t).select("vec_id", "chunk_type", "similarity", "score").orderBy(F.col("score").desc(), "vec_id").limit(10)


SQL_RANKED = f"WITH {SQL_CHUNKS}, top20 AS (SELECT vec_id, chunk_type, class_name, element_name, service_name, round(sim, 6) AS similarity FROM chunks WHERE sim > 0 ORDER BY round(sim, 6) DESC, vec_id LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM top20)"


def ranked(t, k: int = 20) -> DataFrame:
    return retrieve._ranked(vector.topk(chunk_table(t), first_vector(t), k, 0.0))


@query(f"{SQL_RANKED} SELECT vec_id, chunk_type, rank FROM r ORDER BY (chunk_type = 'CONFIG') DESC, rank LIMIT 5")
def boost_by_type(spark, t):
    return rerank.boost_by_type(ranked(t), "CONFIG", 5).select("vec_id", "chunk_type", "rank")


@query(f"""{SQL_RANKED}, b AS (SELECT vec_id, chunk_type, rank FROM r ORDER BY (chunk_type = 'CONFIG') DESC, rank LIMIT 5), o AS (SELECT vec_id, chunk_type, rank FROM r WHERE chunk_type <> 'CONFIG' ORDER BY rank LIMIT 3)
SELECT 0 AS part_no, * FROM b UNION ALL SELECT 1, * FROM o""")
def config_bag_union(spark, t):
    return rerank.config_matches(ranked(t)).select("part_no", "vec_id", "chunk_type", "rank")


@query(f"""{SQL_RANKED}, c AS (SELECT *, 'Element' || rank || CASE WHEN rank % 6 = 0 THEN ' maybe NULL' ELSE '' END AS content FROM r WHERE rank <= 15),
n AS (SELECT *, contains(lower(content), 'null') OR contains(lower(content), 'optional') AS relevant FROM c), m AS (SELECT *, count(*) FILTER (relevant) OVER () AS k FROM n)
SELECT vec_id, rank, relevant FROM m WHERE relevant OR k < 5 ORDER BY relevant DESC, rank LIMIT 8""")
def null_relevance_fill(spark, t):
    c = ranked(t).filter("rank <= 15").withColumn("content", F.concat(F.lit("Element"), "rank", F.when(F.col("rank") % 6 == 0, " maybe NULL").otherwise("")))
    return retrieve.null_fill(c).select("vec_id", "rank", "relevant")


SQL_METHODS = """methods AS (SELECT p_partkey, 'svc' || p_partkey % 3 || '.Class' || p_partkey % 50 || '.element' || p_partkey % 100 || '#' || p_partkey AS qualified_name, 'svc' || p_partkey % 3 AS service_name, 'Class' || p_partkey % 50 AS class_name,
'element' || p_partkey % 100 AS simple_name, p_size >= 45 AS is_endpoint, p_size % 4 = 0 AS is_transactional, p_size % 5 = 0 AS is_scheduled, p_size % 6 = 0 AS is_event_handler, p_size AS cyclomatic_complexity FROM part)"""
#: Two edges from every part: halves lead to a root, sevenfolds go round; with loops and parallel edges.
SQL_EDGES = "edges AS (SELECT p_partkey AS src, p_partkey >> 1 AS dst, p_partkey * 2 AS edge_id FROM part UNION ALL SELECT p_partkey, p_partkey * 7 % 199, p_partkey * 2 + 1 FROM part)"
SQL_CLASSES = """classes AS (SELECT s_suppkey, 'svc' || s_suppkey % 3 || '.Class' || s_suppkey % 50 || '#' || s_suppkey AS qualified_name, 'svc' || s_suppkey % 3 AS service_name, 'Class' || s_suppkey % 50 AS simple_name, 'svc' || s_suppkey % 3 AS package_name,
CASE s_suppkey % 4 WHEN 0 THEN 'REST_CONTROLLER' WHEN 1 THEN 'CONTROLLER' WHEN 2 THEN 'SERVICE' END AS spring_stereotype, CASE WHEN s_suppkey % 5 = 0 THEN 'INTERFACE' ELSE 'CLASS' END AS node_type FROM supplier),
class_edges AS (SELECT 'DEPENDS_ON' AS kind, s_suppkey AS src, s_suppkey * 7 % 10 AS dst FROM supplier UNION ALL SELECT 'INHERITS', s_suppkey, s_suppkey >> 1 FROM supplier UNION ALL SELECT 'IMPLEMENTS', s_suppkey, s_suppkey * 3 % 10 FROM supplier)"""


def methods(t) -> DataFrame:
    p = F.col("p_partkey")
    name = F.concat(F.lit("svc"), p % 3, F.lit(".Class"), p % 50, F.lit(".element"), p % 100, F.lit("#"), p)
    flags = {"is_endpoint": F.col("p_size") >= 45, "is_transactional": F.col("p_size") % 4 == 0, "is_scheduled": F.col("p_size") % 5 == 0, "is_event_handler": F.col("p_size") % 6 == 0}
    return t("part").select("p_partkey", name.alias("qualified_name"), F.concat(F.lit("svc"), p % 3).alias("service_name"), F.concat(F.lit("Class"), p % 50).alias("class_name"), F.concat(F.lit("element"), p % 100).alias("simple_name"), *[c.alias(k) for k, c in flags.items()], F.col("p_size").alias("cyclomatic_complexity"))


def part_edges(t) -> DataFrame:
    """Two edges from every part."""
    p = t("part").select(F.col("p_partkey").alias("src"))
    e = p.select("src", F.shiftright("src", 1).alias("dst"), (F.col("src") * 2).alias("edge_id"))
    return e.unionByName(p.select("src", (F.col("src") * 7 % 199).alias("dst"), (F.col("src") * 2 + 1).alias("edge_id")))


def classes(t) -> DataFrame:
    k = F.col("s_suppkey")
    service = F.concat(F.lit("svc"), k % 3)
    kind = F.when(k % 4 == 0, "REST_CONTROLLER").when(k % 4 == 1, "CONTROLLER").when(k % 4 == 2, "SERVICE")
    return t("supplier").select("s_suppkey", F.concat(service, F.lit(".Class"), k % 50, F.lit("#"), k).alias("qualified_name"), service.alias("service_name"), F.concat(F.lit("Class"), k % 50).alias("simple_name"), service.alias("package_name"), kind.alias("spring_stereotype"), F.when(k % 5 == 0, "INTERFACE").otherwise("CLASS").alias("node_type"))


def _store(t) -> retrieve.Store:
    """Chunks from embeddings, methods and calls from parts, classes and their edges from suppliers."""
    m, c = methods(t), classes(t)
    by = m.select("p_partkey", "qualified_name")
    calls = part_edges(t).join(by.select(F.col("p_partkey").alias("src"), F.col("qualified_name").alias("a")), "src").join(by.select(F.col("p_partkey").alias("dst"), F.col("qualified_name").alias("b")), "dst")
    calls = calls.select("edge_id", F.lit("CALLS").alias("kind"), F.col("a").alias("src"), F.col("b").alias("dst"))
    k, names = F.col("s_suppkey"), c.select("s_suppkey", "qualified_name")
    ends = {"DEPENDS_ON": k * 7 % 10, "INHERITS": F.shiftright(k, 1), "IMPLEMENTS": k * 3 % 10}
    for i, (kind, dst) in enumerate(ends.items()):
        e = names.select(F.col("qualified_name").alias("src"), dst.alias("to"), (-1 - k * 3 - i).alias("edge_id"))
        e = e.join(names.select(F.col("s_suppkey").alias("to"), F.col("qualified_name").alias("dst")), "to").select("edge_id", F.lit(kind).alias("kind"), "src", "dst")
        calls = calls.unionByName(e)
    return retrieve.Store(chunk_table(t).withColumn("content", F.col("element_name")), m, c, calls)


@query(f"""WITH {SQL_CHUNKS.replace("WHERE vec_id = 0", "WHERE label = 0 ORDER BY vec_id LIMIT 1")}, hits AS (SELECT vec_id, service_name, class_name, element_name, round(sim, 6) AS similarity FROM chunks WHERE sim > 0.35 AND service_name = 'svc0' AND chunk_type = 'CODE' ORDER BY round(sim, 6) DESC, vec_id LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank, lower('{QUESTION}') AS q, similarity AS sim, 'CODE' AS chunk_type FROM hits),
f AS (SELECT vec_id, rank, similarity, round({_sql_score_of_chunks(QUESTION)}, 6) AS score FROM r)
SELECT * FROM f ORDER BY score DESC, rank LIMIT 8""")
def find_implementation(spark, t):
    label = retrieve.find_implementation(_store(t), QUESTION, first_vector(t, "label = 0"), "svc0")["chunks"]
    return label.select("vec_id", "rank", "similarity", "score")


# ---------------------------------------------------------------- graph

@query("SELECT c_custkey, c_name, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(c_name, '7') ORDER BY c_name, o_orderkey LIMIT 20")
def callers_one_hop(spark, t):
    c, e = t("customer").select("c_custkey", "c_name"), t("orders").select(F.col("o_custkey").alias("src"), F.col("o_custkey").alias("dst"), "o_orderkey")
    return graph.one_hop(c, e, None, F.col("m.c_name").contains("7"), "c_custkey").select("c_custkey", "c_name", "o_orderkey").orderBy("c_name", "o_orderkey").limit(20)


@query(f"""WITH RECURSIVE {SQL_EDGES}, walk AS (SELECT src AS root, dst AS node, 1 AS depth, [edge_id] AS path FROM edges
UNION ALL SELECT w.root, e.dst, w.depth + 1, list_append(w.path, e.edge_id) FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 5 AND NOT list_contains(w.path, e.edge_id))
SELECT root, node, depth, count(*) AS n FROM walk GROUP BY ALL""")
def chain_1_5_trails(spark, t):
    e = part_edges(t)
    return graph.trails(e, e.select(F.col("src").alias("root")).distinct(), graph.CHAIN_DEPTH).groupBy("root", "node", "depth").agg(F.count("*").alias("n"))


SQL_TREE = "tree AS (SELECT 'o' || o_orderkey AS child, 'c' || o_custkey AS parent FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"


def tree_edges(t) -> DataFrame:
    p = lambda letter, c: F.concat(F.lit(letter), F.col(c))
    e = t("orders").select(p("o", "o_orderkey").alias("src"), p("c", "o_custkey").alias("dst"))
    e = e.unionByName(t("customer").select(p("c", "c_custkey").alias("src"), p("n", "c_nationkey").alias("dst")))
    return e.unionByName(t("nation").select(p("n", "n_nationkey").alias("src"), p("r", "n_regionkey").alias("dst"))).withColumn("edge_id", F.concat_ws(">", "src", "dst"))


@query(f"WITH RECURSIVE {SQL_TREE}, walk AS (SELECT child AS root, parent AS node, 1 AS depth FROM tree WHERE child IN ('o1', 'o2', 'o3', 'o7', 'c5') UNION ALL SELECT w.root, t.parent, w.depth + 1 FROM walk w JOIN tree t ON t.child = w.node WHERE w.depth < 10) SELECT root, node, depth FROM walk")
def ancestors_1_10(spark, t):
    seeds = spark.createDataFrame([("o1",), ("o2",), ("o3",), ("o7",), ("c5",)], "root string")
    return graph.trails(tree_edges(t), seeds, graph.ANCESTOR_DEPTH).select("root", "node", "depth")


@query(f"WITH RECURSIVE {SQL_TREE}, walk AS (SELECT parent AS root, child AS node, 1 AS depth FROM tree WHERE parent = 'r1' UNION ALL SELECT w.root, t.child, w.depth + 1 FROM walk w JOIN tree t ON t.parent = w.node WHERE w.depth < 3) SELECT depth, count(*) AS n, count(DISTINCT node) AS nodes FROM walk GROUP BY depth")
def deps_1_3(spark, t):
    seeds = spark.createDataFrame([("r1",)], "root string")
    return graph.trails(tree_edges(t), seeds, graph.DEPENDENCY_DEPTH, reverse=True).groupBy("depth").agg(F.count("*").alias("n"), F.countDistinct("node").alias("nodes"))


@query(f"WITH {SQL_TREE} SELECT t.child, c_mktsegment FROM tree t JOIN customer ON t.child = 'c' || c_custkey WHERE contains(t.parent, '2') AND starts_with(t.parent, 'n') AND c_mktsegment = 'BUILDING'")
def dependents_in_scope(spark, t):
    c = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("node"), "c_mktsegment")
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit(None).cast("string").alias("c_mktsegment"))
    hop = graph.one_hop(c.unionByName(n), tree_edges(t), None, F.col("m.node").contains("2") & F.col("m.node").startswith("n"), "node")
    return hop.filter("c_mktsegment = 'BUILDING'").select(F.col("node").alias("child"), "c_mktsegment")


@query("SELECT DISTINCT p_partkey, p_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE contains(s_name, '5')")
def implementors_contains(spark, t):
    nodes = t("part").select(F.concat(F.lit("p"), "p_partkey").alias("node"), "p_partkey", "p_name").unionByName(t("supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("node"), F.lit(None).cast("long").alias("p_partkey"), F.col("s_name").alias("p_name")))
    e = t("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    return graph.one_hop(nodes, e, None, F.col("m.node").startswith("s") & F.col("m.p_name").contains("5"), "node").select("p_partkey", "p_name").distinct()


@query(f"WITH {SQL_METHODS} SELECT p_partkey, qualified_name FROM methods WHERE service_name = 'svc1' AND is_endpoint")
def flag_filter(spark, t):
    return lookup.flagged(methods(t), "svc1", "is_endpoint").select("p_partkey", "qualified_name")


@query(f"WITH {SQL_METHODS} SELECT p_partkey, cyclomatic_complexity FROM methods WHERE service_name = 'svc0' AND cyclomatic_complexity >= 40 ORDER BY cyclomatic_complexity DESC, qualified_name")
def high_complexity(spark, t):
    return lookup.complex_methods(methods(t), "svc0", 40).select("p_partkey", "cyclomatic_complexity")


@query(f"WITH {SQL_CLASSES} SELECT qualified_name, spring_stereotype FROM classes WHERE service_name = 'svc2' AND spring_stereotype IS NOT NULL")
def not_null_filter(spark, t):
    return lookup.beans(classes(t), "svc2").select("qualified_name", "spring_stereotype")


@query(f"WITH {SQL_CLASSES}, twice AS (SELECT * FROM classes UNION ALL SELECT * FROM classes) SELECT qualified_name, spring_stereotype FROM twice WHERE service_name = 'svc0' AND spring_stereotype = 'CONTROLLER' UNION SELECT qualified_name, spring_stereotype FROM twice WHERE service_name = 'svc0' AND spring_stereotype = 'REST_CONTROLLER'")
def controllers_union_distinct(spark, t):
    return lookup.controllers(classes(t).unionByName(classes(t)), "svc0").select("qualified_name", "spring_stereotype")


@query("SELECT user_id, count(*) AS branches FROM events WHERE event_type IN ('error', 'purchase') GROUP BY user_id ORDER BY branches DESC, user_id LIMIT 10")
def most_complex_topn(spark, t):
    return stats.most_complex(t("events"), "user_id", ["error", "purchase"], "event_type", 10)


@query("""WITH c AS (SELECT c_mktsegment AS service_name, count(*) AS class_count FROM customer GROUP BY 1), m AS (SELECT c_mktsegment AS service_name, count(*) AS method_count, count(*) FILTER (o_orderstatus = 'F') AS endpoint_count,
count(*) FILTER (o_totalprice >= 100000) AS complex_count FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
SELECT service_name, coalesce(class_count, 0) AS class_count, coalesce(method_count, 0) AS method_count, coalesce(endpoint_count, 0) AS endpoint_count, coalesce(complex_count, 0) AS complex_count FROM c FULL JOIN m USING (service_name)""")
def service_stats(spark, t):
    c = t("customer").select("c_custkey", F.col("c_mktsegment").alias("service_name"))
    m = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("service_name", (F.col("o_orderstatus") == "F").alias("is_endpoint"), F.when(F.col("o_totalprice") >= 100000, 10).otherwise(0).alias("cyclomatic_complexity"))
    return stats.service_stats(c, m)


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def count_by_type(spark, t):
    return stats.count_by(t("events"), "event_type")


@query("SELECT user_id, count(*) AS node_count, count(*) FILTER (event_type IN ('error', 'click')) + 1 AS complexity FROM events GROUP BY 1")
def complexity_per_group(spark, t):
    return graph.complexity(t("events"), "user_id", "event_type", ["error", "click"])


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def distinct_keep_first(spark, t):
    li = t("lineitem").select("l_partkey", "l_orderkey", "l_linenumber")
    return graph.keep_first(li, ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query(f"WITH {SQL_EDGES} SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT dst FROM edges) AND p_size > 1")
def dead_nodes(spark, t):
    return graph.unreachable(t("part").select("p_partkey", "p_size"), part_edges(t), "p_partkey", F.col("p_size") <= 1).select("p_partkey")


@query("SELECT DISTINCT user_id, event_type FROM events u WHERE ts >= TIMESTAMP '2024-01-04' AND event_type <> 'this' AND NOT EXISTS (SELECT 1 FROM events d WHERE d.ts < TIMESTAMP '2024-01-04' AND d.user_id = u.user_id AND d.event_type = u.event_type)")
def external_refs_anti(spark, t):
    e = t("events").select("user_id", "event_type", "ts")
    return graph.external_references(e.filter("ts >= TIMESTAMP '2024-01-04'"), e.filter("ts < TIMESTAMP '2024-01-04'"), ["user_id"], "event_type")


@query("""SELECT user_id, event_type, array_to_string(list(event_id ORDER BY ts, event_id) FILTER (value < 10), ',') AS defs, array_to_string(list(event_id ORDER BY ts, event_id) FILTER (value >= 10), ',') AS uses, count(*) FILTER (value < 10) = 0 AS only_used
FROM events GROUP BY 1, 2""")
def def_use_summary(spark, t):
    e = t("events").select(F.col("user_id").alias("method_qn"), F.col("event_type").alias("var"), F.struct("ts", "event_id").alias("ord"), F.col("event_id").alias("line"), "value", F.lit(None).cast("string").alias("more"))
    defs, uses = e.filter("value < 10").withColumnsRenamed({"more": "source_expr"}), e.filter("value >= 10").withColumnsRenamed({"more": "context"})
    got = java.flow_summary(defs.withColumn("def_type", F.lit("D")).withColumn("var_type", F.lit("")), uses.withColumn("use_type", F.lit("U")))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["line"].cast("string")), ",").alias(c)
    return got.select(F.col("method_qn").alias("user_id"), F.col("var").alias("event_type"), ids("defs"), ids("uses"), F.col("place.only_used").alias("only_used"))


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey <> 2")
def delete_by_scope(spark, t):
    return maintain.delete_scope(t("nation"), "n_regionkey", 2).select("n_nationkey", "n_name")


@query("SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def detach_delete_edges(spark, t):
    e = t("customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    n = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"), "n_regionkey")
    return graph.detach_delete(n, e, n.filter("n_regionkey = 2"), "node")[1]


@query(f"""WITH {SQL_CHUNKS}, hits AS (SELECT vec_id, service_name || '.' || class_name || '.' || element_name AS seed, round(sim, 6) AS similarity FROM chunks WHERE sim > 0 ORDER BY round(sim, 6) DESC, vec_id LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY similarity DESC, vec_id) AS rank FROM hits), {SQL_METHODS}, {SQL_EDGES},
names AS (SELECT p_partkey, qualified_name FROM methods), calls AS (SELECT r.rank, a.qualified_name FROM r JOIN names b ON contains(b.qualified_name, r.seed) JOIN edges e ON e.dst = b.p_partkey JOIN names a ON a.p_partkey = e.src),
lim AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY qualified_name) AS n FROM calls), firsts AS (SELECT qualified_name, min(rank) AS rank FROM lim WHERE n <= 20 GROUP BY 1)
SELECT rank, qualified_name FROM firsts ORDER BY rank, qualified_name LIMIT 15""")
def hybrid_expand(spark, t):
    return retrieve.callers_of(_store(t), ranked(t), 15).select("rank", "qualified_name")


# ---------------------------------------------------------------- intent

QUESTIONS = [
    "who uses UserRepository", "impact of removing PaymentService", "what does checkout call", "walk me through the payment flow", "who calls processPayment", "where does processPayment get called",
    "how is the connection pool set up", "which classes extend BaseRepository", "checkout isn't working properly", "is userId checked for null", "what is the discount calculation rule", "how is processPayment tested",
    "show me all GET mappings", "locate the retry logic", "", "  ", "xyzzy_unknown_pattern_12345", "WHO CALLS processPayment", "callers of processPayment", "what does a\ncall", "the latest specific interest",
]


def _sql_hit(p: str) -> str:
    p = p.replace("'", "''")
    return f"regexp_full_match(q, '.*{p}.*')" if ".*" in p else f"contains(q, '{p}')"


def _sql_classify(source: str) -> str:
    first = " ".join(f"WHEN {' OR '.join(_sql_hit(p) for p in ps)} THEN '{name}'" for name, ps in intent.PATTERNS)
    n = " + ".join(f"CASE WHEN {_sql_hit(p)} THEN 1 ELSE 0 END" for _, ps in intent.PATTERNS for p in ps)
    return f"""WITH src AS ({source}), n AS (SELECT *, lower(trim(question)) AS q FROM src), c AS (SELECT *, CASE WHEN q = '' THEN 'FIND_IMPLEMENTATION' {first} ELSE 'FIND_IMPLEMENTATION' END AS intent, {n} AS hits FROM n),
d AS (SELECT *, CASE WHEN hits = 0 THEN 0.30::DOUBLE ELSE round(least(0.5::DOUBLE + 0.15::DOUBLE * hits, 1.0::DOUBLE), 2) END AS confidence FROM c),
e AS (SELECT *, CASE WHEN confidence > 0.75 THEN 'HIGH' WHEN confidence >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS tier FROM d)"""


SQL_QUESTIONS = "SELECT id, question FROM (VALUES " + ", ".join("(" + str(i) + ", '" + q.replace("'", "''") + "')" for i, q in enumerate(QUESTIONS)) + ") v(id, question)"


@query(_sql_classify(SQL_QUESTIONS) + " SELECT id, intent, hits, confidence, tier, CASE WHEN tier = 'LOW' THEN 'GENERAL_UNDERSTANDING' ELSE intent END AS routed FROM e")
def classify_questions(spark, t):
    df = spark.createDataFrame(list(enumerate(QUESTIONS)), "id int, question string")
    return intent.classify(df, "question").select("id", "intent", "hits", "confidence", "tier", "routed")


@query(_sql_classify("SELECT item_id, text AS question FROM benchmark") + " SELECT item_id, intent, hits, confidence FROM e")
def classify_intent(spark, t):
    return intent.classify(t("benchmark").withColumnRenamed("text", "question"), "question").select("item_id", "intent", "hits", "confidence")


@query(_sql_classify("SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'") + " SELECT tier, intent, count(*) AS n FROM e GROUP BY 1, 2")
def confidence_tier(spark, t):
    return intent.classify(t("conversations").filter("role = 'user'").withColumnRenamed("text", "question"), "question").groupBy("tier", "intent").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- change sets and writes

SQL_CHANGES = """cur AS (SELECT 'f' || doc_id AS path, sha256(text) AS now FROM documents WHERE doc_id % 10 <> 3),
old AS (SELECT 'f' || doc_id AS path, CASE WHEN doc_id % 10 = 5 THEN sha256(text || 'x') ELSE sha256(text) END AS was FROM documents WHERE doc_id % 10 <> 7),
ch AS (SELECT path, CASE WHEN was IS NULL THEN 'ADDED' WHEN now IS NULL THEN 'DELETED' WHEN now <> was THEN 'MODIFIED' ELSE 'UNCHANGED' END AS status FROM cur FULL JOIN old USING (path))"""


def changes(t) -> DataFrame:
    d = t("documents").select(F.concat(F.lit("f"), "doc_id").alias("path"), "text", "doc_id")
    cur = incremental.fingerprints(d.filter("doc_id % 10 <> 3"), "path", "text")
    old = incremental.fingerprints(d.filter("doc_id % 10 <> 7").withColumn("text", F.when(F.col("doc_id") % 10 == 5, F.concat("text", F.lit("x"))).otherwise(F.col("text"))), "path", "text")
    return incremental.change_set(cur, old)


@query(f"WITH {SQL_CHANGES} SELECT path, status FROM ch")
def change_set(spark, t):
    return changes(t)


@query(f"WITH {SQL_CHANGES} SELECT count(*) FILTER (status = 'ADDED') AS added, count(*) FILTER (status = 'MODIFIED') AS modified, count(*) FILTER (status = 'DELETED') AS deleted, count(*) FILTER (status = 'UNCHANGED') AS unchanged, count(*) FILTER (status <> 'UNCHANGED') AS total_changed FROM ch")
def change_counts(spark, t):
    return incremental.change_counts(changes(t))


@query("SELECT 'f' || doc_id AS path, sha256(text) AS sha256 FROM documents")
def fingerprint_sha256(spark, t):
    return incremental.fingerprints(t("documents").withColumn("path", F.concat(F.lit("f"), "doc_id")), "path", "text")


@query("""WITH d AS (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 10000000 ELSE 0 END AS k, 'X' AS s, o_orderdate + INTERVAL 1 DAY AS dt FROM orders WHERE o_orderkey % 10 = 0)
SELECT coalesce(o_orderkey, k) AS o_orderkey, coalesce(s, o_orderstatus) AS o_orderstatus, coalesce(o_orderdate, dt) AS o_orderdate FROM orders FULL JOIN d ON o_orderkey = k""")
def upsert_coalesce(spark, t):
    o = t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    d = o.filter("o_orderkey % 10 = 0").select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 50 == 0, 10000000).otherwise(0)).alias("o_orderkey"), F.lit("X").alias("o_orderstatus"), (F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("o_orderdate"))
    return maintain.upsert(o, d, ["o_orderkey"], keep=["o_orderdate"])


@query("SELECT event_id, props FROM events WHERE json_extract_string(props, '$.k') IS DISTINCT FROM '3'")
def json_filter(spark, t):
    return maintain.delete_json_scope(t("events").select("event_id", "props"), "props", "k", "3")


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1")
def last_version(spark, t):
    e = t("events").select("user_id", "event_id", "ts")
    return maintain.merge_versions(e, ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'FRESH' WHEN n_nationkey % 2 = 0 THEN 'FORCE_FULL' ELSE 'INCREMENTAL' END AS strategy, n_nationkey, CASE WHEN n_name = 'NATION_3' OR n_nationkey = 3 THEN 'DELETING' ELSE 'ACTIVE' END AS status FROM nation")
def strategy_and_status(spark, t):
    n = t("nation").withColumn("status", F.lit("ACTIVE")).withColumn("service_name", F.concat(F.lit("s"), "n_nationkey"))
    return maintain.set_status(n, "s3", maintain.DELETING).select(incremental.strategy(F.col("n_regionkey") != 0, F.col("n_nationkey") % 2 == 0).alias("strategy"), "n_nationkey", "status")


# ---------------------------------------------------------------- memory and context


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2")
def window_last2(spark, t):
    return memory.last_turns(t("conversations").select("conv_id", "turn", "role"), memory.WINDOW_TURNS)


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def history_cap5(spark, t):
    return memory.last_turns(t("conversations").select("conv_id", "turn", "role"), memory.HISTORY_CAP)


@query("SELECT conv_id, turn, least(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1, 5) AS turn_index FROM conversations")
def turn_index_capped(spark, t):
    return memory.turn_index(t("conversations").select("conv_id", "turn"))


@query("""WITH w AS (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 2),
r AS (SELECT conv_id, turn, text FROM conversations WHERE turn % 2 = 0) SELECT 0 AS part_no, conv_id, turn FROM r WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.conv_id = r.conv_id AND w.text = r.text) UNION ALL SELECT 1, conv_id, turn FROM w""")
def memory_merge(spark, t):
    c = t("conversations").select("conv_id", "turn", "text")
    return memory.merged_memory(c.filter("turn % 2 = 0"), c).select("part_no", "conv_id", "turn")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session_no FROM g""")
def session_gap_30m(spark, t):
    return memory.sessions(t("events").select("user_id", "event_id", "ts")).select("user_id", "event_id", "session_no")


@query("SELECT conv_id, turn, substr(coalesce(text, ''), 1, 400) AS summary, 'Q: ' || text || chr(10) || 'A: ' || role AS turn_text FROM conversations")
def turn_summary(spark, t):
    return t("conversations").select("conv_id", "turn", memory.summary(F.col("text")).alias("summary"), F.concat(F.lit("Q: "), "text", F.lit("\nA: "), "role").alias("turn_text"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER w AS ordinal, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
SELECT source, doc_id, ordinal, before FROM r WHERE before <= 32000""")
def context_budget(spark, t):
    d = t("documents").select("source", "doc_id", F.length("text").alias("len"))
    return context.within_budget(d, ["source"], [F.col("doc_id")], F.col("len")).select("source", "doc_id", "ordinal", "before")


@query("""SELECT doc_id, '--- Chunk ' || doc_id || ' [' || source || '.' || lang || ' / DOC] ---' || chr(10) || CASE WHEN length(text) > 400 THEN substr(text, 1, 400) || '...' ELSE text END || chr(10) || chr(10) AS block FROM documents""")
def context_blocks(spark, t):
    d = t("documents")
    return d.select("doc_id", context.chunk_block(F.col("doc_id"), context.chunk_header(F.col("source"), F.col("lang"), F.lit("DOC")), T.preview(F.col("text"), 400)).alias("block"))


@query("SELECT doc_id, 'Service: ' || source || chr(10) || 'File: f' || doc_id || chr(10) || 'Type: ' || lang || chr(10) || 'a: 1' || chr(10) || 'b: 2' || chr(10) || chr(10) || text AS enriched FROM documents")
def enrich_text(spark, t):
    extra = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    return t("documents").select("doc_id", T.enriched_text(F.col("source"), F.concat(F.lit("f"), "doc_id"), F.col("lang"), F.lit(None).cast("string"), extra, F.col("text")).alias("enriched"))


# ---------------------------------------------------------------- text


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, sum((length(line) % 5 = 0)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM l)
SELECT doc_id, section, min(pos) + 1 AS start_line, max(pos) + 1 AS end_line, arg_min(line, pos) AS first_line FROM h GROUP BY 1, 2""")
def section_split(spark, t):
    rows = chunkers.sections(t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content")), heading=lambda x: F.length(x) % 5 == 0, blank=True)
    first = t("documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return rows.join(first, F.col("path") == F.col("doc_id")).select("doc_id", "section", "start_line", "end_line", F.expr("lines[start_line - 1]").alias("first_line"))


@query("SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+@[A-Za-z0-9_]+')) AS content FROM documents")
def regex_statements(spark, t):
    d = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return chunkers.sql_statements(d, pattern="[A-Za-z0-9_]+@[A-Za-z0-9_]+").select(F.col("path").alias("doc_id"), "content")


SCRIPTS = [
    "CREATE TABLE a (x int);\n-- c\nINSERT INTO a\nVALUES (1);", "create index i on t(c);", "select 1; drop table t; ALTER TABLE t ADD c int;", "nothing here", "CREATE TABLE IF NOT EXISTS t (y int);",
]
SQL_SCRIPTS = """SELECT * FROM (VALUES ('0', 0, 'a', 'CREATE_TABLE', 1, 1), ('0', 1, 'a', 'INSERT', 3, 4), ('1', 0, 'i', 'CREATE_INDEX', 1, 1), ('2', 0, 'unknown', 'OTHER', 1, 1), ('2', 1, 't', 'OTHER', 1, 1),
('2', 2, 't', 'ALTER_TABLE', 1, 1), ('4', 0, 'IF', 'CREATE_TABLE', 1, 1)) v(path, pos, element_name, statement_type, start_line, end_line)"""


@query(SQL_SCRIPTS)
def sql_scan(spark, t):
    files = spark.createDataFrame([(str(i), s) for i, s in enumerate(SCRIPTS)], "path string, content string")
    return chunkers.sql_statements(files).select("path", "pos", "element_name", "statement_type", "start_line", "end_line")


@query("SELECT conv_id, turn, coalesce(try_cast(nullif(regexp_extract(text, '\\b([0-9]|10)\\b', 1), '') AS DOUBLE), 5.0) AS score FROM conversations")
def score_parse(spark, t):
    return t("conversations").select("conv_id", "turn", T.parsed_score(F.col("text")).alias("score"))


@query("""SELECT p_partkey, contains(p, '/test/') OR ends_with(p, 'Test.java') OR ends_with(p, 'Tests.java') OR ends_with(p, 'Spec.java') AS is_test, contains(p, '.') AND NOT regexp_matches(p, '^(java|javax|org\\.springframework|lombok)\\.') AS is_project,
regexp_extract(p, '[^/\\\\]*$') AS name FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'src/test/' ELSE 'java.' END || p_name || CASE p_partkey % 3 WHEN 0 THEN 'Test.java' ELSE '.java' END AS p FROM part)""")
def path_predicates(spark, t):
    p = F.concat(F.when(F.col("p_partkey") % 4 == 0, "src/test/").otherwise("java."), F.col("p_name"), F.when(F.col("p_partkey") % 3 == 0, "Test.java").otherwise(".java"))
    d = t("part").select("p_partkey", p.alias("p"))
    return d.select("p_partkey", T.is_test_file(F.col("p")).alias("is_test"), T.is_project_type(F.col("p")).alias("is_project"), T.basename(F.col("p")).alias("name"))
