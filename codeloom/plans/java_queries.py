"""Queries over a small Java file; the SQL lists what its statements must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import stats
from codeloom.plans.registry import query
from codeloom.sources import java

SOURCE = '''package com.acme.pay;
import com.acme.db.Repo;
@Service
public class PayService extends Base implements Payer {
  private final Repo repo;
  @Transactional @PostMapping("/pay")
  public int pay(String id, int tries) {
    int total = 0;
    if (id == null) { throw new PayError("x"); } else { total = repo.find(id); }
    for (String s : names) { total += s.length(); }
    while (tries > 0) { tries--; }
    try { charge(total, id); } catch (PayError e) { log(e); } finally { done(); }
    return total > 0 ? total : fallback(id);
  }
}
interface Payer extends Root { int pay(String id, int tries); }
enum Kind { A, B }
'''


def facts(spark):
    return java.facts(spark.createDataFrame([("/r/PayService.java", SOURCE)], "path string, content string"), "pay")


@query("""SELECT * FROM (VALUES ('com.acme.pay.PayService', 'CLASS', 'SERVICE'), ('com.acme.pay.Payer', 'INTERFACE', NULL), ('com.acme.pay.Kind', 'ENUM', NULL)) v(qualified_name, node_type, spring_stereotype)""")
def java_classes(spark, t):
    return java.table(facts(spark), "class").select("qualified_name", "node_type", "spring_stereotype")


@query("""SELECT * FROM (VALUES ('com.acme.pay.PayService.pay(String,int)', 'POST', '/pay', TRUE, 21, 4, 'names,repo'), ('com.acme.pay.Payer.pay(String,int)', NULL, NULL, FALSE, 0, 0, '')) v(qualified_name, http_method, endpoint_path, is_transactional, cfg_node_count, cyclomatic_complexity, external_references)""")
def java_methods(spark, t):
    m = java.table(facts(spark), "method")
    return m.select("qualified_name", "http_method", "endpoint_path", "is_transactional", "cfg_node_count", "cyclomatic_complexity", F.array_join("external_references", ",").alias("external_references"))


@query("""SELECT kind, dst, coalesce(call_line, 0) AS call_line FROM (VALUES ('INHERITS', 'com.acme.pay.Base', NULL), ('IMPLEMENTS', 'com.acme.pay.Payer', NULL), ('IMPLEMENTS', 'com.acme.pay.Root', NULL), ('DEPENDS_ON', 'com.acme.db.Repo', NULL),
('DEFINES', 'com.acme.pay.PayService.pay(String,int)', NULL), ('DEFINES', 'com.acme.pay.Payer.pay(String,int)', NULL), ('CALLS', 'com.acme.pay.repo.find(?)', 9), ('CALLS', 'com.acme.pay.s.length(?)', 10), ('CALLS', 'com.acme.pay.PayService.charge(?)', 12),
('CALLS', 'com.acme.pay.PayService.log(?)', 12), ('CALLS', 'com.acme.pay.PayService.done(?)', 12), ('CALLS', 'com.acme.pay.PayService.fallback(?)', 13)) v(kind, dst, call_line)""")
def java_edges(spark, t):
    return java.table(facts(spark), "edge").select("kind", "dst", F.coalesce("call_line", F.lit(0)).alias("call_line"))


@query("""SELECT * FROM (VALUES (0, 1, 'UNCONDITIONAL', NULL), (1, 2, 'UNCONDITIONAL', NULL), (2, 3, 'TRUE', 'id == null'), (3, 20, 'EXCEPTION', NULL), (2, 5, 'FALSE', '!(id == null)'), (5, 4, 'UNCONDITIONAL', NULL), (4, 6, 'UNCONDITIONAL', NULL),
(6, 7, 'TRUE', 'hasNext(names)'), (7, 6, 'LOOP_BACK', NULL), (6, 8, 'FALSE', '!(hasNext(names))'), (8, 9, 'UNCONDITIONAL', NULL), (9, 10, 'TRUE', 'tries > 0'), (10, 9, 'LOOP_BACK', NULL), (9, 11, 'FALSE', '!(tries > 0)'), (11, 12, 'UNCONDITIONAL', NULL),
(12, 13, 'UNCONDITIONAL', NULL), (11, 14, 'EXCEPTION', NULL), (14, 15, 'UNCONDITIONAL', NULL), (15, 13, 'UNCONDITIONAL', NULL), (13, 16, 'UNCONDITIONAL', NULL), (16, 17, 'UNCONDITIONAL', NULL), (17, 18, 'UNCONDITIONAL', NULL), (18, 19, 'UNCONDITIONAL', NULL),
(19, 20, 'UNCONDITIONAL', NULL)) v(src, dst, edge_type, condition_text)""")
def java_control_flow(spark, t):
    return java.table(facts(spark), "cfg_edge").select("src", "dst", "edge_type", "condition_text")


@query("""SELECT * FROM (VALUES ('D', 0, 'id', 'PARAMETER'), ('D', 1, 'tries', 'PARAMETER'), ('D', 2, 'total', 'LOCAL_DECL'), ('D', 3, 'total', 'ASSIGNMENT'), ('D', 4, 's', 'LOOP_VAR'), ('D', 5, 'total', 'ASSIGNMENT'), ('D', 6, 'e', 'CAUGHT_EXCEPTION'),
('U', 0, 'id', 'CONDITION'), ('U', 1, 'repo', 'ASSIGNMENT_RHS'), ('U', 2, 'id', 'METHOD_ARG'), ('U', 3, 'names', 'CONDITION'), ('U', 4, 's', 'ASSIGNMENT_RHS'), ('U', 5, 'tries', 'CONDITION'), ('U', 6, 'total', 'METHOD_ARG'), ('U', 7, 'id', 'METHOD_ARG'),
('U', 8, 'e', 'METHOD_ARG'), ('U', 9, 'total', 'CONDITION'), ('U', 10, 'total', 'RETURN_VALUE'), ('U', 11, 'id', 'METHOD_ARG')) v(fact, ord, var, how)""")
def java_data_flow(spark, t):
    f = facts(spark)
    d = java.table(f, "def").filter("method_qn LIKE '%PayService%'").select(F.lit("D").alias("fact"), "ord", "var", F.col("def_type").alias("how"))
    return d.unionByName(java.table(f, "use").select(F.lit("U").alias("fact"), "ord", "var", F.col("use_type").alias("how")))


SHOP = '''package com.acme.shop;
import com.acme.db.Repo;
/** Sells things over the counter. */
@RestController @RequestMapping("/shop")
public class Shop {
  private final Repo repo;
  /** Opens the shop.
   * @param repo where things are
   */
  public Shop(Repo repo) {
    // keep the given repository
    this.repo = repo;
    open(repo);
    open(repo);
  }
  /** Sells one thing.
   * @param id of the thing
   * @param count how many
   * @return the price
   * @throws SoldOut if there is none
   * @since 2
   */
  @PostMapping("/sell") public int sell(String id, int count) throws SoldOut {
    // TODO: count what is left
    // the price of the first one counts for all of them
    int price = 0;
    for (int i = 0; i < count; i++) { price += repo.price(id, i); }
    switch (count) { case 0: throw new SoldOut(id); case 1, 2: price = price - 1; break; default: return price; }
    return price;
  }
  @GetMapping("/get") int get(int id) { return id; }
  @PutMapping(value = "/put") void put() { }
  @DeleteMapping("/del") void del() { }
  @PatchMapping void patch() { }
  @RequestMapping("/any") void any() { }
  @Scheduled(cron = "0 0") void tick() { }
  @KafkaListener void heard() { }
  public String toString() {
    String a = "1";
    String b = "2";
    return a + b;
  }
}
enum Size { S, M, L }
record Point(int x, int y) { }
@interface Mark { }
abstract class Half { abstract int f(); }
'''
CUT = "class Cut extends"


def shop(spark):
    """Facts of a readable and an unreadable file."""
    return java.facts(spark.createDataFrame([("/r/Shop.java", SHOP), ("/r/Cut.java", CUT)], "path string, content string"), "shop")


@query("""SELECT * FROM (VALUES ('com.acme.shop.Shop', 'CLASS', 'REST_CONTROLLER', FALSE, 'Sells things over the counter.'), ('com.acme.shop.Size', 'ENUM', NULL, FALSE, NULL), ('com.acme.shop.Point', 'RECORD', NULL, FALSE, NULL), ('com.acme.shop.Mark', 'ANNOTATION_TYPE', NULL, FALSE, NULL),
('com.acme.shop.Half', 'CLASS', NULL, TRUE, NULL)) v(qualified_name, node_type, spring_stereotype, is_abstract, javadoc_summary)""")
def java_types(spark, t):
    return java.table(shop(spark), "class").select("qualified_name", "node_type", "spring_stereotype", "is_abstract", "javadoc_summary")


@query("""SELECT * FROM (VALUES ('<init>', NULL, NULL, FALSE, NULL, FALSE, 0, 0), ('sell', 'POST', '/shop/sell', FALSE, NULL, FALSE, 16, 3), ('get', 'GET', '/shop/get', FALSE, NULL, FALSE, 3, 1), ('put', 'PUT', '/shop/put', FALSE, NULL, FALSE, 2, 1), ('del', 'DELETE', '/shop/del', FALSE, NULL, FALSE, 2, 1),
('patch', 'PATCH', '/shop', FALSE, NULL, FALSE, 2, 1), ('any', 'ANY', '/shop/any', FALSE, NULL, FALSE, 2, 1), ('tick', NULL, NULL, TRUE, '', FALSE, 2, 1), ('heard', NULL, NULL, FALSE, NULL, TRUE, 2, 1), ('toString', NULL, NULL, FALSE, NULL, FALSE, 5, 1), ('f', NULL, NULL, FALSE, NULL, FALSE, 0, 0))
v(simple_name, http_method, endpoint_path, is_scheduled, schedule_expression, is_event_handler, cfg_node_count, cyclomatic_complexity)""")
def java_spring_methods(spark, t):
    return java.table(shop(spark), "method").select("simple_name", "http_method", "endpoint_path", "is_scheduled", "schedule_expression", "is_event_handler", "cfg_node_count", "cyclomatic_complexity")


@query("""SELECT * FROM (VALUES (0, 'ENTRY', 'METHOD_ENTRY: sell'), (1, 'STATEMENT', 'int price = 0;'), (2, 'LOOP_HEADER', 'for (i < count)'), (3, 'METHOD_CALL', 'price += repo.price(id, i);'), (4, 'STATEMENT', 'after_for'), (5, 'CONDITION', 'switch (count)'), (6, 'STATEMENT', 'switch_merge'), (7, 'STATEMENT', 'case 0'),
(8, 'EXCEPTION_THROW', 'throw new SoldOut(id)'), (9, 'STATEMENT', 'case 1'), (10, 'STATEMENT', 'price = price - 1;'), (11, 'STATEMENT', 'break;'), (12, 'STATEMENT', 'case default'), (13, 'STATEMENT', 'return price'), (14, 'STATEMENT', 'return price'), (15, 'EXIT', 'METHOD_EXIT: sell')) v(ord, node_type, code)""")
def java_flow_nodes(spark, t):
    return java.table(shop(spark), "cfg_node").filter("method_qn LIKE '%.sell(%'").select("ord", "node_type", "code")


@query("""SELECT * FROM (VALUES (0, 1, 'UNCONDITIONAL', NULL, NULL), (1, 2, 'UNCONDITIONAL', NULL, NULL), (2, 3, 'TRUE', 'i < count', NULL), (3, 2, 'LOOP_BACK', NULL, NULL), (2, 4, 'FALSE', '!(i < count)', NULL), (4, 5, 'UNCONDITIONAL', NULL, NULL), (5, 7, 'FALL_THROUGH', 'count == 0', NULL), (7, 8, 'UNCONDITIONAL', NULL, NULL),
(8, 15, 'EXCEPTION', NULL, 'new SoldOut(id)'), (5, 9, 'FALL_THROUGH', 'count == 1', NULL), (9, 10, 'UNCONDITIONAL', NULL, NULL), (10, 11, 'UNCONDITIONAL', NULL, NULL), (11, 6, 'UNCONDITIONAL', NULL, NULL), (5, 12, 'FALL_THROUGH', 'count == default', NULL), (12, 13, 'UNCONDITIONAL', NULL, NULL), (13, 15, 'UNCONDITIONAL', NULL, NULL),
(6, 14, 'UNCONDITIONAL', NULL, NULL), (14, 15, 'UNCONDITIONAL', NULL, NULL)) v(src, dst, edge_type, condition_text, exception_type)""")
def java_flow_edges(spark, t):
    return java.table(shop(spark), "cfg_edge").filter("method_qn LIKE '%.sell(%'").select("src", "dst", "edge_type", "condition_text", "exception_type")


@query("""SELECT element_name, class_name, chunk_type, start_line, end_line, replace(content, '|', chr(10)) AS content FROM (VALUES
('Shop constructor', 'Shop', 'CODE', 10, 15, 'public Shop(Repo repo) {|    // keep the given repository|    this.repo = repo;|    open(repo);|    open(repo);|  }'),
('sell', 'Shop', 'CODE', 23, 30, 'CLASS CONTEXT: Shop — Sells things over the counter.||PURPOSE: Sells one thing.|PARAMETERS:|  id: of the thing|  count: how many|RETURNS: the price|THROWS:|  SoldOut: if there is none|SINCE: 2|KNOWN ISSUES / NOTES:|  TODO: count what is left|INLINE NOTES:|  // the price of the first one counts for all of them||CODE:|@PostMapping("/sell") public int sell(String id, int count) throws SoldOut {|    // TODO: count what is left|    // the price of the first one counts for all of them|    int price = 0;|    for (int i = 0; i < count; i++) { price += repo.price(id, i); }|    switch (count) { case 0: throw new SoldOut(id); case 1, 2: price = price - 1; break; default: return price; }|    return price;|  }'),
('sell(String,int)', NULL, 'DOCUMENTATION', 23, 30, 'Documentation for: com.acme.shop.Shop.sell(String,int)||Sells one thing.||@param id: of the thing|@param count: how many|@return the price|@throws SoldOut: if there is none|NOTE: TODO: count what is left|// the price of the first one counts for all of them|'),
('Size', 'Size', 'CODE', 44, 44, 'enum Size { S, M, L }'), ('Point', 'Point', 'CODE', 45, 45, 'record Point(int x, int y)')) v(element_name, class_name, chunk_type, start_line, end_line, content)""")
def java_chunks(spark, t):
    return java.table(shop(spark), "chunk").select("element_name", "class_name", "chunk_type", "start_line", "end_line", "content")


@query("""SELECT * FROM (VALUES ('com.acme.shop.Shop.sell(String,int)', 'id', 'PARAMETER', 'METHOD_ARG'), ('com.acme.shop.Shop.sell(String,int)', 'count', 'PARAMETER', 'CONDITION'), ('com.acme.shop.Shop.sell(String,int)', 'price', 'LOCAL_DECL,ASSIGNMENT', 'RETURN_VALUE'), ('com.acme.shop.Shop.sell(String,int)', 'i', '', 'CONDITION,METHOD_ARG'),
('com.acme.shop.Shop.sell(String,int)', 'repo', '', 'ASSIGNMENT_RHS')) v(method_qn, var, defs, uses)""")
def java_flow_summary(spark, t):
    f = shop(spark)
    got = java.flow_summary(java.table(f, "def"), java.table(f, "use")).filter("method_qn LIKE '%.sell(%'")
    kinds = lambda c: F.array_join(F.coalesce(F.transform(c, lambda x: x["type"]), F.array().cast("array<string>")), ",").alias(c)
    return got.select("method_qn", "var", kinds("defs"), kinds("uses"))


@query("SELECT tag, n FROM (VALUES ('class', 5), ('method', 11), ('chunk', 5), ('unread', 1)) v(tag, n)")
def java_totals(spark, t):
    return stats.count_by(shop(spark).filter("tag IN ('class', 'method', 'chunk', 'unread')"), "tag")
