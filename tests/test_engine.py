"""A small repository from files to answers."""

import datetime

from codeloom.plans import engine


def test_engine(spark, tmp_path):
    repo = tmp_path / "repo"
    repo.mkdir()
    order = """package shop; @Service public class OrderService { private shop.PayService pay;
      /** Creates an order and charges it. */
      @PostMapping("/orders") public String createOrder(String id) {
        if (id == null) { return null; }
        pay.charge(id);
        return id;
      } }"""
    (repo / "OrderService.java").write_text(order)
    (repo / "application.yml").write_text("server:\n  port: 80\n")
    (repo / "README.md").write_text("## Orders\nhow orders are created\n")
    clock = [datetime.datetime(2024, 1, 1)]
    e = engine.Engine(spark, f"file://{tmp_path}/store", chat=lambda system, user: f"{system.split('.')[0]} | {len(user) > 0}", now=lambda: clock[0])
    assert e.services() == [] and e.retrieve("orders", "shop") == [] and e.delete("shop") is None
    first = e.ingest(f"file://{repo}", "shop")
    assert (first["strategy"], first["chunks"], first["classes"], first["methods"], first["unread"]) == ("FRESH", 4, 1, 1, 0) and e.service("shop")["status"] == "ACTIVE"
    assert e.ingest(f"file://{repo}", "shop")["total_changed"] == 0
    (repo / "README.md").write_text("## Orders\nother\n## Refunds\nwords about refunds\n")
    (repo / "application.yml").unlink()
    clock[0] += datetime.timedelta(minutes=1)
    again = e.ingest(f"file://{repo}", "shop")
    assert (again["strategy"], again["added"], again["modified"], again["deleted"], again["unchanged"]) == ("INCREMENTAL", 0, 1, 1, 1)
    assert e.table("shop", "chunk").groupBy("chunk_type").count().collect() and e.table("shop", "chunk").filter("chunk_type = 'CONFIG'").count() == 0
    assert e.service("shop")["ingested_at"] == datetime.datetime(2024, 1, 1)
    assert any("refunds" in r["content"] for r in e.retrieve("words about refunds", "shop"))
    q = e.query("show me all endpoint routes", "shop")
    assert q["intent"] == "FIND_ENDPOINTS" and [r["qualified_name"] for r in q["endpoints"]] == ["shop.OrderService.createOrder(String)"]
    a = e.ask("show me all endpoint routes", "shop")
    assert a["synthesized"] and a["answer"].startswith("You answer questions")
    b = e.ask("unit test coverage", "shop", a["session_id"], "SHORT")
    assert b["session_id"] == a["session_id"] and [t["query"] for t in e.history(a["session_id"])] == ["show me all endpoint routes", "unit test coverage"]
    clock[0] += datetime.timedelta(minutes=31)
    c = e.ask("callers of createOrder", "shop", a["session_id"])
    assert c["session_id"] != a["session_id"] and "Read as: trace callers" in c["answer"]
    none = engine.Engine(spark, f"file://{tmp_path}/store").ask("xyzzy", "nowhere")
    assert none["answer"] == engine.FALLBACK and not none["synthesized"]
    assert e.ingest(f"file://{repo}", "shop", force=True)["strategy"] == "FORCE_FULL"
    gone = e.delete("shop")
    assert gone["methods"] == 1 and gone["classes"] == 1 and e.services() == [] and e.table("shop", "chunk") is None and e.delete("shop") is None


def test_many_ingestions_equal_one(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(engine, "MOST_VERSIONS", 3)
    repo = tmp_path / "build" / "repo"  # a folder above the repository is not pruned
    repo.mkdir(parents=True)
    body = lambda k, v: f"class C{k} {{ int f{k}(int a) {{ if (a > {v}) {{ return g(a); }} return a; }} }}"
    for k in range(4):
        (repo / f"C{k}.java").write_text(body(k, 0))
    (repo / "target").mkdir()
    (repo / "target" / "Gone.java").write_text(body(9, 9))
    (repo / "Bad.java").write_text("class {")
    e = engine.Engine(spark, f"file://{tmp_path}/store")
    assert e.ingest(f"file://{repo}", "s")["unread"] == 1
    assert e.table("s", "unread").first().reason.startswith("SyntaxProblem")
    for v in range(1, 6):
        (repo / f"C{v % 3}.java").write_text(body(v % 3, v))
        if v == 2:
            (repo / "C3.java").unlink()
        if v == 4:
            (repo / "C3.java").write_text(body(3, v))
        got = e.ingest(f"file://{repo}", "s")
        assert (got["added"], got["modified"], got["deleted"]) == (int(v == 4), 1, int(v == 2))
    other = engine.Engine(spark, f"file://{tmp_path}/other")
    other.ingest(f"file://{repo}", "s")
    for name in ("class", "method", "edge", "cfg_node", "cfg_edge", "def", "use", "unread", "fingerprint"):
        rows = [sorted(map(str, x.table("s", name).collect())) for x in (e, other)]
        assert rows[0] == rows[1], name
    ids = [sorted(r.vec_id for r in x.table("s", "chunk").collect()) for x in (e, other)]
    assert ids[0] == ids[1]
    row = e.service("s")
    assert row["version"] - row["base"] < 3
    e.mark("s", "INGESTING")
    assert e.service("s")["status"] == "INGESTING"
    assert {p.name for p in (tmp_path / "store").glob("data/s/facts/*/tag=edge/*")} == {"kind=CALLS", "kind=DEFINES"}


def test_blank_questions_are_errors(spark, tmp_path):
    import pytest

    e = engine.Engine(spark, f"file://{tmp_path}/store")
    for call in (lambda: e.ask(" ", "s"), lambda: e.ask("q", ""), lambda: e.query("", "s")):
        with pytest.raises(ValueError):
            call()
    assert e.history("nothing") == []
