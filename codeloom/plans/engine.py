"""Services as append-only tables in a folder: ingest, list, delete, retrieve, query, ask, history.

    registry/                                     an event a row; the last one of a service holds
    data/<service>/files/v=<n>/                   path and hash of the files that ingestion n found new, changed or gone (null)
    data/<service>/facts/v=<n>/tag=<table>/kind=<type>/   rows of those files
    turns/bucket=<b>/                             a row a turn of a session

An ingestion writes what changed and nothing else: its facts, then its files, then the registry row that makes it count, each by
one job. A row is current if no later ingestion names its path. Tables are partitioned by name and by chunk type or edge kind, so
a search by type or a walk along one kind of edge reads its own folder. After MOST_VERSIONS ingestions the current rows are
written anew as one. Embedding, judge and chat are functions of the caller; without them a hashed embedding serves, re-ranking is
by rules alone and answers are the fallback.
"""

from __future__ import annotations

import datetime
import time
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import embed as E
from codeloom.operators import context, incremental, intent, maintain, memory, retrieve
from codeloom.sources import java, scan

REGISTRY = "service_name string, repo_path string, status string, ingested_at timestamp, last_updated_at timestamp, file_count long, base int, version int, seq long"
TURNS = "session_id string, service_name string, n int, turn_index int, query string, intent string, answer_summary string, verbosity string, answer string, embedding array<float>, at timestamp, bucket int"
FILES = "src_path string, sha256 string, v int"
CHUNK = java.SCHEMAS["chunk"] + ", vec_id string, embedding array<float>"
FACTS = "src_path string, " + ", ".join(f"`{t}` struct<{(CHUNK if t == 'chunk' else s).replace(' ', ': ').replace(',: ', ', ')}>" for t, s in java.SCHEMAS.items()) + ", v int, tag string, kind string"
FLAGS = ["is_endpoint", "is_transactional", "is_scheduled", "is_event_handler", "has_throws_doc", "is_doc_chunk"]
#: Ingestions after which a service's rows are written anew, changed files that are opened by name, and folders of turns.
MOST_VERSIONS, BY_NAME, BUCKETS = 16, 2000, 64
#: A result row's own sentences.
FALLBACK = "Nothing in the ingested code answers this. Check that the service has been ingested, or ask in other words."
FOOTER = "\n\n---\nRead as: {intent}. If that is not what you meant, ask more precisely."
VERBOSITY = {"SHORT": "Answer in one or two sentences.", "DETAILED": "Explain step by step and name the classes and methods that you rely on.", "DEEP_DIVE": "Explain step by step, name classes and methods, and go through edge cases, failure paths and side effects."}
#: What an answer to each intent should dwell on.
GUIDES = {
    "FIND_IMPLEMENTATION": "Say where it is implemented and what the code does.", "TRACE_CALL_CHAIN": "Follow the calls in order.", "TRACE_CALLERS": "List who calls it and why.", "IMPACT_ANALYSIS": "List what depends on it and what may break.",
    "FIND_CONFIGURATION": "Give the keys and values that configure it.", "UNDERSTAND_CONTRACT": "State the contract and who fulfils it.", "DEBUG_ERROR": "Name the likely cause and where to look.", "NULL_SAFETY": "Say where nulls are checked and where they are not.",
    "UNDERSTAND_BUSINESS_RULE": "State the rule and its reason.", "FIND_TESTS": "List the tests and what they cover.", "FIND_ENDPOINTS": "List verbs, paths and handlers.", "GENERAL_UNDERSTANDING": "Give an overview.",
}


PROMPT = "You answer questions about source code from the given context only. "


def prompt(name: Column, verbosity: Column) -> Column:
    """The system prompt: short answers get the short instruction only; others the intent's guide too."""
    of = lambda values, key: F.coalesce(F.get(F.transform(F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in values.items()]), lambda e: e["k"] == key), lambda e: e["v"]), F.lit(0)), F.lit(""))
    return F.concat(F.lit(PROMPT), F.when(verbosity == "SHORT", "").otherwise(F.concat(of(GUIDES, name), F.lit(" "))), of(VERBOSITY, verbosity))


def system_prompt(name: str, verbosity: str) -> str:
    """`prompt` for one question."""
    return PROMPT + ("" if verbosity == "SHORT" else GUIDES.get(name, "") + " ") + VERBOSITY[verbosity]


def answered(answer: Column, has_context: Column) -> Column:
    """struct(answer, synthesized): the fallback where there was nothing to answer from, or no answer came."""
    ok = F.coalesce(has_context, F.lit(False)) & answer.isNotNull()
    return F.struct(F.when(ok, answer).otherwise(FALLBACK).alias("answer"), ok.alias("synthesized"))


@dataclass
class Engine:
    spark: SparkSession
    root: str
    embed: Callable[[str], Sequence[float]] = E.vector
    embed_column: Callable = E.embedded
    judge: Callable[[DataFrame], DataFrame] | None = None
    chat: Callable[[str, str], str] | None = None
    now: Callable[[], datetime.datetime] = field(default=lambda: datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None))

    # -- files

    def _path(self, *parts: str) -> str:
        return "/".join([self.root.rstrip("/"), *parts])

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        p, fs = self._fs(path)
        return fs.exists(p)

    def _append(self, name: str, schema: str, row: dict, by: list[str] | None = None) -> None:
        """One row more; writers do not disturb one another."""
        out = self.spark.createDataFrame([row], schema).coalesce(1).write.mode("append")
        (out.partitionBy(*by) if by else out).parquet(self._path(name))

    # -- registry

    def _registry(self, where=None) -> DataFrame | None:
        """The last event of every service that is not deleted."""
        if not self._exists(self._path("registry")):
            return None
        rows = self.spark.read.schema(REGISTRY).parquet(self._path("registry"))
        return maintain.latest(rows if where is None else rows.filter(where), "service_name", "seq", "DELETED")

    def services(self) -> list[dict]:
        """The newest first."""
        rows = self._registry()
        return [] if rows is None else [r.asDict() for r in rows.orderBy(F.col("ingested_at").desc(), "service_name").collect()]

    def service(self, name: str) -> dict | None:
        rows = self._registry(F.col("service_name") == name)
        row = None if rows is None else rows.first()
        return row.asDict() if row else None

    def _register(self, name: str, old: dict | None, **values) -> dict:
        new = {"service_name": name, "repo_path": None, "status": None, "ingested_at": self.now(), "file_count": 0, "base": 0, "version": 0} | (old or {}) | values
        new |= {"last_updated_at": self.now(), "seq": time.time_ns()}
        self._append("registry", REGISTRY, new)
        return new

    def mark(self, service: str, status: str) -> None:
        """INGESTING, ACTIVE, DELETING or ERROR, for callers that do more than one step."""
        row = self.service(service)
        if row:
            self._register(service, row, status=status)

    # -- tables of a service

    def _read(self, service: str, part: str, schema: str, row: dict) -> DataFrame:
        """All that counts of a service's files or facts."""
        at = self._path("data", service, part)
        versions = [f"{at}/v={k:06d}" for k in range(row["base"], row["version"] + 1)]
        return self.spark.read.schema(schema).option("basePath", at).parquet(*[v for v in versions if self._exists(v)])

    def _current_files(self, service: str, row: dict) -> DataFrame:
        rows = self._read(service, "files", FILES, row)
        if row["base"] < row["version"]:
            rows = rows.groupBy("src_path").agg(F.max_by("sha256", "v").alias("sha256"), F.max("v").alias("v"))
        return rows.filter("sha256 IS NOT NULL")

    def _current(self, service: str, row: dict, name: str | None = None) -> DataFrame:
        rows = self._read(service, "facts", FACTS, row)
        rows = rows if name is None else rows.filter(F.col("tag") == name)
        if row["base"] == row["version"]:
            return rows
        # what later ingestions name is as small as the changes
        later = self._read(service, "files", FILES, row).filter(F.col("v") > row["base"]).groupBy(F.col("src_path").alias("_p")).agg(F.max("v").alias("_v"))
        return rows.join(later, F.col("src_path") == F.col("_p"), "left").filter("_v IS NULL OR v = _v").drop("_p", "_v")

    def table(self, service: str, name: str) -> DataFrame | None:
        """One of java.SCHEMAS, `fingerprint`, or None for a service that is not there."""
        row = self.service(service)
        if row is None or not row["version"]:
            return None
        if name == "fingerprint":
            return self._current_files(service, row).select("src_path", "sha256")
        rows = self._current(service, row, name).select("src_path", f"{name}.*")
        return rows.select("*", *[F.col("extra")[k].alias(k) for k in FLAGS]) if name == "chunk" else rows

    def _facts(self, files: DataFrame, service: str) -> DataFrame:
        """Rows of all tables in one pass over the files; those of unread files say why."""
        rows = java.facts(files.filter(F.col("path").endswith(".java")), service).select(F.col("path").alias("src_path"), "tag", "row")
        plain = scan.chunks(files, service)
        fields = ["service_name", "path", "element_name", F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), "content", "chunk_type"]
        rows = rows.unionByName(plain.select(F.col("path").alias("src_path"), F.lit("chunk").alias("tag"), F.to_json(F.struct(*fields)).alias("row")))
        rows = rows.select("src_path", "tag", *[F.when(F.col("tag") == t, F.from_json("row", s)).alias(t) for t, s in java.SCHEMAS.items()])
        vec_id = F.concat_ws("#", "src_path", "chunk.element_name", "chunk.start_line", F.substring(F.sha2("chunk.content", 256), 1, 8)).alias("vec_id")
        text = F.when(F.col("tag") == "chunk", F.concat_ws(" ", "chunk.class_name", "chunk.element_name", "chunk.content"))
        rows = rows.withColumn("_e", self.embed_column(text))
        chunk = F.when(F.col("tag") == "chunk", F.struct("chunk.*", vec_id, F.col("_e").cast("array<float>").alias("embedding"))).alias("chunk")
        kind = F.when(F.col("tag") == "chunk", F.col("chunk.chunk_type")).when(F.col("tag") == "edge", F.col("edge.kind")).otherwise("all")
        return rows.select("src_path", *[chunk if t == "chunk" else t for t in java.SCHEMAS], "tag", kind.alias("kind"))

    def _write(self, service: str, part: str, version: int, rows: DataFrame) -> None:
        out = rows.write.mode("overwrite")  # of a lost attempt
        (out.partitionBy("tag", "kind") if part == "facts" else out).parquet(self._path("data", service, part, f"v={version:06d}"))

    def ingest(self, repo: str, service: str, force: bool = False) -> dict:
        """Read a repository: all of it the first time or by force, else the files whose hashes have changed."""
        row = self.service(service)
        how = incremental.FRESH if row is None or not row["version"] else incremental.FORCE_FULL if force else incremental.INCREMENTAL
        version, files = (row["version"] if row else 0) + 1, scan.repository(self.spark, repo)
        if how == incremental.INCREMENTAL:
            return self._ingest_changes(repo, service, row, files, version)
        self._write(service, "facts", version, self._facts(files, service))
        self._write(service, "files", version, incremental.fingerprints(files).withColumnRenamed("path", "src_path"))
        new = self._register(service, row, repo_path=repo, status="ACTIVE", base=version, version=version)
        totals = self.totals(service, new)
        # the count of a registry row is that of chunks after a full ingestion, of changed files after an incremental one
        self._register(service, new, file_count=totals["chunks"])
        return {"strategy": how, **totals}

    def _ingest_changes(self, repo: str, service: str, row: dict, files: DataFrame, version: int) -> dict:
        now = incremental.fingerprints(files)
        stored = self._current_files(service, row).select(F.col("src_path").alias("path"), "sha256")
        changes = incremental.change_set(now, stored, keep=["sha256"]).persist()
        try:
            result = {"strategy": incremental.INCREMENTAL, **incremental.change_counts(changes).first().asDict()}
            if result["total_changed"]:
                renewed = changes.filter("status IN ('ADDED', 'MODIFIED')").select("path")
                n = result["added"] + result["modified"]
                some = scan.named(self.spark, [r["path"] for r in renewed.collect()]) if n <= BY_NAME else files.join(renewed, "path", "left_semi")
                if n:
                    facts = self._facts(some, service)
                    self._write(service, "facts", version, facts.coalesce(max(1, n // 50)) if n <= BY_NAME else facts)
                gone = changes.filter("status <> 'UNCHANGED'").select(F.col("path").alias("src_path"), F.when(F.col("status") != "DELETED", F.col("sha256")).alias("sha256"))
                self._write(service, "files", version, gone.coalesce(max(1, result["total_changed"] // 100_000)))
                row = row | {"version": version}
        finally:
            changes.unpersist()
        new = self._register(service, row, repo_path=repo, status="ACTIVE", file_count=result["total_changed"])
        if new["version"] - new["base"] >= MOST_VERSIONS:
            self.compact(service)
        return result

    def compact(self, service: str) -> None:
        """The current rows of a service as one version; readers of the old ones are not disturbed."""
        row = self.service(service)
        version = row["version"] + 1
        self._write(service, "facts", version, self._current(service, row).drop("v"))
        self._write(service, "files", version, self._current_files(service, row).drop("v"))
        self._register(service, row, base=version, version=version)

    def totals(self, service: str, row: dict | None = None) -> dict:
        """Rows of a service's tables by name, and the files that could not be read."""
        row = row or self.service(service)
        n = {r["tag"]: r["n"] for r in self._current(service, row).groupBy("tag").agg(F.count("*").alias("n")).collect()}
        names = {"chunks": "chunk", "classes": "class", "methods": "method", "edges": "edge", "flow_nodes": "cfg_node", "unread": "unread"}
        return {k: n.get(t, 0) for k, t in names.items()}

    def delete(self, service: str) -> dict | None:
        """Mark, drop the tables, remove from the registry; the rows of each table that went, or None for no service."""
        row = self.service(service)
        if row is None:
            return None
        counts = self.totals(service, row) if row["version"] else {}
        row = self._register(service, row, status="DELETING")
        p, fs = self._fs(self._path("data", service))
        fs.delete(p, True)
        self._register(service, row, status="DELETED")
        return counts

    def store(self, service: str) -> retrieve.Store:
        edges = self.table(service, "edge").withColumn("edge_id", F.xxhash64("kind", "src", "dst", "call_line"))
        return retrieve.Store(self.table(service, "chunk"), self.table(service, "method"), self.table(service, "class"), edges)

    # -- questions

    def retrieve(self, question: str, service: str, k: int = 8) -> list[dict]:
        if not question.strip() or self.service(service) is None:
            return []
        hits = retrieve.search(self.store(service), self.embed(question), service, k, threshold=0.0)
        return [{"content": r["content"], "chunk_type": r["chunk_type"], "element_name": r["element_name"]} for r in hits.collect()]

    def query(self, question: str, service: str) -> dict:
        """Classification and result rows; a blank question or service is an error."""
        if not question.strip() or not service.strip():
            raise ValueError("question and service must not be blank")
        c = intent.classify(self.spark.createDataFrame([(question,)], "question string"), "question").first()
        tables: dict[str, DataFrame] = {}
        if self.service(service) is not None:
            tables = retrieve.answer(self.store(service), question, self.embed, service)[1]
        parts = {k: df.drop("embedding") for k, df in tables.items()}
        rows = {k: [r.asDict(recursive=True) for r in df.collect()] for k, df in parts.items()}
        return {"intent": c["routed"], "confidence": c["confidence"], "tier": c["tier"], "total": sum(map(len, rows.values())), **rows}

    def _turns(self, session: str) -> DataFrame | None:
        """The turns of one session, from its folder."""
        if not self._exists(self._path("turns")):
            return None
        rows = self.spark.read.schema(TURNS).parquet(self._path("turns"))
        return rows.filter((F.col("bucket") == bucket_of(session)) & (F.col("session_id") == session))

    def _session(self, session: str | None, service: str) -> dict:
        """A session that goes on, or a new one: unknown, of another service, or idle too long."""
        rows = self._turns(session) if session else None
        last = [] if rows is None else rows.orderBy(F.col("n").desc()).limit(memory.HISTORY_CAP).drop("embedding", "answer").collect()
        if last and last[0]["service_name"] == service and self.now() - last[0]["at"] <= datetime.timedelta(minutes=30):
            return {"session_id": session, "n": last[0]["n"] + 1, "history": [r.asDict() for r in reversed(last)]}
        return {"session_id": str(uuid.uuid4()), "n": 0, "history": []}

    def _recalled(self, s: dict, question: str) -> list[dict]:
        """Turns like the question that are not among the last ones, then the last ones."""
        window = s["history"][-memory.WINDOW_TURNS :]
        if not s["history"]:
            return []
        rows = self._turns(s["session_id"])
        turns = memory.remembered(rows, "session_id", "turn_index", "n")
        near = retrieve.vector.topk(turns, self.embed(question), memory.RECALLED, key="turn_index").collect()
        seen = {t["query"] for t in window}
        return [{"query": r["query"], "answer_summary": memory_summary(r["answer"])} for r in near if r["query"] not in seen] + window

    def ask(self, question: str, service: str, session: str | None = None, verbosity: str = "DETAILED") -> dict:
        """An answer by the chat function from assembled context, and the turn kept in its session; a blank question or service is an
        error."""
        if not question.strip() or not service.strip():
            raise ValueError("question and service must not be blank")
        s, found = self._session(session, service), self.query(question, service)
        history = self._recalled(s, question)
        text, synthesized = FALLBACK, False
        if (found["total"] or history) and self.chat is not None:
            try:
                text, synthesized = self.chat(system_prompt(found["intent"], verbosity), f"Question: {question}\n\nContext:\n{self.context(found, history)}"), True
            except Exception as e:  # noqa: BLE001  whatever the model's client raises, the fallback is the answer
                found["error"] = str(e)
        if found["tier"] == "MEDIUM":
            text += FOOTER.format(intent=found["intent"].replace("_", " ").lower())
        # the index stays at the cap once that is reached, and then the last turn replaces the one before
        turn = {"session_id": s["session_id"], "service_name": service, "n": s["n"], "turn_index": min(s["n"], memory.HISTORY_CAP), "query": question, "intent": found["intent"], "answer_summary": memory_summary(text), "verbosity": verbosity, "answer": text}
        turn |= {"embedding": [float(x) for x in self.embed(f"Q: {question}\nA: {text}")], "at": self.now(), "bucket": bucket_of(s["session_id"])}
        self._append("turns", TURNS, turn, ["bucket"])
        return {"answer": text, "synthesized": synthesized, "session_id": s["session_id"], "intent": found["intent"], "confidence": found["confidence"], "total": found["total"]}

    def history(self, session: str) -> list[dict]:
        rows = self._turns(session)
        if rows is None:
            return []
        last = rows.orderBy(F.col("n").desc()).limit(memory.HISTORY_CAP).select("query", "intent", "answer_summary", "verbosity").collect()
        return [r.asDict() for r in reversed(last)]

    def context(self, found: dict, history: list[dict]) -> str:
        method = "rank int, class_name string, simple_name string, is_endpoint boolean, http_method string, endpoint_path string"
        frame = lambda rows, schema: self.spark.createDataFrame([{**{k.split()[0]: None for k in schema.split(", ")}, **r, "rank": i} for i, r in enumerate(rows)], schema)
        names = lambda rows: [{"class_name": (p := r["qualified_name"].split("(")[0].rsplit(".", 2))[-2] if r["qualified_name"].count(".") else "", "simple_name": p[-1] if r["qualified_name"].count(".") else r["qualified_name"], **{k: r.get(k) for k in ("is_endpoint", "http_method", "endpoint_path")}} for r in rows]
        chunk = "rank int, class_name string, element_name string, chunk_type string, content string"
        pick = lambda rows, schema: [{k.split()[0]: r.get(k.split()[0]) for k in schema.split(", ")} for r in rows]
        return context.assemble(
            frame([{"query": t["query"], "answer": t["answer_summary"]} for t in history], "rank int, query string, answer string"), frame(pick(found.get("chunks", []), chunk), chunk), frame(names(found.get("call_chain", [])), method), frame(names(found.get("callers", [])), method),
            frame([{"simple_name": r["qualified_name"].rsplit(".", 1)[-1], "node_type": r.get("node_type")} for r in found.get("impacted", [])], "rank int, simple_name string, node_type string"), frame(names(found.get("endpoints", [])), method),
        ).first()["context"]


def bucket_of(session: str) -> int:
    return zlib.crc32(session.encode()) % BUCKETS


def memory_summary(answer: str | None) -> str:
    return (answer or "")[: memory.SUMMARY_CHARS]


__all__ = ["Engine", "system_prompt"]
