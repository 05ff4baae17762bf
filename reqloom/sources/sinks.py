"""Sinks: graph files, audit CSV, text reports, artifact JSON, and an append-only store with retention."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reqloom.sources.documents import read_xlsx


def xml_escape(c):
    return F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as ordered lines (part, value): header, nodes, edges, footer. Lists and structs are JSON text."""

    def data(df: DataFrame, skip: set[str]):
        cols = [(c, t) for c, t in df.dtypes if c not in skip]
        text = lambda c, t: F.to_json(c) if t.startswith(("array", "struct", "map")) else F.col(c).cast("string")
        return F.concat_ws("", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{c}">'), xml_escape(text(c, t)), F.lit("</data>"))) for c, t in cols])

    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), xml_escape(F.col("id")), F.lit('">'), data(nodes, {"id"}), F.lit("</node>")).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), xml_escape(F.col("src")), F.lit('" target="'), xml_escape(F.col("dst")), F.lit('">'), data(edges, {"src", "dst"}), F.lit("</edge>")).alias("value"))
    spark = nodes.sparkSession
    keys = "".join(f'<key id="{c}" for="{k}" attr.name="{c}" attr.type="string"/>' for k, df, skip in (("node", nodes, {"id"}), ("edge", edges, {"src", "dst"})) for c in df.columns if c not in skip)
    ends = spark.createDataFrame([(0, f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    return n.unionByName(e).unionByName(ends)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One file per task, in order of their names; concatenated they are one GraphML document."""
    graphml_lines(nodes, edges).repartitionByRange("part", "value").sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def write_node_link(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.withColumnsRenamed({"src": "source", "dst": "target"}).write.mode("overwrite").json(f"{path}/links")


def write_audit_csv(df: DataFrame, path: str) -> None:
    """Audit rows with two blank columns for the reviewer."""
    df.withColumn("correct_section", F.lit("")).withColumn("reviewer_note", F.lit("")).write.mode("overwrite").option("header", True).csv(path)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from CSV: header in any case, comma lists split, trimmed and without blanks."""
    return _question_lists(spark.read.option("header", True).csv(path))


def read_question_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation questions from the first sheet with content of an .xlsx workbook (a small file, read on the driver)."""
    data = bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])
    t = next((b for b in read_xlsx(data) if b["type"] == "table"), None)
    if t is None:
        return spark.createDataFrame([], "question string")
    head = [(h or "").strip() for h in t["headers"]]
    rows = [tuple((r + [""] * len(head))[: len(head)]) for r in t["rows"]]
    return _question_lists(spark.createDataFrame(rows, ", ".join(f"`{h or f'c{i}'}` string" for i, h in enumerate(head))))


def _question_lists(df: DataFrame) -> DataFrame:
    df = df.toDF(*[c.strip().lower() for c in df.columns])
    lists = [c for c in df.columns if c.startswith("expected_")]
    return df.withColumns({c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "") for c in lists})


class EventStore:
    """An append-only parquet table, partitioned by day, with latest-version reads and retention by whole days.

    Appends are atomic per job; a row's version is its (ts, seq). Nothing is updated in place.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: list[tuple] | DataFrame) -> None:
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, self.schema)
        df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(f"{self.schema}, day date").parquet(self.path).drop("day")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def latest(self, key: str) -> DataFrame:
        df = self.read()
        rest = [c for c in df.columns if c != key]
        order = F.struct("ts", *[c for c in ("seq",) if c in df.columns])
        return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, *[F.col(f"v.{c}").alias(c) for c in rest])

    def retain(self, since: dt.datetime) -> int:
        """Drops the day partitions that end before `since`; returns how many."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        gone = 0
        for s in fs.listStatus(path) if fs.exists(path) else []:
            name = s.getPath().getName()
            if name.startswith("day=") and name[4:] < since.date().isoformat():
                fs.delete(s.getPath(), True)
                gone += 1
        return gone


class JobStore:
    """Jobs as events: submit, status changes (terminal states are sticky), cancel, logs with running line numbers."""

    STATUSES = ("submitted", "running", "completed", "failed", "cancelled")
    TERMINAL = ("completed", "failed", "cancelled")

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.events = EventStore(spark, f"{path}/events", "job_id string, ts timestamp_ntz, seq long, status string, progress int, message string")
        self.logs = EventStore(spark, f"{path}/logs", "job_id string, ts timestamp_ntz, seq long, message string")
        self.spark, self.path = spark, path

    def _end(self, job_id: str) -> bool:
        """Claims the job's end: an exclusive file of its own, so of several callers one gets True."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.path}/ended/{hashlib.sha256(job_id.encode()).hexdigest()}")
        fs = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(where.getParent())
        if fs.getUri().getScheme() == "file":  # its Hadoop form looks first and creates then; the system call does both at once
            try:
                os.close(os.open(where.toUri().getPath(), os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            fs.create(where, False).close()
            return True
        except Exception as e:  # noqa: BLE001
            if "FileAlreadyExists" not in str(e):
                raise
            return False

    def submit(self, job_id: str, at: dt.datetime) -> None:
        self.events.append([(job_id, at, 0, "submitted", 0, None)])

    def update(self, job_id: str, at: dt.datetime, status: str, progress: int | None = None, message: str | None = None) -> None:
        if status not in self.STATUSES:
            raise ValueError(f"no such status: {status}")
        if status in self.TERMINAL:
            self._end(job_id)
        self.events.append([(job_id, at, 1, status, progress, message)])

    def cancel(self, job_id: str, at: dt.datetime) -> bool:
        """Only a job that has not ended can be cancelled, and only one of several callers cancels it."""
        now = self.states().where(F.col("job_id") == job_id).select("status").head()
        if now is None or now[0] in self.TERMINAL or not self._end(job_id):
            return False
        self.events.append([(job_id, at, 1, "cancelled", None, None)])
        return True

    def states(self) -> DataFrame:
        e = F.struct("ts", "seq")
        end = F.col("status").isin(*self.TERMINAL)
        return self.events.read().groupBy("job_id").agg(
            F.coalesce(F.min_by("status", F.when(end, e)), F.max_by("status", e)).alias("status"), F.min("ts").alias("created_at"),
            F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"), F.min(F.when(end, F.col("ts"))).alias("completed_at"), F.max("progress").alias("progress"),
        )

    def log(self, job_id: str, at: dt.datetime, messages: list[str]) -> None:
        self.logs.append([(job_id, at, i, m) for i, m in enumerate(messages)])

    def lines(self, job_id: str, after: int = 0) -> DataFrame:
        from pyspark.sql import Window

        rows = self.logs.read().where(F.col("job_id") == job_id)
        n = F.row_number().over(Window.partitionBy("job_id").orderBy("ts", "seq"))
        return rows.select(n.alias("line_number"), "ts", "message").where(F.col("line_number") > after)


class FeedbackStore:
    """Feedback as events: a row once, votes after it; the last vote counts. Votes are up, down or none."""

    VOTES = ("up", "down", None)

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = EventStore(spark, f"{path}/feedback", "id string, ts timestamp_ntz, page_section string, question string, answer string, citations_json string, llm_model string, query_elapsed_ms long")
        self.votes = EventStore(spark, f"{path}/votes", "id string, ts timestamp_ntz, seq long, vote string, free_form_feedback string")

    def insert(self, id_: str, at: dt.datetime, page_section: str, question: str, answer: str, citations: list | None = None, llm_model: str | None = None, elapsed_ms: int | None = None) -> None:
        self.rows.append([(id_, at, page_section, question, answer, json.dumps(citations or []), llm_model, elapsed_ms)])

    def vote(self, id_: str, at: dt.datetime, vote: str | None, comment: str | None = None, seq: int = 0) -> None:
        if vote not in self.VOTES:
            raise ValueError(f"no such vote: {vote}")
        self.votes.append([(id_, at, seq, vote, comment)])

    def read(self, page_section: str | None = None) -> DataFrame:
        """Every row with its last vote and comment, newest first."""
        r = self.rows.latest("id")
        if page_section is not None:
            r = r.where(F.col("page_section") == page_section)
        v = self.votes.latest("id").select("id", "vote", "free_form_feedback")
        return r.join(v, "id", "left").orderBy(F.desc("ts"), F.desc("id"))


class MetricStore:
    """Metric events with JSON tags; helpers for the four kinds that are measured."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.events = EventStore(spark, path, "ts timestamp_ntz, seq long, category string, name string, value double, unit string, tags string")

    def emit(self, at: dt.datetime, rows: list[tuple[str, str, float, str | None, dict | None]]) -> None:
        """rows: category, name, value, unit, tags."""
        self.events.append([(at, i, c, n, float(v), u, json.dumps(t or {}, sort_keys=True)) for i, (c, n, v, u, t) in enumerate(rows)])

    def request(self, at: dt.datetime, endpoint: str, status: int, ms: float) -> None:
        self.emit(at, [("request", "latency", ms, "ms", {"endpoint": endpoint, "status": status})])

    def stage(self, at: dt.datetime, stage: str, seconds: float, **counts: float) -> None:
        self.emit(at, [("stage", "duration", seconds, "s", {"stage": stage}), *[("stage", k, v, None, {"stage": stage}) for k, v in sorted(counts.items())]])

    def model(self, at: dt.datetime, name: str, ms: float, tokens: int) -> None:
        self.emit(at, [("llm", "latency", ms, "ms", {"model": name}), ("llm", "tokens", tokens, None, {"model": name}), ("llm", "tokens_per_second", round(tokens * 1000 / ms, 2) if ms else 0.0, None, {"model": name})])

    def resource(self, at: dt.datetime, used: int, total: int, busy_pct: float | None = None) -> None:
        """Memory in bytes is kept in GB with one decimal, and as a share."""
        rows = [("resource", "memory_gb", gigabytes(used), "GB", None), ("resource", "memory_pct", round(100 * used / total, 1) if total else 0.0, "%", None)]
        self.emit(at, rows + ([("resource", "cpu_pct", busy_pct, "%", None)] if busy_pct is not None else []))


def gigabytes(n: int) -> float:
    return round(n / 1024**3, 1)


def with_corrections(output: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """A correction's row wins over the output's row of the same key; corrections of new keys are added."""
    fixed = corrections.select(*output.columns)
    return output.join(fixed.select(key), key, "left_anti").select(*output.columns).unionByName(fixed)
