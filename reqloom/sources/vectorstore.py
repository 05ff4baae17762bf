"""A vector store as a folder of Parquet files: add, query with metadata filters, scan, count, reset, rebuild.

Rows: id, text, embedding, metadata (map of text values). Adding an id again replaces it: the last write wins when the
store is read. Metadata values are text: lists become JSON, null becomes ''. Queries are batches of questions and exact.

Filters are dicts: {"key": value}, {"key": {"$eq" | "$ne" | "$in" | "$nin": ...}}, {"$and": [...]}, {"$or": [...]}; a key
that a row lacks equals nothing (and differs from everything). Unknown operators raise ValueError. An empty store answers
with no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reqloom.operators.retrieval import vector_search
from reqloom.sources.tables import Scratch

SCHEMA = "id string, text string, embedding array<float>, metadata map<string,string>, written bigint, batch string"


def metadata_map(df: DataFrame, cols: list[str]) -> Column:
    """The columns as a map of text: lists and structs as JSON, null as ''."""
    parts: list[Column] = []
    for c in cols:
        kind = df.schema[c].dataType
        nested = isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        parts += [F.lit(c), F.coalesce(F.to_json(F.col(c)) if nested else F.col(c).cast("string"), F.lit(""))]
    return F.create_map(*parts) if parts else F.create_map().cast("map<string,string>")


def metadata_value(c: Column, schema: str | None = None) -> Column:
    """A metadata value read back: JSON where it starts like a list or an object and `schema` says what it holds."""
    if schema is None:
        return c
    return F.when(F.substring(F.ltrim(c), 1, 1).isin("[", "{"), F.from_json(c, schema))


def condition(where: dict | None, metadata: str = "metadata") -> Column:
    """A filter as a column."""
    if not where:
        return F.lit(True)
    out = F.lit(True)
    for key, want in where.items():
        if key in ("$and", "$or"):
            parts = [condition(w, metadata) for w in want]
            if not parts:
                raise ValueError(f"{key} of nothing")
            one = parts[0]
            for p in parts[1:]:
                one = (one & p) if key == "$and" else (one | p)
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        else:
            have = F.try_element_at(F.col(metadata), F.lit(key))
            ops = want if isinstance(want, dict) else {"$eq": want}
            one = F.lit(True)
            for op, v in ops.items():
                if op in ("$eq", "$ne"):
                    same = F.coalesce(have == F.lit(str(v)), F.lit(False))
                elif op in ("$in", "$nin"):
                    same = F.coalesce(have.isin([str(x) for x in v]), F.lit(False)) if v else F.lit(False)
                else:
                    raise ValueError(f"unknown operator {op}")
                one = one & (~same if op in ("$ne", "$nin") else same)
        out = out & one
    return out


class VectorStore:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._p = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _rows(self) -> DataFrame:
        if not self._fs.exists(self._p):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def add(self, df: DataFrame, metadata: list[str] = ()) -> None:
        """df: id, text, embedding and the columns to keep as metadata. One atomic write of part files; later writes win."""
        now = self._rows().agg(F.coalesce(F.max("written"), F.lit(0))).first()[0] + 1
        out = df.select(F.col("id").cast("string").alias("id"), "text", F.col("embedding").cast("array<float>").alias("embedding"), metadata_map(df, list(metadata)).alias("metadata"), F.lit(now).cast("bigint").alias("written"), F.lit(uuid.uuid4().hex).alias("batch"))
        out.write.mode("append").parquet(self.path)

    def get_all(self) -> DataFrame:
        """id, text, metadata, embedding: the last version of every id."""
        r = self._rows()
        v = F.max_by(F.struct("text", "metadata", "embedding"), F.struct("written", "batch"))
        return r.groupBy("id").agg(v.alias("v")).select("id", "v.text", "v.metadata", "v.embedding")

    def count(self) -> int:
        return self._rows().agg(F.countDistinct("id")).first()[0]

    def reset(self) -> None:
        self._fs.delete(self._p, True)

    def build(self, df: DataFrame, metadata: list[str] = ()) -> bool:
        """Builds the store anew unless it holds as many ids already; whether it was built."""
        if self.count() == df.select("id").distinct().count() and self._fs.exists(self._p):
            return False
        self.reset()
        self.add(df, metadata)
        return True

    def query(self, asked: DataFrame, k: int, where: dict | None = None, metric: str = "cosine") -> DataFrame:
        """asked: qid, embedding. qid, id, distance, rank: the exact k nearest of the rows that the filter lets through."""
        if metric not in ("cosine", "l2", "ip"):
            raise ValueError(f"unknown metric {metric}")
        # the grid of blocks works on numbers: ids and questions get one by their order
        rows = self._numbered(self.get_all().where(condition(where) & F.col("embedding").isNotNull()).select("id", "embedding"), "id")
        asks = self._numbered(asked.select("qid", "embedding").where("embedding is not null"), "qid")
        shape = lambda df: df.select(F.col("n").alias("vec_id"), "embedding", F.lit(0).alias("label"))
        hits = vector_search(shape(rows), shape(asks), k, metric).select(F.col("qid").alias("q"), "vec_id", "distance", "rank")
        named = hits.join(rows.select(F.col("n").alias("vec_id"), "id"), "vec_id").join(asks.select(F.col("n").alias("q"), "qid"), "q")
        return named.select("qid", "id", "distance", "rank")

    def _numbered(self, df: DataFrame, by: str) -> DataFrame:
        """A number for each row in the order of `by`: ranges are sorted, counted, and each starts after those before it."""
        tmp = Scratch(self.spark)
        parts = tmp.save(df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("at", F.monotonically_increasing_id()))
        part = F.shiftright("at", 33)
        sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("c"))
        before = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
        return tmp.save(parts.withColumn("part", part).join(before.select("part", "before"), "part").withColumn("n", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("part", "at", "before"))
