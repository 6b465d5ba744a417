"""Incremental index build and latest states as Structured Streaming jobs.

Streams read files as they appear and stop when all are read (``availableNow``); state and
progress live in the shared scratch folder, so a lost executor or a stopped driver resumes.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern import scratch

_INDEX = "doc_id long, chunk_key string, size long"
_STATES = "user_id long, ts timestamp, event_id long, event_type string, n long"


def fresh_name(kind: str) -> str:
    return f"{kind}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the Parquet files of a table, which may be one file or a folder of them."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    if spark.read.format("binaryFile").load(path).select("path").first()["path"].rstrip("/").endswith(f"/{name}"):
        return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 32).parquet(path)


def _has(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def _rows(spark: SparkSession, index: str) -> DataFrame | None:
    if not _has(spark, f"{index}/data"):
        return None
    return spark.read.schema(f"{_INDEX}, generation int, batch long, bucket int").parquet(f"{index}/data")


#: Folders that the index rows of a batch are dealt to by document: a batch reads those of its own documents alone.
BUCKETS = 64


def _bucket() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).cast("int").alias("bucket")


def read_index(spark: SparkSession, index: str, of: DataFrame | None = None) -> DataFrame:
    """Current rows of the index (of the documents ``of``(doc_id) alone, if given): each document's last, but for removed ones."""
    rows = _rows(spark, index)
    if rows is None:
        return spark.createDataFrame([], _INDEX)
    if of is not None:
        buckets = [r["bucket"] for r in of.select(_bucket()).distinct().collect()]  # BUCKETS numbers at most
        rows = rows.where(F.col("bucket").isin(buckets))
        rows = rows.join(of.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    last = rows.groupBy("doc_id").agg(F.max_by(F.struct("chunk_key", "size"), F.struct("generation", "batch")).alias("r"))
    return last.select("doc_id", "r.*").where("chunk_key IS NOT NULL")


def build(spark: SparkSession, source: str, index: str, settings: str, generation: int = 0) -> None:
    """Index documents whose key (settings and body, null as empty) the index does not hold.

    A batch writes to a folder of its own number, so a repeated batch replaces its first
    attempt. Documents whose key is current cost no work, and only the index rows of a
    batch's documents are compared. A changed source is a new ``generation``.
    """

    def add(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        body = F.coalesce("text", F.lit(""))
        wanted = batch.select("doc_id", F.sha2(F.concat(F.lit(settings + "\n"), body), 256).alias("chunk_key"), F.length(body).cast("long").alias("size"))
        held = read_index(s, index, batch).select(F.col("doc_id").alias("_id"), F.col("chunk_key").alias("_key"))
        new = wanted.join(held, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("chunk_key") == F.col("_key")), "left_anti")
        _put(new, index, generation, number)

    run = _stream(spark, source).writeStream.foreachBatch(add).option("checkpointLocation", f"{index}/progress-{generation}").trigger(availableNow=True).start()
    run.awaitTermination()


#: The numbers of the batch that removes, after all others of its generation, and of the one that holds all that is current.
REMOVAL, SNAPSHOT = (1 << 62) - 1, 1 << 62


def _put(rows: DataFrame, index: str, generation: int, batch: int) -> None:
    """Write a batch's rows, each bucket as a folder; a repeated batch replaces its first attempt."""
    dealt = rows.withColumn("bucket", _bucket()).repartition("bucket")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{index}/data/generation={generation}/batch={batch}")


def remove_absent(spark: SparkSession, source: str, index: str, generation: int = 0) -> None:
    """Mark documents that the source no longer has; repeated runs write the same folder."""
    present = spark.read.parquet(source).select(F.col("doc_id").alias("_id"))
    gone = read_index(spark, index).join(present, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")
    marks = gone.select("doc_id", F.lit(None).cast("string").alias("chunk_key"), F.lit(0).cast("long").alias("size"))
    _put(marks, index, generation, REMOVAL)


def compact(spark: SparkSession, index: str) -> None:
    """One folder of all current rows instead of those of every batch; the newest generation is closed by it.

    The rows are written before anything is deleted, and removals are deleted last, so
    readers see the same index at every moment. Later batches belong to a later generation.
    """
    rows = _rows(spark, index)
    newest = rows.agg(F.max(F.struct("generation", "batch")).alias("m")).first()["m"] if rows is not None else None
    if newest is None or newest["batch"] == SNAPSHOT:
        return
    _put(read_index(spark, index), index, newest["generation"], SNAPSHOT)
    older = [(r["generation"], r["batch"]) for r in rows.select("generation", "batch").distinct().collect() if tuple(r) != (newest["generation"], SNAPSHOT)]  # one a batch
    for generation, batch in sorted(older, key=lambda b: (b[1] == REMOVAL, b)):
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{index}/data/generation={generation}/batch={batch}")
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def refresh(spark: SparkSession, source: str, settings: str) -> DataFrame:
    """The index of ``source`` after one of an older state of it: some texts were others, and some documents are gone."""
    folder = f"{scratch.scratch_dir(spark)}/{fresh_name('index')}"
    docs = spark.read.parquet(source).select("doc_id", "text")
    changed = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("older "), "text")).otherwise(F.col("text"))
    older = docs.select("doc_id", changed.alias("text")).unionByName(docs.where("doc_id % 7 = 0").select((-1 - F.col("doc_id")).alias("doc_id"), "text"))
    older.write.parquet(f"{folder}-older")
    build(spark, f"{folder}-older", folder, settings)
    build(spark, source, folder, settings, generation=1)
    remove_absent(spark, source, folder, generation=1)
    compact(spark, folder)
    return read_index(spark, folder)


def crawl_states(spark: SparkSession, source: str, happened: dict[str, str]) -> DataFrame:
    """(user_id, state, n): the crawl state of each key and how many happenings led there, by a stateful stream.

    The state store holds one row a key; a batch's happenings are taken in the order of
    (ts, event_id), batches in the order of their arrival.
    """
    from quern.operators import crawl

    out = f"{scratch.scratch_dir(spark)}/{fresh_name('crawl')}"
    schema = "user_id long, state string, n long"

    def follow(key, parts, held):
        state, n = held.get if held.exists else (crawl.PENDING, 0)
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        state, n = crawl.follow(state, rows["happened"].tolist()), n + len(rows)
        held.update((state, n))
        yield pd.DataFrame({"user_id": [key[0]], "state": [state], "n": [n]})

    what = F.create_map(*(F.lit(x) for pair in happened.items() for x in pair))
    events = _stream(spark, source).select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", F.coalesce(F.try_element_at(what, F.col("event_type")), F.lit("")).alias("happened"))
    states = events.groupBy("user_id").applyInPandasWithState(follow, schema, "state string, n long", "update", "NoTimeout")
    put = lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/data/batch={number}")
    states.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(f"{schema}, batch long").parquet(f"{out}/data").groupBy("user_id").agg(F.max_by(F.struct("state", "n"), "batch").alias("s")).select("user_id", "s.*")


def latest_states(spark: SparkSession, source: str) -> DataFrame:
    """(user_id, state, n): the newest event of each user and how many were seen.

    The stream keeps one partial row a user and batch; a batch's aggregate is idempotent
    by its folder, and the fold over batches gives the answer.
    """
    out = f"{scratch.scratch_dir(spark)}/{fresh_name('states')}"

    def fold(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("user_id").agg(F.max_by(F.struct("ts", "event_id", "event_type"), F.struct("ts", "event_id")).alias("s"), F.count(F.lit(1)).alias("n"))
        last.select("user_id", "s.*", "n").write.mode("overwrite").parquet(f"{out}/data/batch={number}")

    events = _stream(spark, source).withColumn("ts", F.col("ts").cast("timestamp"))
    events.writeStream.foreachBatch(fold).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{_STATES}, batch long").parquet(f"{out}/data")
    return rows.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"), F.sum("n").alias("n"))
