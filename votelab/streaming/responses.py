"""ST1: incremental parsing of newly arrived LLM replies.

Replies land as files in a folder; a Structured Streaming query with the file source picks up each
file once (the checkpoint remembers what was read), parses the replies with the same native
expressions as the batch path (C9-C11, stateless) and adds long rows to a parquet sink, a folder a micro-batch. With
``trigger(availableNow=True)`` a run processes what is there and stops, so re-running after new
files arrive adds only their rows, and a run with nothing new adds none (the resume gate, S9).
The checkpoint and sink live under the shared folder, so a lost executor or driver restart resumes
from the last committed batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import decode as D

BATCH = "__batch"  # partition column of the sink
REPLIES_SCHEMA = "lang string, id long, raw string"


def parse_stream(replies: DataFrame, catalog: DataFrame, kind: str = "intensity") -> DataFrame:
    """Stateless parse of a (streaming or batch) reply frame to (lang, id, label, value) for the
    labels each language's gold has (a stream-static join with the small label catalog)."""
    return D.parse_replies(replies, catalog, "intensity" if kind == "intensity" else "labels")


def _run(replies: DataFrame, sink_dir: str, checkpoint_dir: str, catalog: DataFrame, kind: str) -> int:
    """Parse what ``replies`` has to give, then stop. Each micro-batch replaces its own folder of the sink, so one
    that is repeated after a failure adds nothing, and its replies are counted while it is written. Returns their
    number."""
    catalog = catalog.persist()
    read = [0]

    def parsed(batch: DataFrame, number: int) -> None:
        seen = Observation()
        counted = batch.observe(seen, F.count(F.lit(1)).alias("n"))
        parse_stream(counted, catalog, kind).write.mode("overwrite").parquet(f"{sink_dir}/{BATCH}={number}")
        read[0] += seen.get["n"]

    try:
        q = (replies.writeStream.foreachBatch(parsed).option("checkpointLocation", checkpoint_dir)
             .trigger(availableNow=True).start())
        q.awaitTermination()
    finally:
        catalog.unpersist()
    return read[0]


def _arriving(spark: SparkSession, source_dir: str, file_format: str) -> DataFrame:
    return spark.readStream.schema(REPLIES_SCHEMA).format(file_format).load(source_dir)


def run_incremental(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                    catalog: DataFrame, kind: str = "intensity", file_format: str = "parquet") -> int:
    """Process every reply file not processed yet, then stop. Returns the reply rows read by this run."""
    return _run(_arriving(spark, source_dir, file_format), sink_dir, checkpoint_dir, catalog, kind)


def run_resumed(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                catalog: DataFrame, kind: str = "intensity", file_format: str = "parquet") -> int:
    """The resume gate (S9) as a stream: each input's first usable reply is parsed, once. Error replies give no rows
    and leave their input pending, so a good reply that was requested again takes their place; repeats of a usable
    reply, in this run or a later one, are dropped. Of several usable replies that arrive in one micro-batch any one
    stands. Replies without a language or id are keyed by the null. Returns the replies parsed by this run.

    The state is one key an input, hash partitioned and saved in the checkpoint. The session's state store provider
    keeps it: Spark's default in memory, RocksDB (a session setting) on disk, at some MB a partition however few the keys."""
    good = _arriving(spark, source_dir, file_format).where(D.usable_reply("raw")).dropDuplicates(["lang", "id"])
    return _run(good, sink_dir, checkpoint_dir, catalog, kind)
