"""Streaming scorer (T1) with a reject output.

JSON mail records arrive as text lines in a directory (or any streaming
source).  Each micro-batch is parsed with the strict intake rules (S7); valid
mails go through the same ``analyze`` projection as batch scoring (L4), bad
ones to the reject sink with their reason.  Scoring is stateless, so no
watermark or state store is needed.

Exactly-once output: every micro-batch writes into its own
``batch_id=<n>`` folder with overwrite, so a batch replayed after a failure
replaces its earlier partial output instead of duplicating it.

Joint commit: a mail is answered either way, so a batch's verdicts and rejects
appear together.  When both are written, the batch is entered into the manifest
(``_commits`` beside the verdicts, one file a batch, put in place by a rename);
:func:`read_committed` shows entered batches only.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from tidemail.plans.scoring import analyze
from tidemail.sources.requests import parse_json_records, split_parsed


class Commits:
    """The manifest of a scorer's output folder."""

    def __init__(self, spark: SparkSession, out_dir: str):
        self.spark, self.folder = spark, f"{out_dir.rstrip('/')}/_commits"

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def enter(self, batch_id: int) -> None:
        fs, draft = self._path(f".draft-{uuid.uuid4().hex}")
        fs.create(draft, True).close()
        if not fs.rename(draft, self._path(str(batch_id))[1]) and batch_id not in self.batches():
            raise OSError(f"batch {batch_id} could not be entered into {self.folder}")
        fs.delete(draft, False)                   # left where the batch was entered before

    def withdraw(self, batch_id: int) -> None:
        """Before a replayed batch replaces its output."""
        fs, p = self._path(str(batch_id))
        fs.delete(p, False)

    def batches(self) -> list[int]:
        fs, p = self._path("")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()) if fs.exists(p) else []


def read_committed(spark: SparkSession, out_dir: str, reject_dir: str) -> tuple[DataFrame | None, DataFrame | None]:
    """``(verdicts, rejected)`` of the batches whose outputs are both whole; None
    before the first."""
    done = Commits(spark, out_dir).batches()
    if not done:
        return None, None
    entered = spark.createDataFrame([(b,) for b in done], "batch_id int")
    both = []
    for folder in (out_dir, reject_dir):
        table = spark.read.parquet(folder)
        both.append(table.join(entered, "batch_id", "left_semi"))
    return both[0], both[1]


def score_stream(spark: SparkSession, in_dir: str, model: PipelineModel, out_dir: str,
                 reject_dir: str, checkpoint: str, domain: str,
                 available_now: bool = True, processing_time: str | None = None,
                 max_files_per_trigger: int | None = 1000):
    """Start the query; returns the ``StreamingQuery``.  ``available_now``
    drains what is there and stops.  A micro-batch holds at most
    ``max_files_per_trigger`` files (None: all that are there)."""
    reader = spark.readStream.format("text")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = reader.load(in_dir)

    def per_batch(df: DataFrame, batch_id: int):
        # both sinks read one parse of the micro-batch; a lost cached block is
        # recomputed from the (replayable) source files
        parsed = parse_json_records(df, "value").persist()
        commits = Commits(spark, out_dir)
        commits.withdraw(batch_id)
        try:
            valid, rejected = split_parsed(parsed)
            analyze(model, valid, domain, texts=True).write.mode("overwrite").parquet(
                f"{out_dir}/batch_id={batch_id}")
            rejected.write.mode("overwrite").parquet(f"{reject_dir}/batch_id={batch_id}")
            commits.enter(batch_id)
        finally:
            parsed.unpersist()

    w = raw.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    elif processing_time:
        w = w.trigger(processingTime=processing_time)
    return w.start()
