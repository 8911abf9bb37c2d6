"""Journal of a generator's answers (G7, X2): what was paid for once is not asked
again.

A call is known by a digest of its column, settings, row key and prompt.  While a
task calls, it writes each few answers as a small Parquet file into the shared
folder, whole or not at all.  Before calling,

* a new run joins its calls with the journal and asks only for the others;
* a task that is run again looks into its own sub-folder first, so it loses no
  more than the answers not yet written (``every`` calls).

Failed calls are not kept: their rows are asked for again.  Equal prompts of
different rows are different calls, since the generator draws.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_KIND = pa.schema([("call", pa.string()), ("answer", pa.string())])


def call_digest(column: str, settings, key: Column, prompt: Column) -> Column:
    """Digest of a call; null for a null prompt, which is never asked."""
    return F.when(prompt.isNotNull(), F.sha2(F.concat_ws("\x1f", F.lit(column), F.lit(repr(settings)), F.coalesce(key.cast("string"), F.lit("")), prompt), 256))


class Journal:
    """Answers under ``path``, a folder that driver and tasks share (a local path
    or a URI that pyarrow opens)."""

    def __init__(self, path: str, every: int = 16):
        self.path, self.every = path.rstrip("/"), max(1, every)
        self.run = uuid.uuid4().hex

    def folder(self, column: str) -> str:
        return f"{self.path}/{column}"

    def answers(self, spark: SparkSession, column: str) -> DataFrame | None:
        """``(call, answer)`` of all earlier runs, one row a call; None if there
        is none yet."""
        system, place = pafs.FileSystem.from_uri(self.folder(column))
        if system.get_file_info(place).type == pafs.FileType.NotFound:
            return None
        held = (spark.read.schema("call string, answer string").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet")
                .parquet(self.folder(column)))
        # two attempts of one task may both have asked
        return held.groupBy("call").agg(F.min("answer").alias("answer"))

    def task(self, column: str, part: int) -> "TaskJournal":
        return TaskJournal(f"{self.folder(column)}/{self.run}-{part}")


class TaskJournal:
    """The answers of one task, over all its attempts."""

    def __init__(self, folder: str):
        self.system, self.place = pafs.FileSystem.from_uri(folder)
        self.held: dict[str, str] = {}
        if self.system.get_file_info(self.place).type == pafs.FileType.Directory:
            for info in self.system.get_file_info(pafs.FileSelector(self.place)):
                if info.path.endswith(".parquet"):
                    with self.system.open_input_file(info.path) as f:
                        table = pq.read_table(f, schema=_KIND)
                    self.held |= dict(zip(table.column("call").to_pylist(), table.column("answer").to_pylist()))

    def write(self, answers: dict[str, str]) -> None:
        if not answers:
            return
        self.system.create_dir(self.place, recursive=True)
        name = f"{self.place}/{uuid.uuid4().hex}"
        with self.system.open_output_stream(name + ".draft") as f:
            pq.write_table(pa.table({"call": list(answers), "answer": list(answers.values())}, schema=_KIND), f)
        self.system.move(name + ".draft", name + ".parquet")
        self.held |= answers
