"""Content-addressed model store.

A model's folder is named by a digest of its training rows and its parameters, so
the same training is not paid twice, and changed rows or parameters train
anew, also within one session.  A model is saved into a folder of its own and
renamed when it is whole: readers never meet half of one, and of two writers one
wins.  ``current`` names the model that serves; it is replaced by a rename too.
Nothing is remembered in the process.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rows_digest(df: DataFrame) -> str:
    """A digest of the rows of ``df`` as a multiset: no order, no partitioning."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    n, total, odd = df.select(h.alias("h")).agg(F.count("*"), F.sum(F.col("h").cast("decimal(38,0)")), F.bit_xor("h")).first()
    return hashlib.sha256(f"{df.schema.simpleString()} {n} {total} {odd}".encode()).hexdigest()


class ModelStore:
    """Models under ``root``, a shared folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._path(path)
        return fs.exists(p)

    def _move(self, source: str, target: str) -> bool:
        fs, p = self._path(source)
        fs.mkdirs(self._path(target)[1].getParent())
        return not self._exists(target) and fs.rename(p, self._path(target)[1])

    def folder(self, kind: str, data: DataFrame, params) -> str:
        name = hashlib.sha256(f"{kind} {params!r} {rows_digest(data)}".encode()).hexdigest()
        return f"{self.root}/{kind}/{name}"

    def train_once(self, kind: str, data: DataFrame, params, train: Callable, save: Callable, load: Callable):
        """The model of these rows and parameters: loaded where it is stored,
        else ``train()``, stored by ``save(model, path)``."""
        folder = self.folder(kind, data, params)
        if not self._exists(folder):
            draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
            save(train(), draft)
            if not self._move(draft, folder):            # another writer was first
                fs, p = self._path(draft)
                fs.delete(p, True)
        return load(folder)

    def serve(self, kind: str, folder: str) -> None:
        """Make the model in ``folder`` the one that serves.  Names are numbered;
        the highest is current, so readers see the old or the new one."""
        draft = f"{self.root}/.draft-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(folder,)], "folder string").coalesce(1).write.parquet(draft)
        n = self._last(kind) + 1
        while not self._move(draft, f"{self.root}/{kind}/current/{n:010d}"):
            n += 1

    def _last(self, kind: str) -> int:
        fs, p = self._path(f"{self.root}/{kind}/current")
        return max((int(s.getPath().getName()) for s in fs.listStatus(p)), default=0) if fs.exists(p) else 0

    def current(self, kind: str) -> str | None:
        """The folder of the model that serves."""
        n = self._last(kind)
        return self.spark.read.parquet(f"{self.root}/{kind}/current/{n:010d}").first()[0] if n else None
