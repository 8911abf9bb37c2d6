"""CSV sources and sinks with pandas ``read_csv`` / ``to_csv`` semantics.

S1  :func:`read_mail_csv`  header, UTF-8, quoted multi-line fields; rows with
    *too many* fields are skipped, rows with too few are null-padded, blank
    lines are skipped.
S2  :func:`na_tokens_to_null`  pandas' default missing-value strings → null.
S3  :func:`read_corpus`  many files in one scan, each by its own header.
S5  :func:`write_csv_parts`  one CSV part per partition, no index.
S6  :func:`merge_csv`  re-read parts, add a leading unnamed 0-based index
    (distributed row index, explicit order key), write.
P1  :func:`with_text`  build ``text`` from the columns present.

Multi-line CSV files cannot be split (one task per file); convert them to
Parquet right after ingest (:func:`ingest_to_parquet`) before heavy work.
"""

from __future__ import annotations

import csv
import io
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemail.functions.text import NA_TOKENS, body_text, na_to_null, training_text

CORRUPT = "_corrupt_record"
# A quoted CSV field (with doubled quotes inside); possessive runs keep Java's
# regex engine from recursing once per character on long fields.
_QUOTED = r'"(?:[^"]++|"")*+"'

READ_OPTS = dict(header="true", multiLine="true", quote='"', escape='"', encoding="UTF-8",
                 mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT,
                 ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")

WRITE_OPTS = dict(header="true", quote='"', escape='"', encoding="UTF-8",
                  ignoreLeadingWhiteSpace="false", ignoreTrailingWhiteSpace="false")


def header_columns(spark: SparkSession, path: str) -> list[str]:
    """Column names from the header line (reads one line, no data job)."""
    return spark.read.options(header="true", multiLine="true", quote='"', escape='"').csv(path).columns


def read_mail_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                  na_values: bool = True) -> DataFrame:
    """S1 (+S2): all-string read with the pandas bad-line rule.

    A row is dropped iff its raw text, once quoted fields are removed, holds at
    least as many commas as there are columns (i.e. it has too many fields).
    """
    cols = columns or header_columns(spark, path)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField(CORRUPT, T.StringType())])
    raw = spark.read.options(**READ_OPTS).schema(schema).csv(path)
    unquoted = F.regexp_replace(F.col(CORRUPT), _QUOTED, "")
    n_commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    too_many = F.coalesce(n_commas >= F.lit(len(cols)), F.lit(False))
    out = raw.filter(~too_many).select(*[F.col(c) for c in cols])
    if na_values:
        out = na_tokens_to_null(out)
    return out


def na_tokens_to_null(df: DataFrame, cols: list[str] | None = None,
                      tokens: list[str] | None = None) -> DataFrame:
    """Replace pandas' default NA strings by null in string columns."""
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    targets = [c for c in (cols or df.columns) if c in strings]
    return df.withColumns({c: na_to_null(c, tokens or NA_TOKENS) for c in targets})


def describe_columns(df: DataFrame) -> list[str]:
    """The columns found in a source (schema only, no job)."""
    return list(df.columns)


def with_text(df: DataFrame) -> DataFrame:
    """``subject`` + ``body`` → P2; only ``body`` → P3; otherwise an error
    (a lone ``text`` column is rejected too, as in the original loader)."""
    if "subject" in df.columns and "body" in df.columns:
        return df.withColumn("text", training_text("subject", "body"))
    if "body" in df.columns:
        return df.withColumn("text", body_text("body"))
    raise ValueError(f"no body column to make the text from, only {df.columns}")


def training_table(df: DataFrame, label_type: str = "int") -> DataFrame:
    """Keep ``text, label``; a missing ``label`` raises an AnalysisException.
    A label such as ``1.0`` is the number it says; one that is no number is null."""
    label = F.col("label").cast("string").try_cast("double").try_cast(label_type)
    return with_text(df).select("text", label.alias("label"))


def union_sources(dfs: list[DataFrame]) -> DataFrame:
    """Union all by name, missing columns null, no de-duplication."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def file_headers(spark: SparkSession, paths: list[str], threads: int = 16) -> list[tuple[str, str, list[str]]]:
    """``(path, file, header)`` of every data file under the given files or
    folders.  Only the beginning of a file is read, through the session's own file
    systems; files without a header line are left out."""
    from concurrent.futures import ThreadPoolExecutor
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def files(path: str) -> list:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(conf)
        found = fs.globStatus(p)
        if not found:
            raise FileNotFoundError(path)
        out = []
        for s in found:
            out += [x for x in fs.listStatus(s.getPath()) if x.isFile()] if s.isDirectory() else [s]
        return [(path, s.getPath()) for s in out if s.getLen() and s.getPath().getName()[0] not in "._"]

    def header(given) -> tuple[str, str, list[str]] | None:
        path, place = given
        size = 1 << 14
        while True:
            stream = place.getFileSystem(conf).open(place)
            try:
                raw = bytes(stream.readNBytes(size))
            finally:
                stream.close()
            # whole when a line ends outside quotes, or with the file
            lines = raw.decode("utf-8-sig", errors="ignore").lstrip("\r\n")
            end = next((m.end() for m in re.finditer(r"[\r\n]", lines) if lines.count('"', 0, m.start()) % 2 == 0), None)
            if end or len(raw) < size:
                row = next(csv.reader(io.StringIO(lines[:end], newline="")), None)
                return (path, re.sub("^file:/+", "file:/", place.toUri().toString()), row) if row else None
            size *= 8

    listed = [f for p in paths for f in files(p)]
    with ThreadPoolExecutor(threads) as pool:
        return [h for h in pool.map(header, listed) if h]


def read_corpus(spark: SparkSession, paths: list[str], label_type: str = "int",
                source_col: str = "source") -> DataFrame:
    """All files in one scan, each read by its own header.

    The scan takes fields by place; a table with a row for each file says in which
    place its ``subject``, ``body`` and ``label`` stand and how many fields it has.
    Files with the bodies alone and files with subjects too, in any order of
    columns, so share one plan that does not grow with them."""
    heads = file_headers(spark, paths)
    if not heads:
        raise FileNotFoundError(f"no CSV file with a header under {paths}")
    for path, file, head in heads:
        for needed in ("body", "label"):
            if needed not in head:
                raise ValueError(f"{file}: no {needed} column, only {head}")
    width = max(len(h) for _, _, h in heads)
    kind = "__file string, __source string, __subject int, __body int, __label int, __fields int"
    table = spark.createDataFrame([(file, path, h.index("subject") if "subject" in h else None, h.index("body"), h.index("label"), len(h))
                                   for path, file, h in heads], kind)
    names = [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, CORRUPT]])
    files = sorted({path for path, _, _ in heads})
    raw = spark.read.options(**READ_OPTS).schema(schema).csv(files)
    raw = raw.select(F.array(*names).alias("__values"), CORRUPT, F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__at"))
    # one row a file: small next to the data, and broadcast where it is measured to be
    met = raw.join(table, F.col("__at") == F.col("__file"))
    unquoted = F.regexp_replace(F.col(CORRUPT), _QUOTED, "")
    commas = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(","), F.lit("")))
    # a record as wide as the scan is not corrupt to it, but may be too wide for its file
    too_many = F.coalesce(commas, F.lit(width - 1)) >= F.col("__fields")
    value = lambda c: na_to_null(F.get("__values", F.col(c)), NA_TOKENS)
    text = F.when(F.col("__subject").isNotNull(), training_text(value("__subject"), value("__body"))).otherwise(body_text(value("__body")))
    label = value("__label").try_cast("double").try_cast(label_type)
    return met.filter(~too_many).select(text.alias("text"), label.alias("label"), F.col("__source").alias(source_col))


def ingest_to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Persist a parsed CSV once as Parquet; later passes are splittable."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_csv_parts(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One numbered CSV part per partition, header, no index.  The two
    whitespace options keep values byte-exact (Spark trims by default)."""
    df.write.mode(mode).options(**WRITE_OPTS).csv(path)


def merge_csv(spark: SparkSession, parts_dir: str, out: str, order: list[str],
              index: bool = True, single_file: bool = False, mode: str = "overwrite") -> DataFrame:
    """Re-read the parts, prepend a 0-based row index in ``order``, write.

    The index column has an empty header, like ``to_csv`` with an index.
    ``coalesce(1)`` happens only when a single file is asked for.
    """
    from tidemail.operators.sampling import with_row_index
    df = read_mail_csv(spark, parts_dir)
    if index:
        df = with_row_index(df, order, "__index")
        df = df.select(F.col("__index").alias(""), *[c for c in df.columns if c != "__index"])
    if single_file:
        df = df.coalesce(1)
    # like to_csv: empty strings (and the index header) written bare, not as ""
    df.write.mode(mode).options(**WRITE_OPTS).option("emptyValue", "").csv(out)
    return df
