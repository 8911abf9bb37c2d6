"""Access to the parquet test tables and the ``emails`` view built on them.

``emails`` turns ``documents`` (+ ``labels``) into mail records:

* ``mail_id``  = ``doc_id``
* ``subject``  = first line of ``text``; null when ``doc_id % 17 = 0``
* ``body``     = everything after the first newline; null when there is none
* ``sender``   by ``doc_id % 5``: 0 ``<source> <u<id>@<domain>>``, 1 the same at
  ``mail.<domain>``, 2 bare ``u<id>@<domain>``, 3 upper-case ``<DOMAIN>``, 4 empty
* ``label``    = ``labels.toxic`` (left join; null when unlabelled)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

TEST_DOMAIN = "example.edu"


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin a scan over the cluster when it has too few splits.

    A table stored as one unsplittable unit (a single Parquet row group, a
    multi-line CSV) is read by one task, and every per-row expression after
    it runs on one core.  When the scan has fewer than half the cluster's
    default parallelism, redistribute it once; a large table that already has
    thousands of splits is returned unchanged (no shuffle).
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    have = df.rdd.getNumPartitions()
    return df.repartition(want) if have * 2 <= want else df


def table(spark: SparkSession, sf_dir: str, name: str, parallel: bool = False) -> DataFrame:
    """Read one driver table; ``parallel=True`` spreads an under-split scan
    (for CPU-heavy per-row work only — light queries are faster without the
    extra exchange)."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if parallel else df


def emails_from(documents: DataFrame, labels: DataFrame | None,
                domain: str = TEST_DOMAIN, keep: tuple[str, ...] = ()) -> DataFrame:
    d = documents.select("doc_id", "text", "source", *keep)
    nl = F.instr(F.col("text"), "\n")
    first_line = F.substring_index(F.col("text"), "\n", 1)
    rest = F.when(nl > 0, F.expr("substring(text, instr(text, '\n') + 1)"))
    uid = F.concat(F.lit("u"), F.col("doc_id").cast("string"))
    m = F.pmod(F.col("doc_id"), F.lit(5))
    sender = (F.when(m == 0, F.concat(F.col("source"), F.lit(" <"), uid, F.lit("@" + domain + ">")))
              .when(m == 1, F.concat(F.col("source"), F.lit(" <"), uid, F.lit("@mail." + domain + ">")))
              .when(m == 2, F.concat(uid, F.lit("@" + domain)))
              .when(m == 3, F.concat(F.col("source"), F.lit(" <"), uid, F.lit("@" + domain.upper() + ">")))
              .otherwise(F.lit("")))
    out = d.select(
        F.col("doc_id").alias("mail_id"),
        F.when(F.pmod(F.col("doc_id"), F.lit(17)) != 0, first_line).alias("subject"),
        rest.alias("body"),
        sender.alias("sender"),
        F.col("source"),
        *keep,
    )
    if labels is None:
        return out.withColumn("label", F.lit(None).cast("int"))
    lab = labels.select(F.col("doc_id").alias("mail_id"), F.col("toxic").cast("int").alias("label"))
    # AQE turns this into a broadcast join only when the measured label side is small.
    return out.join(lab, "mail_id", "left")


def emails(spark: SparkSession, sf_dir: str, domain: str = TEST_DOMAIN,
           keep: tuple[str, ...] = (), parallel: bool = False, labelled: bool = True) -> DataFrame:
    """``labelled=False`` skips the labels join for queries that never read
    ``label`` (the optimizer cannot drop a left join on its own)."""
    labels = table(spark, sf_dir, "labels") if labelled else None
    return emails_from(table(spark, sf_dir, "documents", parallel), labels, domain, keep)


# DuckDB twin of ``emails`` (FROM-clause fragment) used by the oracles.
EMAILS_SQL = f"""(
  SELECT d.doc_id AS mail_id,
         CASE WHEN d.doc_id % 17 <> 0 THEN split_part(d.text, chr(10), 1) END AS subject,
         CASE WHEN strpos(d.text, chr(10)) > 0 THEN substr(d.text, strpos(d.text, chr(10)) + 1) END AS body,
         CASE d.doc_id % 5
           WHEN 0 THEN d.source || ' <u' || CAST(d.doc_id AS VARCHAR) || '@{TEST_DOMAIN}>'
           WHEN 1 THEN d.source || ' <u' || CAST(d.doc_id AS VARCHAR) || '@mail.{TEST_DOMAIN}>'
           WHEN 2 THEN 'u' || CAST(d.doc_id AS VARCHAR) || '@{TEST_DOMAIN}'
           WHEN 3 THEN d.source || ' <u' || CAST(d.doc_id AS VARCHAR) || '@{TEST_DOMAIN.upper()}>'
           ELSE '' END AS sender,
         d.source AS source,
         CAST(l.toxic AS INTEGER) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
)"""
