"""Intake of binary files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa import limits

# Fixed value: the signature every accepted file carries near its start.
SIGNATURE = "%PDF-"


def intake_files(
    spark: SparkSession,
    path: str,
    max_bytes: int = limits.MAX_FILE_BYTES,
    suffix: str = ".pdf",
    recursive: bool = True,
) -> DataFrame:
    """File manifest ``path, n_bytes, fingerprint, status, code``.

    Files rejected by size are listed from their metadata; the size filter
    reaches the source, so their content is never read.  Spark's scan skips
    empty files, so they are found as the names of its file listing (which the
    driver holds for any file source) that the scan does not return.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    listed = spark.createDataFrame([(p,) for p in files.inputFiles()], "path string")
    key = F.regexp_replace("path", "^[A-Za-z0-9]+:/*", "/")
    empty = (
        listed.withColumn("_key", key)
        .join(files.select(key.alias("_key")), "_key", "left_anti")
        .select(
            "path",
            F.lit(0).cast("bigint").alias("n_bytes"),
            F.lit(None).cast("string").alias("fingerprint"),
            F.lit("EMPTY_FILE").alias("code"),
        )
    )
    by_size = (F.col("length") > 0) & (F.col("length") <= max_bytes)
    refused = files.filter(~by_size).select(
        "path",
        F.col("length").alias("n_bytes"),
        F.lit(None).cast("string").alias("fingerprint"),
        F.lit("FILE_TOO_LARGE").alias("code"),
    )
    head = F.decode(F.substring("content", 1, limits.SIGNATURE_WINDOW), "ISO-8859-1")
    read = files.filter(by_size).select(
        "path",
        F.col("length").alias("n_bytes"),
        F.sha2("content", 256).alias("fingerprint"),
        F.when(~F.endswith(F.lower("path"), F.lit(suffix)), "INVALID_FILE_TYPE")
        .when(~F.contains(head, F.lit(SIGNATURE)), "INVALID_PDF_SIGNATURE")
        .alias("code"),
    )
    return read.unionByName(refused).unionByName(empty).select(
        "path",
        "n_bytes",
        F.when(F.col("code").isNull(), F.col("fingerprint")).alias("fingerprint"),
        F.when(F.col("code").isNull(), "accepted").otherwise("rejected").alias("status"),
        "code",
    )
