"""Exact duplicates by a content sort. DataFrame operations only.

Normalised texts (A-Z lower-cased; null: empty) are range-partitioned by splitters that Spark samples from the data,
and sorted externally inside each partition, so equal texts are neighbours. The sort key is the text's first
``prefix`` characters, then its digest, then the whole text, so that the sampled splitters, which meet on the driver,
are short however long the texts are. A window over runs of equal texts compares neighbours in full; the row with the
largest (or smallest) identifier of a run stays.

Hot texts. A first pass counts digests with map-side combination. Texts that occur more often than ``hot_rows`` and
more often than a quarter of an even partition are hot; there are at most four for each partition, whatever the input,
and that list is broadcast. Rows of hot texts are spread over salted runs and take their group's size and keeper from
the list, so no task gets a whole hot group. All other rows get theirs from the sort.

Defined cases. Rows that share an identifier and a text are one group; exactly one of them is kept. Null identifiers
lose against any other; a group of nulls only keeps one of them and has a null ``keep_id``. Empty texts are equal to
each other. Extra columns pass through; names that are taken raise ``ValueError``. No rows: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def mark_duplicates(df: DataFrame, text: str = "text", doc_id: str = "doc_id", *, keep: str = "largest", carry_text: bool = True, hot_rows: int = 1000, prefix: int = 48) -> DataFrame:
    """``df`` with ``keep_id, group_size, kept, text_sha256``; ``carry_text=False`` leaves the text column out."""
    if taken := set(ADDED) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    best = F.max if keep == "largest" else F.min
    norm, start, salt, hot_id, hot_size = (free_name(df, n) for n in ("norm", "start", "salt", "hot_id", "hot_size"))
    rows = df.withColumn(norm, ascii_lower(F.col(text)))
    digest = F.sha2(F.col(norm).cast("binary"), 256)

    counts = rows.select(digest.alias("text_sha256"), F.col(doc_id).alias("id")).groupBy("text_sha256").agg(best("id").alias("best"), F.count("*").alias("n"))
    total = df.count()
    limit = max(hot_rows, total // (4 * parts))
    hot = counts.where(F.col("n") > limit).select("text_sha256", F.col("best").alias(hot_id), F.col("n").alias(hot_size))  # at most 4 * parts rows
    # equal identifiers share a run; null ones, which can't stay beside others, go anywhere
    key = F.when(F.col(doc_id).isNull() & F.col(hot_id).isNotNull(), F.monotonically_increasing_id()).otherwise(F.col(doc_id))
    spread = F.pmod(F.xxhash64(key), F.lit(16 * parts)).cast("int")
    marked = rows.withColumn("text_sha256", digest).join(F.broadcast(hot), "text_sha256", "left").withColumn(salt, F.when(F.col(hot_size).isNull(), F.lit(0)).otherwise(spread))

    run = Window.partitionBy(start, "text_sha256", norm, salt)
    first = run.orderBy((F.col(doc_id).desc_nulls_last() if keep == "largest" else F.col(doc_id).asc_nulls_last()))
    sorted_ = marked.select(*([c for c in df.columns if carry_text or c != text]), "text_sha256", hot_id, hot_size, norm, F.substring(norm, 1, prefix).alias(start), salt).repartitionByRange(start, "text_sha256", salt)
    in_run: Column = F.row_number().over(first)
    found = sorted_.withColumns({"keep_id": F.first(doc_id).over(first), "group_size": F.count("*").over(run), "kept": in_run == 1})
    is_hot = F.col(hot_size).isNotNull()
    return found.select(
        *[c for c in df.columns if carry_text or c != text],
        F.when(is_hot, F.col(hot_id)).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(is_hot, F.col(hot_size)).otherwise(F.col("group_size")).alias("group_size"),
        F.when(is_hot, F.col("kept") & F.col(doc_id).eqNullSafe(F.col(hot_id))).otherwise(F.col("kept")).alias("kept"),
        "text_sha256",
    )
