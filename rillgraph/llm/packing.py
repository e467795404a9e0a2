"""Batches for training from optimal length buckets.

Lengths are tokens of a byte-level BPE rank table, counted once. Those of all rows are counted in one global histogram.
Dynamic programming over the histogram chooses the bucket boundaries for which the padding is smallest; every row goes to
the first bucket whose boundary is not below its length. Inside a bucket, rows form batches of as many rows as the token
budget holds at the bucket's length. A row above the budget is a batch of its own without padding, in one more bucket,
so the histogram has at most as many lengths as the budget has tokens, and is exact at every size.

Batches are numbered inside shards: a bucket is dealt over as many shards as its tokens need, by a hash of identifier
and length, so a bucket with a third of all rows is not one task's work; at most one batch of each shard isn't full.
``token_batches`` puts the ids of each batch together, padded to the bucket's length.

Defined cases. Null text: length 0, in the first bucket. Null identifiers are packed like others, in the order of their
length. Rows that share an identifier and a length are interchangeable. Invalid UTF-8 is read with replacement
characters. Extra columns pass through; taken names raise ``ValueError``. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import read_ranks
from .common import free_name, python_texts, shipped

ADDED = ("n_tokens", "bucket", "bucket_length", "shard", "batch", "padding")


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """At most ``buckets`` increasing boundaries, the last the largest length, with the least sum of padding.

    best[k][j] is the least padding of the first j lengths in k buckets; the row minima move to the right as j grows,
    so each row takes O(L log L) by divide and conquer. Of equally good boundaries the smaller are taken.
    """
    x, n = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    size = len(x)
    if size == 0:
        return []
    rows, tokens = np.concatenate([[0], n.cumsum()]), np.concatenate([[0], (n * x).cumsum()])

    def cost(i, j):
        """Padding of lengths i..j-1 in a bucket of length x[j-1]."""
        return (rows[j] - rows[i]) * x[j - 1] - (tokens[j] - tokens[i])

    best = np.array([0.0, *(cost(0, j) for j in range(1, size + 1))])
    came = [np.zeros(size + 1, np.int64)]
    for k in range(2, min(buckets, size) + 1):
        new, arg = np.full(size + 1, np.inf), np.zeros(size + 1, np.int64)
        todo = [(k, size, k - 1, size - 1)]
        while todo:
            lo, hi, first, last = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(first, k - 1), min(last, j - 1) + 1)
            c = best[i] + cost(i, j)
            at = int(c.argmin())
            new[j], arg[j] = c[at], i[at]
            todo += [(lo, j - 1, first, int(i[at])), (j + 1, hi, int(i[at]), last)]
        best = new
        came.append(arg)
    out, j = [], size
    for arg in reversed(came):
        out.append(int(x[j - 1]))
        j = int(arg[j])
    return out[::-1]


def with_token_count(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``df`` with the number of tokens of each whole text, without special tokens; the same as ``len`` of ``bpe.encode``'s ids."""
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column already there: {out}")
    with open(path, "rb") as f:
        sent = shipped(df.sparkSession, f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tiktoken.Encoding("counted", pat_str=pattern, mergeable_ranks=read_ranks(sent.value), special_tokens={}).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t)) if t else 0 for t in python_texts(batch.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def pack(df: DataFrame, length: Column, doc_id: str = "doc_id", *, token_budget: int = 8192, buckets: int = 16, shard_tokens: int = 2_000_000) -> DataFrame:
    """``df`` with ``n_tokens, bucket, bucket_length, shard, batch, padding``; a batch is known by bucket, shard and batch.

    ``df`` is read twice, so write it first where ``length`` takes work. ``length`` may be a column named ``n_tokens``.
    """
    own = "n_tokens" in df.columns and str(length) == str(F.col("n_tokens"))
    if taken := set(ADDED[own:]) & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    sized = df.withColumn("n_tokens", F.coalesce(length, F.lit(0)).cast("long"))
    fits = F.when(F.col("n_tokens") <= token_budget, F.col("n_tokens"))
    counted = sized.groupBy(fits.alias("x")).agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).orderBy("x").collect()  # at most token_budget + 2 rows
    over = sum(r.tokens for r in counted if r.x is None)
    counted = [r for r in counted if r.x is not None]
    ends = boundaries([r.x for r in counted], [r.n for r in counted], buckets)
    rows_in = [sum(r.n for r in counted if (ends[k - 1] if k else -1) < r.x <= end) for k, end in enumerate(ends)]
    per_batch = [*(max(1, token_budget // max(1, e)) for e in ends), 1]
    # a shard has about shard_tokens tokens with their padding, and at least one batch, so its size doesn't grow
    shards = [*(max(1, n * max(1, e) // max(shard_tokens, m * e)) for n, m, e in zip(rows_in, per_batch, ends, strict=False)), max(1, over // shard_tokens)]
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs]).cast("array<bigint>")
    bucket = sum((F.when(F.col("n_tokens") > e, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    placed = sized.withColumn("bucket", F.when(F.col("n_tokens") > token_budget, len(ends)).otherwise(bucket).cast("int"))
    size_of = free_name(df, "per_batch")
    placed = placed.withColumns({"bucket_length": F.coalesce(F.get(longs(ends), F.col("bucket")), F.col("n_tokens")), size_of: F.get(longs(per_batch), F.col("bucket")), "shard": F.pmod(F.xxhash64(doc_id, "n_tokens"), F.get(longs(shards), F.col("bucket"))).cast("int")})
    place = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy(F.col(doc_id), F.col("n_tokens")))
    return placed.withColumns({"batch": F.floor((place - 1) / F.col(size_of)).cast("long"), "padding": F.col("bucket_length") - F.col("n_tokens")}).drop(size_of)


def token_batches(packed: DataFrame, ids: str = "ids", doc_id: str = "doc_id", pad: int = -1) -> DataFrame:
    """``bucket, shard, batch, doc_ids, input_ids``: one row for each batch of a packed table that has its token ids.

    ``input_ids`` is as long for each row as the bucket, filled with ``pad``. A batch holds a token budget, or one row.
    """
    row = F.concat(F.coalesce(F.col(ids), F.array().cast("array<int>")), F.array_repeat(F.lit(pad), F.col("padding").cast("int")))
    rows = packed.select("bucket", "shard", "batch", F.struct(F.col(doc_id).alias("doc_id"), row.alias("ids")).alias("row"))
    found = rows.groupBy("bucket", "shard", "batch").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return found.select("bucket", "shard", "batch", F.col("rows.doc_id").alias("doc_ids"), F.col("rows.ids").alias("input_ids"))
