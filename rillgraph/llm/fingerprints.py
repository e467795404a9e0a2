"""Document fingerprints by improved consistent weighted sampling. DataFrame operations only.

Terms are lower-cased words (runs without white space), weighted by their number of occurrences. For each of K samples
and each term a hash gives r and c, both Gamma(2, 1), and b, uniform. With t = floor(ln w / r + b) the sample takes the
term with the smallest ln a = ln c + r (b - t - 1), and its value identifies that term and t. Two documents agree on a
sample with a probability equal to their generalised Jaccard similarity, sum of min over sum of max of the weights, so
the share of agreeing samples estimates it (standard error sqrt(J (1 - J) / K)). A value has 16 bits, as 4 hex digits of
the fingerprint.

``neighbour_fingerprints`` also needs every document's successor by descending identifier. Identifiers are cut into
buckets at approximate quantiles, at most four for each shuffle partition and never more than 65,536, so the lists of
quantiles and bucket heads stay small; texts move once, to their bucket, and a bucket's head moves as a second copy to
the bucket before. Nothing is sorted globally and no task holds more than its buckets.

Defined cases. Null text counts as empty; a text without words has the fingerprint of one special term, so two such
texts agree fully. Rows that share an identifier are ordered by their text; null identifiers come last, in a bucket of
their own. A table of one row is its own successor. Extra columns are dropped. No rows: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
_FULL = 32 * math.log(2.0)  # -ln of two 16-bit uniforms' common denominator


def _packed(k: int) -> str:
    """SQL of sample k for a term with hash ``term`` and log weight ``lw``: ln a in fixed point above the 16-bit value."""
    g, h = f"xxhash64(term, {k})", f"xxhash64(term, {k}, 1)"

    def uniform(bits: str, shift: int) -> str:
        return f"((shiftrightunsigned({bits}, {shift}) & 65535) + 0.5D)"

    r = f"({_FULL!r}D - ln({uniform(g, 0)} * {uniform(g, 16)}))"
    c = f"ln({_FULL!r}D - ln({uniform(g, 32)} * {uniform(h, 0)}))"
    b = f"((shiftrightunsigned({h}, 16) & 16777215) * {2.0**-24!r}D)"
    t = f"floor(lw / {r} + {b})"
    a = f"({c} + {r} * ({b} - {t} - 1D))"
    return f"(shiftleft(cast(({a} + 64D) * 16777216D as bigint), 16) | ((shiftrightunsigned({h}, 48) + {t} * 40503) & 65535))"


def fingerprints(df: DataFrame, keys: list[str], text: Column, samples: int = SAMPLES) -> DataFrame:
    """``keys`` and ``fingerprint`` for each distinct key; ``keys`` must tell rows apart."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")
    exploded = df.select(*keys, F.explode_outer(words).alias("word"))
    weighted = exploded.groupBy(*keys, F.xxhash64("word").alias("term")).agg(F.count("*").alias("w")).select(*keys, "term", F.log(F.col("w").cast("double")).alias("lw"))
    least = weighted.groupBy(*keys).agg(*[F.expr(f"min({_packed(k)})").alias(f"_m{k}") for k in range(samples)])
    digits = [F.lower(F.lpad(F.hex(F.col(f"_m{k}").bitwiseAND(65535)), 4, "0")) for k in range(samples)]
    return least.select(*keys, F.concat(*digits).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of agreeing samples of two fingerprints."""
    same = sum((F.when(F.substring(a, 4 * k + 1, 4) == F.substring(b, 4 * k + 1, 4), 1).otherwise(0) for k in range(samples)), F.lit(0))
    return same.cast("double") / samples


def _bucket_of(doc_id: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the identifier, found in two steps; -1 for null."""
    step = max(1, math.isqrt(len(cuts)))
    tops = cuts[step::step]
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= doc_id))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]).cast("array<bigint>")
    parts = [cuts[s : s + step] for s in range(0, max(1, len(cuts)), step)]
    top = below(longs(tops))
    inner = F.get(F.array(*[longs(p) for p in parts]), top)
    return F.when(doc_id.isNull(), -1).otherwise(top * step + below(inner))


def with_successor(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, place, ghost, doc_id, text, next_text``; ghosts are copies of bucket heads, there only to be successors."""
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = min(65_536, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], max(10_000, 4 * n))).first()[0]
    cuts = sorted(set(found or []))
    bucketed = rows.withColumn("bucket", _bucket_of(F.col("doc_id"), cuts))
    # one row for each bucket, of which there are at most 65,537
    heads = {r.bucket: r.head for r in bucketed.groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()}
    order = sorted(heads)
    target = {b: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    slots = range(-1, len(cuts) + 1)
    head_of = F.get(F.array(*[F.lit(heads.get(b)).cast("long") for b in slots]), F.col("bucket") + 1)
    target_of = F.get(F.array(*[F.lit(target.get(b)).cast("int") for b in slots]), F.col("bucket") + 1)
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("ghost"))
    copy = F.struct(target_of.alias("bucket"), F.lit(True).alias("ghost"))
    placed = bucketed.select("doc_id", "text", F.explode(F.when(F.col("doc_id").eqNullSafe(head_of), F.array(own, copy)).otherwise(F.array(own))).alias("at")).select("at.bucket", "at.ghost", "doc_id", "text")
    in_order = Window.partitionBy("bucket").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    return placed.withColumns({"place": F.row_number().over(in_order), "next_text": F.lead("text").over(in_order)})


def edited_text() -> Column:
    """The text whose last half is the first as many code points of the next one (or all of it)."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))


def neighbour_fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` for each row."""
    rows = with_successor(df, doc_id, text)
    facts = rows.where("not ghost").select("bucket", "place", "doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(edited_text().cast("binary"), 256).alias("edited_sha256"))
    both = rows.select("bucket", "place", F.posexplode(F.when(F.col("ghost"), F.array(F.col("text"))).otherwise(F.array(F.col("text"), edited_text()))).alias("edited", "body"))
    prints = fingerprints(both, ["bucket", "place", "edited"], F.col("body"), samples)
    paired = prints.groupBy("bucket", "place").agg(F.max(F.when(F.col("edited") == 0, F.col("fingerprint"))).alias("fingerprint"), F.max(F.when(F.col("edited") == 1, F.col("fingerprint"))).alias("edited_fingerprint"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    near = paired.withColumn("next_fingerprint", following).where("edited_fingerprint is not null")
    out = facts.join(near, ["bucket", "place"])
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"))
