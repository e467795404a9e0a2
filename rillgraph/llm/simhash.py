"""Near-duplicates by SimHash and meet-in-the-middle ball hashing, and by shared shingles.

``groups`` links fingerprints within a radius, ``near_groups`` texts whose word shingles are alike enough.

A fingerprint has 64 bits; a bit is 1 if it is set in more than half of the hashes (XXH64, seed 42) of the text's word
shingles. Two fingerprints within radius r share a point within r/2 of both, so every distinct fingerprint sends itself
and all its variants within half the radius, and equal variants meet. Everything that meets at a variant is within the
radius of everything else there, so an edge from the smallest fingerprint to each of the others keeps all links; a
variant has at most as many visitors as a ball has points, 65 for radius 2, however many documents there are. The edges
are deduplicated, verified by their distance and joined to components.

Alike texts. ``near_groups`` links texts whose distinct five-word shingles have a Jaccard similarity of 0.8, by an exact
join without a cap. Of n shingles in any order that all texts share, two alike texts have one in common among the first
n - ceil(0.8 n) + 1 of each. Here those come first that a sample of texts doesn't show to be frequent, so few texts meet;
the sample decides on the cost alone. All texts that meet at a shingle belong to the star of the smallest text there, and
a pair that meets anywhere is together in a star, so the rows grow with the shingles. In stars of up to ``SMALL_STAR``
texts every pair is compared: first sizes and counts of shingles by slots, which bound what two texts can share, then the
texts. Larger stars, and those of which that leaves over ``MOST_PAIRS`` pairs a text, are cut into blocks, every two blocks meet in a task, and the task counts what all its pairs share by
matrix products and returns alike pairs that span the same groups, fewer than it has texts. So no link is lost and no
pair is linked wrongly. In a star of m texts m**2 / 2 pairs are counted, dealt over tasks, but never made as rows.

Defined cases. Null text counts as empty. No word: fingerprint 0, linked like any other; fewer words than a shingle: the
whole sequence is the only one. Texts are read whole. A null identifier never names a component unless all its
members' are null. Rows that share an identifier are fingerprinted each; rows of equal text are one text. Invalid UTF-8 is
read with replacement characters. Extra columns are dropped by ``groups`` and kept
by ``fingerprints``; taken names raise ``ValueError``. No rows: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import ascii_lower, free_name, python_texts, saved, shipped
from .components import components


def fingerprint(text: str | None, words: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    own = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not own:
        return 0
    if len(own) <= words:
        h = [xxh64_intdigest(b" ".join(own), 42)]
    else:
        joined = b" ".join(own)
        ends = list(accumulate(len(w) + 1 for w in own))
        h = [xxh64_intdigest(joined[s:e], 42) for s, e in zip([0, *ends[:-words]], [x - 1 for x in ends[words - 1 :]], strict=True)]
    hashes = np.array(h, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # keeps the unpacked bits small
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", words: int = 3) -> DataFrame:
    """``df`` without its text, with the fingerprint as a long. No shuffle."""
    kept = [f for f in df.schema.fields if f.name != text]
    if out.lower() in {f.name.lower() for f in kept}:
        raise ValueError(f"column already there: {out}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([fingerprint(x, words) for x in python_texts(batch.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), values], names=[*(f.name for f in kept), out])

    return df.mapInArrow(run, T.StructType([*kept, T.StructField(out, T.LongType())]))


def masks(radius: int) -> list[int]:
    """All changes of at most ``radius`` bits, as signed 64-bit numbers; 0 is the first."""
    out = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """``a, b``: edges between distinct fingerprints (column ``simhash``) that keep every link within ``radius``, which is even."""
    if radius % 2:
        raise ValueError("the radius must be even, to meet in the middle")
    near = distinct.select("simhash", F.explode(F.array(*[F.lit(m).cast("long") for m in masks(radius // 2)])).alias("mask"))
    met = near.select("simhash", F.col("simhash").bitwiseXOR(F.col("mask")).alias("variant"))
    least = F.min("simhash").over(Window.partitionBy("variant"))  # at most one ball stands at a variant
    edges = met.select(least.alias("a"), F.col("simhash").alias("b")).where("a < b")
    return edges.distinct().where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, simhash, component_id`` for each row; ``component_id`` is the smallest identifier reachable."""
    docs = saved(fingerprints(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), words=words), "simhash")
    distinct = saved(docs.groupBy("simhash").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct, radius)).withColumnRenamed("node", "simhash")
    labelled = saved(distinct.join(found, "simhash", "left").select("simhash", "first", F.coalesce("component", "simhash").alias("component")), "labelled")
    smallest = saved(labelled.groupBy("component").agg(F.min("first").alias("component_id")), "smallest")
    of = saved(labelled.join(smallest, "component").select("simhash", "component_id"), "component-of")
    return docs.join(of, "simhash").select("doc_id", "simhash", "component_id")


#: Texts whose shingles are counted to find the frequent ones, and the most of these that are sent to the workers (12 bytes each).
SAMPLED, MAX_LISTED = 16_384, 500_000

#: Shingles a slot in the counts that bound how much two texts can share; the number of slots is a power of two.
SLOT_SHINGLES = 4

#: Stars of more texts, or of more pairs a text that the counts leave, are compared in blocks of at most so many texts and shingles.
SMALL_STAR, MOST_PAIRS, BLOCK_TEXTS, BLOCK_SHINGLES = 256, 4, 2_048, 4_000_000


def shingles(text: str | None, words: int) -> set[bytes]:
    """The distinct word shingles of a text; the whole sequence if it is shorter."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    return {b" ".join(own[i : i + words]) for i in range(max(1, len(own) - words + 1))}


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """The XXH64 of each of ``shingles``, ascending."""
    own = (text or "").encode("utf-8", "replace").lower().split()
    joined = b" ".join(own)
    if len(own) <= words:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in own))
    spans = zip([0, *ends[:-words]], ends[words - 1 :], strict=True)
    return np.unique(np.fromiter((xxh64_intdigest(joined[s : e - 1], 42) for s, e in spans), np.uint64, len(own) - words + 1))


def _text_of(text: str) -> Column:
    return F.xxhash64(ascii_lower(F.col(text)))


def _least_shared(a, b, similarity: float):
    """How many shingles sets of these sizes share at least if they are alike; rounded so that no alike pair is lost."""
    return np.ceil(similarity / (1 + similarity) * (a + b) - 1e-6)


def _slot_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes fall into each slot."""
    slots = 1 << max(6, (len(hashes) // SLOT_SHINGLES).bit_length())
    return np.bincount((hashes >> np.uint64(32)).astype(np.int64) & (slots - 1), minlength=slots).astype("<u4")


def _most_shared(a: np.ndarray, b: np.ndarray) -> int:
    """A bound of the shingles that two texts share, from their counts; the finer ones are added up to the coarser."""
    slots = min(len(a), len(b))
    return int(np.minimum(a.reshape(-1, slots).sum(0), b.reshape(-1, slots).sum(0)).sum())


def _runs(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[pa.Table]:
    """Tables of consecutive rows with one value of ``name``, from rows that are sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(name).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            if held and held[-1].column(name)[0].as_py() != int(key[s]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _frequent(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several texts of a sample have, ascending, and the rank of each by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [shingle_hashes(t, words).view(np.int64) for t in python_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(every) if every else [], pa.int64())], names=["key"])

    part = max(1, texts.count() // SAMPLED)
    counted = texts.where(F.pmod(F.xxhash64("node"), F.lit(part)) == 0).select("text").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n"))
    found = counted.where("n > 1").orderBy(F.desc("n"), "key").limit(MAX_LISTED).toArrow()
    keys, n = found["key"].to_numpy().view(np.uint64), found["n"].to_numpy()
    rank = np.empty(len(keys), np.int32)
    rank[np.lexsort((keys, n))] = np.arange(len(keys), dtype=np.int32)
    order = np.argsort(keys)
    return keys[order], rank[order]


def _prefix(hashes: np.ndarray, similarity: float, keys: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles, rarest ones first, of which an alike text has at least one among its own first ones."""
    size = len(hashes) - int(np.ceil(similarity * len(hashes) - 1e-6)) + 1
    if not len(keys):
        return hashes[:size]
    at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
    listed = keys[at] == hashes
    rare = hashes[~listed][:size]
    if len(rare) == size:
        return rare
    return np.concatenate([rare, hashes[listed][np.argsort(rank[at[listed]])][: size - len(rare)]])


def _spanning(sets: list[np.ndarray], across: np.ndarray | None, similarity: float) -> list[tuple[int, int]]:
    """Alike pairs that connect what all alike pairs connect, at most one less than there are ``sets``.

    With ``across`` (a side for each set), only pairs of different sides are compared.
    """
    sizes = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, slot, n = np.unique(every, return_inverse=True, return_counts=True)
    shared = n[slot] > 1
    number = np.cumsum(n > 1) - 1
    slot, owner = number[slot[shared]], owner[shared]
    order = np.argsort(slot, kind="stable")
    slot, owner = slot[order], owner[order]
    left, right = (np.arange(len(sets)),) * 2 if across is None else (np.flatnonzero(~across), np.flatnonzero(across))
    met = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int((n > 1).sum()), 4_096):  # exact: float32 counts up to 2**24
        s, e = np.searchsorted(slot, [first, first + 4_096])
        has = np.zeros((len(sets), 4_096), np.float32)
        has[owner[s:e], slot[s:e] - first] = 1
        met += has[left] @ has[right].T
    i, j = np.nonzero(met >= similarity * (sizes[left][:, None] + sizes[right][None, :] - met) - 1e-6)
    up = list(range(len(sets)))
    out = []
    for x, y in zip(left[i].tolist(), right[j].tolist(), strict=True):
        a, b = x, y
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[max(a, b)] = min(a, b)
            out.append((x, y))
    return out


def near_pairs(df: DataFrame, text: str = "text", *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``a, b``: hashes of texts (A-Z lower-cased) that are alike. Every alike pair is among them or connected by them."""
    texts = df.select(_text_of(text).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keys, rank = _frequent(texts, words)
    listed = shipped(df.sparkSession, keys.tobytes()), shipped(df.sparkSession, rank.tobytes())

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rank = np.frombuffer(listed[0].value, np.uint64), np.frombuffer(listed[1].value, np.int32)
        for batch in batches:
            every = [shingle_hashes(t, words) for t in python_texts(batch.column("text"))]
            first = pa.array([_prefix(h, similarity, keys, rank).view(np.int64) for h in every], pa.list_(pa.int64()))
            counts = [_slot_counts(h).tobytes() for h in every]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(map(len, every), pa.int32()), pa.array(counts, pa.binary()), first], names=["node", "size", "counts", "first"])

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "star"):
            node, size = run["node"].to_numpy(), run["size"].to_numpy().astype(np.int64)
            i, j = np.triu_indices(len(node), 1)
            least = _least_shared(size[i], size[j], similarity)
            fits = np.minimum(size[i], size[j]) >= least
            i, j, least = i[fits], j[fits], least[fits]
            counts = [np.frombuffer(c, "<u4") for c in run["counts"].to_pylist()]
            fits = np.array([_most_shared(counts[x], counts[y]) >= n for x, y, n in zip(i, j, least, strict=True)], bool)
            i, j = i[fits], j[fits]
            if len(i) > MOST_PAIRS * len(node):
                yield pa.RecordBatch.from_arrays([pa.array([run["star"][0].as_py()], pa.int64()), pa.array([None], pa.int64())], names=["a", "b"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str | None, set[bytes]] = (None, set())
        for batch in batches:
            alike = []
            for x, y in zip(python_texts(batch.column("text_a")), python_texts(batch.column("text_b")), strict=True):
                if x != last[0]:
                    last = (x, shingles(x, words))
                other = shingles(y, words)
                common = len(last[1] & other)
                alike.append(common >= similarity * (len(last[1]) + len(other) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _runs(batches, "cell"):
            node, side = run["node"].to_numpy(), run["side"].to_numpy(zero_copy_only=False)
            sets = [shingle_hashes(t, words) for c in run["text"].chunks for t in python_texts(c)]
            found = np.array(_spanning(sets, side if side.any() else None, similarity), np.int64).reshape(-1, 2)
            a, b = node[found[:, 0]], node[found[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    known = saved(texts.mapInArrow(prefixes, "node long, size int, counts binary, first array<long>"), "near-prefixes")
    entries = known.select("node", F.explode("first").alias("key"))
    here = Window.partitionBy("key")
    met = entries.select("node", F.min("node").over(here).alias("star"), F.max("node").over(here).alias("other")).where("star <> other")
    stars = saved(met.select("star", "node").distinct(), "near-stars")
    sizes = known.join(stars.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("size").alias("size"), F.first("counts").alias("counts"))
    rows = saved(stars.join(sizes, "node"), "near-members")
    of_star = saved(rows.groupBy("star").agg(F.count("*").alias("n"), F.sum("size").alias("shingles")), "near-star-sizes")
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("shingles") / BLOCK_SHINGLES)).cast("int")

    small = rows.join(of_star.where(F.col("n") <= SMALL_STAR).select("star"), "star", "left_semi").repartition("star").sortWithinPartitions("star")
    told = saved(small.mapInArrow(paired, "a long, b long").distinct(), "near-candidates")
    pairs, dense = told.where("b is not null"), told.where("b is null").select(F.col("a").alias("star"))  # a star whose pairs are too many names itself
    wide = of_star.join(dense, "star", "left_semi").unionByName(of_star.where(F.col("n") > SMALL_STAR))
    large = rows.select("star", "node").join(wide.select("star", blocks.alias("blocks")), "star")
    # a block meets itself and every other one, each in a cell of its own
    own = F.pmod(F.xxhash64("node", "star"), "blocks").cast("int")
    large = large.withColumn("own", own).select("star", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    cells = saved(large.select(F.xxhash64("star", F.least("own", "block"), F.greatest("own", "block")).alias("cell"), "node", (F.col("own") > F.col("block")).alias("side")), "near-cells")

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(cells.select("node")).distinct()
    needed = saved(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "near-texts")
    sided = pairs.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    alike = sided.mapInArrow(verify, "a long, b long")
    spanning = cells.join(needed, "node").repartition("cell").sortWithinPartitions("cell").mapInArrow(compared, "a long, b long")
    return saved(alike.unionByName(spanning).distinct(), "near-alike")


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``node, component, keep``: for each text (its hash) that is like another one its group, and whether its document stays.

    The text of the group's largest identifier stays, nulls being the smallest, and of equal ones that of the largest hash.
    """
    found = components(saved(near_pairs(df, text, **options), "near-pairs"))
    own = df.select(_text_of(text).alias("node"), F.col(doc_id).alias("id")).join(found.select("node"), "node", "left_semi").groupBy("node").agg(F.max("id").alias("id"))
    place = F.struct(F.col("id").isNotNull().alias("named"), "id", "node")
    placed = saved(found.join(own, "node").select("node", "component", place.alias("place")), "near-nodes")
    best = placed.groupBy("component").agg(F.max("place").alias("best"))
    return placed.join(best, "component").select("node", "component", F.col("place").eqNullSafe(F.col("best")).alias("keep"))


def without_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` whose text isn't like that of another row that stays."""
    gone = saved(near_groups(df, doc_id, text, **options).where("not keep").select("node"), "near-gone")
    node = free_name(df, "node")
    return df.withColumn(node, _text_of(text)).join(gone.withColumnRenamed("node", node), node, "left_anti").select(*df.columns)
