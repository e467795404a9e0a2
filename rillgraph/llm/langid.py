"""Language identification with string kernels.

Every text becomes the set of its character 1-, 2- and 3-grams (blended spectrum, presence only); letters are
lower-cased, everything else is one space. The kernel of two texts is the number of grams they share over the geometric
mean of their set sizes. Grams are told apart exactly, by their code points. Nyström landmarks approximate the kernel:
with K the kernel among the landmarks, a text's features are its kernel values with them times K^(-1/2). One-versus-rest
ridge regression on these features is solved in closed form. Both products and the landmarks' grams fold into one weight
for each gram and language, so a batch is scored by one product of its presence matrix with these weights.

``score`` is confidence times ``known``. The confidence is the best margin over the sum of the distances of all margins
from the worst, so it is 1 over the number of languages without evidence and near 1 where one language stands out.
``known`` is the share of the text's grams that the learnt texts of the predicted language have. It falls for languages
that weren't learnt and for random letters. ``Model.cut`` is the share below which a text is like no learnt language:
``CUT_PART`` of what nearly all learnt texts reach when their own grams don't count.

Learning takes a bounded sample: of every language at most ``max_examples // 4`` rows, and ``max_examples`` in all, those
with the smallest hash of their id, and ``landmarks`` landmarks in turn from every language. All grams of the sample are
kept. Every text is scored whole.

Defined cases. Null texts and texts without a letter: ``und`` with score 0. Null ids and null languages are not learnt
from; of rows that share an id, the smallest language and text are. No rows to learn from: ``und``. Invalid UTF-8 is
read with replacement characters. Extra columns pass through; taken names raise ``ValueError``.
"""

from __future__ import annotations

import functools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, python_texts, saved, shipped

UNKNOWN = "und"

#: The part of the learnt texts' usual share of known grams that a text must have, and the quantile that is "usual".
CUT_PART, CUT_QUANTILE = 0.8, 0.01


@functools.cache
def _letters() -> np.ndarray:
    """For every code point: the lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.int64)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> np.ndarray | None:
    """All 1-, 2- and 3-grams as numbers of 21 bits a character, repeats included; None if there is no letter."""
    x = _letters()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    space = x == 32
    if space.all():
        return None
    if len(x) > 1:
        keep = np.ones(len(x), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        x = x[keep]
    x = np.concatenate([[32], x, [32]])
    two = (x[:-1] << 21) | x[1:]
    return np.concatenate([x, two, (two[:-1] << 21) | x[2:]])


class _Slots:
    """Positions of known grams: a table by a hash of the gram, and binary search for those that share a slot."""

    def __init__(self, dictionary: np.ndarray):
        self.dictionary = dictionary  # sorted
        self.bits = max(8, int(np.ceil(np.log2(max(len(dictionary), 1)))) + 3)
        self.table = np.full(1 << self.bits, -1, np.int32)
        h = self._slot(dictionary)
        self.table[h[::-1]] = np.arange(len(dictionary), dtype=np.int32)[::-1]
        self.second = len(np.unique(h)) < len(dictionary)

    def _slot(self, found: np.ndarray) -> np.ndarray:
        return (found.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def __call__(self, found: np.ndarray) -> tuple[np.ndarray, int]:
        """Distinct positions of the known grams, and the number of distinct unknown ones."""
        if not len(self.dictionary):
            return np.zeros(0, np.int64), len(np.unique(found))
        at = self.table[self._slot(found)]
        right = (at >= 0) & (self.dictionary[at] == found)
        rest = found[~right]
        own = at[right]
        if len(rest):
            rest = np.unique(rest)
            if self.second:
                i = np.minimum(np.searchsorted(self.dictionary, rest), len(self.dictionary) - 1)
                hit = self.dictionary[i] == rest
                own, rest = np.concatenate([own, i[hit]]), rest[~hit]
        seen = np.zeros(len(self.dictionary), bool)
        seen[own] = True
        return np.flatnonzero(seen), len(rest)


class Model:
    def __init__(self, texts: list[np.ndarray], languages: list[str], landmarks: int = 256, ridge: float = 1.0):
        """``texts``: distinct grams of each example."""
        self.languages = sorted(set(languages))
        dictionary = np.unique(np.concatenate([*texts, np.zeros(0, np.int64)]).astype(np.int64))
        self.slots = _Slots(dictionary)
        at = [np.searchsorted(dictionary, t) for t in texts]
        sizes = np.array([len(t) for t in texts], np.float64)
        # landmarks: examples taken in turn from every language
        of = np.array([self.languages.index(x) for x in languages], np.int64)
        rank = np.zeros(len(of), np.int64)
        for c in range(len(self.languages)):
            rank[of == c] = np.arange((of == c).sum())
        chosen = np.lexsort((of, rank))[:landmarks]
        # landmarks that have each gram, one list after another
        owner = np.concatenate([np.full(len(at[i]), k) for k, i in enumerate(chosen)] or [np.zeros(0, np.int64)])
        gram = np.concatenate([at[i] for i in chosen] or [np.zeros(0, np.int64)])
        owner = owner[np.argsort(gram, kind="stable")]
        starts = np.concatenate([[0], np.bincount(gram, minlength=len(dictionary)).cumsum()])
        kernel = np.zeros((len(texts), len(chosen)))
        for i, own in enumerate(at):
            n = starts[own + 1] - starts[own]
            where = np.repeat(starts[own] - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum())
            kernel[i] = np.bincount(owner[where], minlength=len(chosen))
        roots = np.sqrt(sizes[chosen])
        kernel /= np.sqrt(sizes)[:, None] * roots
        values, vectors = np.linalg.eigh(kernel[chosen])
        good = values > 1e-6 * max(values.max(initial=0), 1e-12)
        half = vectors[:, good] / np.sqrt(values[good])
        features = kernel @ half
        target = np.where(of[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        weight = (len(of) / (len(self.languages) * np.bincount(of, minlength=len(self.languages))))[of]  # each language counts alike
        left = features.T @ (features * weight[:, None]) + ridge * np.eye(features.shape[1])
        dual = half @ np.linalg.solve(left, features.T @ (target * weight[:, None]))
        # weights[g] = sum over the landmarks that have gram g of dual / root
        self.weights = np.zeros((len(dictionary), len(self.languages)))
        for k, i in enumerate(chosen):
            self.weights[at[i]] += dual[k] / roots[k]
        owners = np.zeros((len(dictionary), len(self.languages)), np.int32)
        for own, c in zip(at, of, strict=True):
            owners[own, c] += 1
        self.own = owners > 0
        # of a learnt text, grams of its own only don't count
        usual = [float((owners[own, c] > 1).mean()) for own, c in zip(at, of, strict=True)]
        self.cut = CUT_PART * float(np.quantile(usual, CUT_QUANTILE)) if usual else 0.0

    def margins(self, text: str) -> tuple[np.ndarray, np.ndarray, int] | None:
        """One margin for each language, positions of known grams, and the number of all grams."""
        if (found := grams(text)) is None:
            return None
        own, rest = self.slots(found)
        size = len(own) + rest
        return self.weights[own].sum(0) / np.sqrt(size), own, size

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Language, score and share of known grams of each text."""
        out: list[tuple[str, float, float]] = []
        for text in texts:
            found = self.margins(text) if text and self.languages else None
            if found is None:
                out.append((UNKNOWN, 0.0, 0.0))
                continue
            m, own, size = found
            best = int(m.argmax())
            known = float(self.own[own, best].sum()) / size
            spread = m - m.min()
            sure = spread[best] / spread.sum() if len(m) > 1 and spread.sum() > 1e-9 else 1.0 / len(m)
            out.append((self.languages[best], round(float(sure) * known, 6), round(known, 6)))
        return out


def fit(docs: DataFrame, *, max_examples: int = 4096, landmarks: int = 256, ridge: float = 1.0) -> Model:
    """A model from ``doc_id``, ``text`` and ``lang``, never from held-out rows."""
    usable = docs.where("lang is not null and text is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))  # limited before it shuffles
    first = usable.groupBy("doc_id").agg(F.min("lang").alias("lang")).withColumn("place", place).where(F.col("place") <= max_examples // 4)
    # at most max_examples rows of an id and a language: safe to send to all tasks
    chosen = first.orderBy("place", "lang").limit(max_examples).select("doc_id", "lang")
    examples = saved(usable.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")), "language-examples")

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                own = [np.zeros(0, np.int64) if (h := grams(t)) is None else np.unique(h) for t in python_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array(own, pa.list_(pa.int64()))], names=["doc_id", "lang", "grams"])

    # at most max_examples gram sets come to the driver
    rows = examples.mapInArrow(distinct, "doc_id long, lang string, grams array<long>").where("size(grams) > 0").toArrow()
    rows = sorted(zip(rows["doc_id"].to_pylist(), rows["lang"].to_pylist(), (np.asarray(x.values) for x in rows["grams"]), strict=True), key=lambda r: (r[0] * 2654435761 % 2**32, r[0]))
    return Model([r[2] for r in rows], [r[1] for r in rows], landmarks, ridge)


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """``df`` with the predicted language and a score from 0 to 1, and the share of known grams if it is given a name. No shuffle."""
    added = [out, score, *([known] if known else [])]
    if taken := {x.lower() for x in added} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    sent = shipped(df.sparkSession, pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = own.predict(python_texts(part.column(text)))
                new = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new[: len(added)]], names=[*part.schema.names, *added])

    fields = [T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType()), T.StructField("known", T.DoubleType())]
    fields[2] = T.StructField(known or "known", T.DoubleType())
    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields[: len(added)]]))
