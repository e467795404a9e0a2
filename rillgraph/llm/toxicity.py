"""Toxicity from the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are the lower-cased words of the labelled sample, all of them. A term's weight in a text is (1 + ln occurrences) *
idf * relevance: idf = ln((1 + N) / (1 + df)) over all N documents of the corpus, and relevance = ``BASE`` plus the
term's phi coefficient with the label in the sample, as far as its chi-square is above 2 ln(number of terms), which about one
term passes by chance. The relevance keeps what a text is
about from hiding what it is called; no term is left out. Vectors have length 1.

The index holds, for each term, the examples that have it and their weights, in blocks of examples, and the largest
weight in each block. A query's product with these maxima bounds its cosine with every example of a block. The
``FIRST`` blocks of the largest bounds are read first, and of the others only those whose bound reaches the k-th best
similarity found, so the k neighbours are exactly those of a full scan (similarities to 5 digits, of equal ones the smaller identifier). Examples
stand in the order of their most telling and their most frequent term, which keeps the bounds of a block tight.

Votes are weighted by inverse distance, and an isotonic map fitted to leave-one-out votes makes them probabilities.

The classifier is fitted on a bounded sample: at most ``max_examples`` labelled rows, those with the smallest hash of
their id among all that may be learnt from. Document frequencies are counted over all documents, and every text is
scored whole.

Defined cases. A text without a known word has no neighbour and gets the sample's share of toxic rows. Null labels and
null ids don't take part in learning; of contradicting labels of one id the larger counts, of rows that share an id the
smallest text. No labelled rows: score 0 and no evidence. Repeated rows are scored alike. Invalid UTF-8 is read with
replacement characters. Extra columns pass through; taken names raise ``ValueError``.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import is_held_out, python_texts, saved, shipped

_WORD = re.compile(r"[^\W\d_]+")

#: The relevance of a term that tells nothing.
BASE = 0.02

#: Terms that one example in so many has are multiplied block by block as dense rows, the others by their postings.
DENSE_PART = 16

#: Blocks with the largest bounds, which are read first; of the others those are that can still matter.
FIRST = 8


def terms(text: str | None) -> Counter:
    """Occurrences of every word of a text."""
    return Counter(_WORD.findall((text or "").lower()))


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all the given ranges, one after another."""
    before = np.concatenate([[0], sizes.cumsum()[:-1]]) if len(sizes) else sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


class BlockMaxIndex:
    """Postings of sparse unit vectors: rows (term, example, weight), sorted by term and example."""

    def __init__(self, term: np.ndarray, example: np.ndarray, weight: np.ndarray, n_terms: int, n_examples: int, block: int = 64):
        self.block, self.n, self.n_blocks = block, n_examples, -(-n_examples // block)
        order = np.lexsort((example, term))
        self.example, self.weight = example[order].astype(np.int32), weight[order].astype(np.float32)
        cell = term[order] * max(1, self.n_blocks) + self.example // block
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        # a cell is a term's part of a block
        self.cell_start = first.astype(np.int64)
        self.cell_size = np.diff(np.concatenate([first, [len(cell)]])).astype(np.int32)
        self.cell_block = (cell[first] % max(1, self.n_blocks)).astype(np.int32)
        self.cell_max = (np.maximum.reduceat(self.weight, first) if len(first) else np.zeros(0)).astype(np.float32)
        self.term_start = np.searchsorted(cell[first] // max(1, self.n_blocks), np.arange(n_terms + 1))
        held = np.bincount(term, minlength=n_terms)
        self.dense_row = np.full(n_terms, -1, np.int32)
        self.dense_row[held * DENSE_PART >= max(n_examples, 1)] = np.arange(int((held * DENSE_PART >= max(n_examples, 1)).sum()))
        self._dense: tuple[np.ndarray, np.ndarray] | None = None
        self.read = self.all = 0  # blocks read, and blocks that had any of the terms
        self.rank: np.ndarray | None = None

    def nearest(self, query: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Similarities and numbers (-1: none) of the k nearest examples of n queries, given as rows (query, term, weight)."""
        best, who = np.full((n, k), -1.0), np.full((n, k), -1, np.int64)
        if not n or not self.n:
            return best, who
        dense, dense_max = self.dense()
        row = self.dense_row[term]
        often = np.zeros((n, len(dense)), np.float32)
        often[query[row >= 0], row[row >= 0]] = weight[row >= 0]
        query, term, weight = query[row < 0], term[row < 0], weight[row < 0]
        count = self.term_start[term + 1] - self.term_start[term]
        cells = _ranges(self.term_start[term], count)
        of, by = np.repeat(query.astype(np.int32), count), np.repeat(weight.astype(np.float32), count)
        pair = of * np.int32(self.n_blocks) + self.cell_block[cells]
        bound = np.bincount(pair, by * self.cell_max[cells], n * self.n_blocks).reshape(n, self.n_blocks) + often @ dense_max
        first = np.zeros((n, self.n_blocks), bool)
        np.put_along_axis(first, np.argsort(-bound, axis=1, kind="stable")[:, :FIRST], True, axis=1)
        first &= bound > 0
        self.all += int((bound > 0).sum())
        for wave in (0, 1):
            wanted = first if wave == 0 else ~first & (bound > 0) & (bound + 2e-5 >= best[:, -1:])
            if not wanted.any():
                continue
            self.read += int(wanted.sum())
            use = np.flatnonzero(wanted.ravel()[pair])
            c = cells[use]
            sizes = self.cell_size[c]
            post = _ranges(self.cell_start[c], sizes)
            at = np.repeat(of[use] * np.int32(self.n), sizes)
            at += self.example[post]
            by_post = np.repeat(by[use], sizes)
            by_post *= self.weight[post]
            found = np.bincount(at, by_post, n * self.n).reshape(n, self.n).astype(np.float64)
            for b in np.flatnonzero(wanted.any(0)):
                own = np.flatnonzero(wanted[:, b])
                found[own, b * self.block : (b + 1) * self.block] += often[own] @ dense[:, b * self.block : (b + 1) * self.block]
            if skip is not None:
                found[np.arange(n), skip] = 0
            least = np.maximum(best[:, -1], 1e-6) - 1e-6
            for i in range(n):
                row = found[i]
                if wave == 0 and len(row) > 4 * k:
                    least[i] = max(least[i], np.partition(row, -k)[-k] - 1e-6)
                hit = np.flatnonzero(row >= least[i])
                hit = hit[row[hit] > 0]
                if len(hit):
                    every, named = np.concatenate([best[i], np.round(row[hit], 5)]), np.concatenate([who[i], hit])
                    top = np.lexsort((self.tie(named), -every))[:k]
                    best[i], who[i] = every[top], named[top]
        return best, who

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of frequent terms in all examples, and their maxima in each block."""
        if self._dense is None:
            terms_ = np.flatnonzero(self.dense_row >= 0)
            out = np.zeros((len(terms_), self.n_blocks * self.block), np.float32)
            for i, t in enumerate(terms_):
                lo, hi = self.cell_start[self.term_start[t]], self.cell_start[self.term_start[t + 1] - 1] + self.cell_size[self.term_start[t + 1] - 1]
                out[i, self.example[lo:hi]] = self.weight[lo:hi]
            self._dense = out[:, : self.n], out.reshape(len(terms_), self.n_blocks, self.block).max(2)
        return self._dense

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_dense": None}

    def tie(self, examples: np.ndarray) -> np.ndarray:
        """What orders examples of equal similarity."""
        return examples if self.rank is None else self.rank[examples]


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing function nearest to (x, y), by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # value, weight, from, to
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([b, 1.0, a, a])
        while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][3] == pools[-1][2]):
            v, w, _, to = pools.pop()
            p = pools[-1]
            p[0], p[1], p[3] = (p[0] * p[1] + v * w) / (p[1] + w), p[1] + w, to
    knots = [(at, v) for v, _, lo, hi in pools for at in dict.fromkeys((lo, hi))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


class Model:
    """Vocabulary, weights, example index and calibration."""

    def __init__(self, examples: list[tuple[int, int, str | None]], vocabulary: list[str], df: np.ndarray, n_documents: int, k: int = 15, block: int = 64):
        """``examples``: identifier, label and text; ``df``: documents with each term of the vocabulary."""
        rows = [(i, toxic, terms(t), t) for i, toxic, t in examples]
        self.k, self.vocabulary = k, {t: j for j, t in enumerate(vocabulary)}
        n, p = len(rows), sum(r[1] for r in rows)
        a, b = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
        for _, toxic, own, _ in rows:
            (a if toxic else b)[[self.vocabulary[t] for t in own]] += 1
        c, d = p - a, (n - p) - b
        chi = n * (a * d - b * c) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1)
        self.phi = np.sqrt(np.maximum(chi - 2 * np.log(max(len(vocabulary), 1)), 0) / max(n, 1))
        self.term_weight = (np.log((1 + n_documents) / (1 + np.minimum(df, n_documents))) * (BASE + self.phi)).astype(np.float64)
        # by the most telling term, then by the most frequent one
        telling = [max((self.vocabulary[t] for t in r[2]), key=lambda j: (self.phi[j], -j), default=-1) for r in rows]
        telling = [j if j >= 0 and self.phi[j] > 0 else -1 for j in telling]
        common = [max(r[2], key=lambda t: (r[2][t], t), default="") for r in rows]
        rows = [rows[i] for i in sorted(range(n), key=lambda i: (telling[i], common[i], rows[i][0]))]
        self.ids, self.labels = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64)
        self.share = float(self.labels.mean()) if n else 0.0
        queries = self.vectors([r[3] for r in rows])
        self.index = BlockMaxIndex(queries[1], queries[0], queries[2], len(vocabulary), n, block)
        # of equally similar examples the smaller identifier comes first
        self.index.rank = np.argsort(np.argsort(self.ids, kind="stable"), kind="stable")
        raw, some = np.zeros(n), np.zeros(n, bool)
        for s in range(0, n, 64):
            part = self.vectors([r[3] for r in rows[s : s + 64]])
            size = min(64, n - s)
            similar, who = self.index.nearest(*part, size, k, np.arange(s, s + size))
            raw[s : s + size], some[s : s + size] = self.votes(similar, who), who[:, 0] >= 0
        self.knots = isotonic(raw[some], self.labels[some]) if some.any() else (np.zeros(1), np.full(1, self.share))

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows (text, term, weight) of the unit vectors of texts."""
        known = self.vocabulary.get
        own = [np.array([j for j in map(known, _WORD.findall((t or "").lower())) if j is not None], np.int64) for t in texts]
        size = len(self.vocabulary)
        flat, n = np.unique(np.concatenate([*(x + i * size for i, x in enumerate(own)), np.zeros(0, np.int64)]), return_counts=True)
        which, term = flat // max(size, 1), flat % max(size, 1)
        weight = (1 + np.log(n)) * self.term_weight[term]
        length = np.sqrt(np.bincount(which, weight * weight, len(own)))
        keep = weight > 0
        return which[keep], term[keep], weight[keep] / length[which[keep]]

    def votes(self, similar: np.ndarray, who: np.ndarray) -> np.ndarray:
        weight = np.where(who >= 0, 1 / (1.05 - np.clip(similar, 0, 1)), 0)
        return (weight * self.labels[np.maximum(who, 0)]).sum(1) / np.maximum(weight.sum(1), 1e-9) if len(self.labels) else np.zeros(len(who))

    def score(self, texts: list[str | None]) -> list[tuple[float, list[dict]]]:
        """Probability and the three nearest examples of each text."""
        out = []
        for s in range(0, len(texts), 64):
            part = texts[s : s + 64]
            similar, who = self.index.nearest(*self.vectors(part), len(part), self.k)
            p = np.where(who[:, 0] >= 0, np.clip(np.interp(self.votes(similar, who), *self.knots), 0, 1), self.share)
            for i in range(len(part)):
                near = [{"doc_id": int(self.ids[w]), "similarity": float(v), "toxic": int(self.labels[w])} for v, w in zip(similar[i, :3], who[i, :3], strict=True) if w >= 0]
                out.append((round(float(p[i]), 6), near))
        return out


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[np.ndarray, int]:
    """Documents that have each term, and the number of all documents."""
    sent = shipped(docs.sparkSession, pickle.dumps(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {t: j for j, t in enumerate(pickle.loads(sent.value))}
        found, n = np.zeros(len(known), np.int64), 0
        for batch in batches:
            for text in python_texts(batch.column("text")):
                n += 1
                if text:
                    found[[known[w] for w in known.keys() & set(_WORD.findall(text.lower()))]] += 1
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at, -1], pa.int64()), pa.array([*found[at], n], pa.int64())], names=["term", "n"])

    total = docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # at most one row for each term
    at, n = total["term"].to_numpy(), total["n"].to_numpy()
    out = np.zeros(len(vocabulary), np.int64)
    out[at[at >= 0]] = n[at >= 0]
    return out, int(n[at < 0].sum())


def fit(docs: DataFrame, labels: DataFrame, *, max_examples: int = 4096, k: int = 15, block: int = 64) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, toxic), never from held-out labels."""
    chosen = labels.where("toxic is not null and doc_id is not null").where(~is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)  # at most max_examples rows of two numbers: safe to send to all tasks
    examples = saved(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-examples")

    rows = sorted((r.doc_id, r.toxic, r.text) for r in examples.select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text")).toLocalIterator())  # at most max_examples texts
    vocabulary = sorted({t for r in rows for t in terms(r[2])})
    return Model(rows, vocabulary, *frequencies(docs, vocabulary), k, block)


EVIDENCE = T.ArrayType(T.StructType().add("doc_id", "long").add("similarity", "double").add("toxic", "integer"))
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score", evidence: str = "evidence") -> DataFrame:
    """``df`` with the probability of the toxic label and the nearest examples. No shuffle."""
    if taken := {out.lower(), evidence.lower()} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns already there: {sorted(taken)}")
    sent = shipped(df.sparkSession, pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(sent.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                found = own.score(python_texts(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], _EVIDENCE)], names=[*part.schema.names, out, evidence])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(evidence, EVIDENCE)]))
