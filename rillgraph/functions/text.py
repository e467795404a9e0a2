"""Text to identifiers: normalisation, string similarities, concept matching against a lexicon, and lexicon building."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_KEPT = re.compile(r"[A-Za-z0-9]+")


def normalize(text: str) -> str:
    flat = "".join(c for c in unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text.strip())) if not unicodedata.combining(c))
    return " ".join(_KEPT.findall(_HUMP.sub(" ", flat).replace("_", " ").replace("-", " ").lower()))


def tokens(text: str) -> list[str]:
    return [t[:-1] if len(t) > 3 and t.endswith("s") else t for t in normalize(text).split()]


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = set(a), set(b)
    return 1.0 if not x and not y else len(x & y) / len(x | y)


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


def initialism(words: list[str]) -> str:
    return "".join(w[0] for w in words if w)


def edit_distance(a: str, b: str, most: int) -> int:
    """Optimal string alignment (neighbouring letters may swap); ``most + 1`` once it must be above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        rows = [rows[-1], row]
    return min(rows[-1][-1], most + 1)


@dataclass(frozen=True)
class Concept:
    uri: str
    kind: str
    label: str = ""
    surfaces: tuple[str, ...] = ()


#: Weights and limits of the match score.
JACCARD_WEIGHT, RATIO_WEIGHT, INITIALISM_BONUS, EDIT_STEP, LENGTH_PENALTY, MIN_SCORE = 0.62, 0.32, 0.12, 0.03, 0.08, 0.55


def pair_score(query: str, surface: str) -> float | None:
    """Score of one query form against one surface; None if it isn't a candidate."""
    q, s = normalize(query), normalize(surface)
    if q == s:
        return 1.0
    tq, ts = tokens(query), tokens(surface)
    j, r = jaccard(tq, ts), ratio(q, s)
    if j == 0 and r < 0.85:
        return None
    bonus = INITIALISM_BONUS if tq and ts and initialism(tq) == initialism(ts) else 0.0
    if r > 0.70 or j > 0.50:
        most = 2 if len(q) <= 10 else 3
        d = edit_distance(q, s, most)
        if d <= most:
            bonus += (most - d) * EDIT_STEP
    penalty = LENGTH_PENALTY if len(ts) - len(tq) >= 3 and j < 0.8 else 0.0
    return JACCARD_WEIGHT * j + RATIO_WEIGHT * r + bonus - penalty


@dataclass
class Lexicon:
    concepts: list[Concept] = field(default_factory=list)
    abbreviations: dict[str, list[str]] = field(default_factory=dict)

    @classmethod
    def read(cls, path: str) -> Lexicon:
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        return cls([Concept(u, c.get("kind", ""), c.get("label", ""), tuple(c.get("surfaces", ()))) for u, c in raw.get("concepts", {}).items()], raw.get("abbrev", {}))

    def forms(self, text: str) -> list[str]:
        return [text, *self.abbreviations.get(normalize(text), [])]

    def match(self, text: str, kind: str | None = None, top_k: int = 5, min_score: float = MIN_SCORE) -> list[tuple[str, str, float]]:
        """Best score of each concept, best first; ties keep lexicon order."""
        best: dict[tuple[str, str], float] = {}
        for c in self.concepts:
            if kind is not None and c.kind != kind:
                continue
            for form in self.forms(text):
                for surface in dict.fromkeys((*c.surfaces, *([c.label] if c.label else []))):
                    score = pair_score(form, surface)
                    if score is not None and score >= min_score and score > best.get((c.uri, c.kind), 0.0):
                        best[c.uri, c.kind] = score
        return [(u, k, s) for (u, k), s in sorted(best.items(), key=lambda x: -x[1])[:top_k]]

    def resolve(self, text: str, kind: str | None = None) -> str:
        if text.startswith(("http", "urn:")) or "://" in text:
            return text
        if not self.concepts:
            return text
        found = self.match(text, kind, 1)
        if not found:
            raise ValueError(f"nothing in the lexicon is like {text!r}")
        return found[0][0]


def match_all(df: DataFrame, lexicon: Lexicon, text: str, kind: str | None = None, top_k: int = 1) -> DataFrame:
    """``text, uri, kind, score`` for a column of texts. The lexicon is a driver-side object and goes to all tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(t, *m) for t in frame[text].dropna() for m in lexicon.match(t, kind, top_k)]
            yield pd.DataFrame(rows, columns=["text", "uri", "kind", "score"])

    return df.select(text).distinct().mapInPandas(run, "text string, uri string, kind string, score double")


def build_lexicon(triples: DataFrame) -> DataFrame:
    """``uri, kind, surfaces``: classes, predicates and units of a graph with their labels and local names."""
    from ..vocab import OWL, QUDT, RDF_TYPE, RDFS
    from .expressions import local_name

    t = triples
    classes = t.where((F.col("p") == RDF_TYPE) & F.col("o").isin(RDFS + "Class", OWL + "Class")).select(F.col("s").alias("uri"))
    classes = classes.unionByName(t.where(F.col("p") == RDFS + "subClassOf").select(F.explode(F.array("s", "o")).alias("uri")))
    units = t.where((F.col("p") == RDF_TYPE) & (F.col("o") == QUDT + "Unit")).select(F.col("s").alias("uri"))
    kinds = classes.withColumn("kind", F.lit("class")).unionByName(units.withColumn("kind", F.lit("unit"))).unionByName(t.select(F.col("p").alias("uri")).withColumn("kind", F.lit("predicate")))
    labels = t.where(F.col("p").isin(RDFS + "label", "http://www.w3.org/2004/02/skos/core#prefLabel", "http://www.w3.org/2004/02/skos/core#altLabel", QUDT + "symbol")).select(F.col("s").alias("uri"), F.col("o").alias("surface"))
    named = kinds.where("uri not like '\\_:%'").distinct()
    surfaces = named.join(labels, "uri").select("uri", "kind", "surface").unionByName(named.select("uri", "kind", local_name(F.col("uri")).alias("surface")))
    return surfaces.groupBy("uri", "kind").agg(F.array_sort(F.collect_set("surface")).alias("surfaces"))
