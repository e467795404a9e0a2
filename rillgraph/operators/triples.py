"""The triple store: named graphs as one DataFrame, with set semantics, edits, catalogue reads and export."""

from __future__ import annotations

import os
from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import qualified
from ..sources import rdf
from ..sources.rdf import SCHEMA, Term
from ..vocab import XSD, Vocabulary

MAIN, UNION = "main", "union"
KEY = ["s", "p", "o", "o_kind", "o_datatype", "o_lang"]


def when_text(at: datetime) -> Term:
    at = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at.astimezone(timezone.utc)
    return Term(at.isoformat(), "lit", XSD + "dateTime")


def union_graph(triples: DataFrame, ontologies: DataFrame | None = None, imports: str = "http://www.w3.org/2002/07/owl#imports") -> DataFrame:
    """Main triples plus those of every ontology that main imports, directly or not. ``ontologies``: same columns, ``g`` names the ontology."""
    main = triples.where(F.col("g") == MAIN)
    if ontologies is None:
        return main.withColumn("g", F.lit(UNION)).dropDuplicates(KEY)
    wanted = main.where(F.col("p") == imports).select(F.col("o").alias("g")).distinct()
    links = ontologies.where(F.col("p") == imports).select(F.col("g").alias("from"), F.col("o").alias("g")).distinct()
    count, seen = -1, wanted
    while True:  # as often as the import tree is deep
        n = seen.count()
        if n == count:
            break
        count = n
        seen = seen.unionByName(links.join(seen.withColumnRenamed("g", "from"), "from").select("g")).distinct()
    closure = ontologies.join(seen, "g", "left_semi")
    return main.unionByName(closure).withColumn("g", F.lit(UNION)).dropDuplicates(KEY)


class TripleStore:
    """Triples in memory of the session, or in versions below ``path``; every edit of the latter is written and reread."""

    def __init__(self, spark: SparkSession, vocab: Vocabulary | None = None, path: str | None = None):
        self.spark, self.vocab, self.path = spark, vocab or Vocabulary(), path
        self.version, self.registry, self.ontologies = 0, {}, None
        self.triples = spark.createDataFrame([], SCHEMA)
        self._union: DataFrame | None = None

    def _put(self, df: DataFrame) -> None:
        if self.path:
            self.version += 1
            at = os.path.join(self.path, f"v{self.version}")
            df.repartition("p").sortWithinPartitions("p", "s").write.mode("overwrite").parquet(at)
            df = self.spark.read.schema(SCHEMA).parquet(at)
        self.triples, self._union = df, None

    # loading and closure

    def load(self, text_or_path: str, format: str = "turtle", replace: bool = False) -> dict[str, int]:
        text = text_or_path
        if "\n" not in text and os.path.exists(text):
            with open(text, encoding="utf-8") as f:
                text = f.read()
        new = rdf.to_frame(self.spark, rdf.parse(text, format, scoped=True), MAIN)
        old = self.triples.where(F.col("g") != MAIN) if replace else self.triples
        self._put(old.unionByName(new).distinct())
        return self.counts()

    def register_ontology(self, iri: str, text_or_path: str, format: str = "turtle") -> None:
        text = text_or_path
        if "\n" not in text and os.path.exists(text):
            with open(text, encoding="utf-8") as f:
                text = f.read()
        new = rdf.to_frame(self.spark, rdf.parse(text, format, scoped=True), iri)
        self.registry[iri] = text_or_path
        self.ontologies = new if self.ontologies is None else self.ontologies.where(F.col("g") != iri).unionByName(new)
        self._union = None

    def ensure_root(self, iri: str, imports: Iterable[str]) -> None:
        self.add([(iri, self.vocab.type, Term("http://www.w3.org/2002/07/owl#Ontology")), *((iri, self.vocab.imports, Term(i)) for i in imports)])

    def main(self) -> DataFrame:
        return self.triples.where(F.col("g") == MAIN)

    def union(self) -> DataFrame:
        if self._union is None:
            self._union = union_graph(self.triples, self.ontologies, self.vocab.imports)
        return self._union

    def graph(self, use_union: bool = False) -> DataFrame:
        return self.union() if use_union else self.main()

    def counts(self) -> dict[str, int]:
        return {"main": self.main().count(), "union": self.union().count()}

    # edits

    def add(self, triples: Iterable[rdf.Triple]) -> None:
        self._put(self.triples.unionByName(rdf.to_frame(self.spark, triples, MAIN)).distinct())

    def remove(self, triples: Iterable[rdf.Triple]) -> None:
        gone = rdf.to_frame(self.spark, triples, MAIN)
        self._put(self.triples.alias("t").join(gone.alias("d"), [F.col(f"t.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ["g", *KEY]], "left_anti"))

    def set(self, triples: Iterable[rdf.Triple]) -> None:
        """Replace every value of the given (subject, predicate) pairs."""
        triples = list(triples)
        new = rdf.to_frame(self.spark, triples, MAIN)
        self._put(self.triples.join(new.select("g", "s", "p").distinct(), ["g", "s", "p"], "left_anti").unionByName(new))

    def delete(self, uri: str) -> None:
        """Remove a node as subject and as object."""
        self._put(self.triples.where((F.col("s") != uri) & ~((F.col("o") == uri) & (F.col("o_kind") != "lit"))))

    def qualify(self, uri: str, base: str | None = None) -> str:
        if "://" in uri or uri.startswith("urn:"):
            return uri
        if base:
            return base + ("" if base.endswith(("/", "#")) else "/") + uri
        return self.vocab.points + uri

    # points

    def upsert_node(self, uri: str, types: Iterable[str] = (), unit: str | None = None) -> str:
        uri, v = self.qualify(uri), self.vocab
        self.add([(uri, v.type, Term(t)) for t in dict.fromkeys([*types, v.term("Stream")])])
        if unit:
            self.set([(uri, v.has_unit, Term(unit) if "://" in unit or unit.startswith("urn:") else Term(unit, "lit", XSD + "string"))])
        return uri

    def register_virtual_point(self, uri: str, sources: Iterable[str], types: Iterable[str] = (), unit: str | None = None) -> str:
        uri = self.upsert_node(uri, types, unit)
        self.set([(uri, self.vocab.term("isCalculatedFrom"), Term(s)) for s in sources])
        return uri

    def record_last_reported(self, uri: str, at: datetime, now: datetime | None = None) -> None:
        self.set([(uri, self.vocab.term("lastReported"), when_text(at)), (uri, self.vocab.term("lastInputChange"), when_text(now or datetime.now(timezone.utc)))])

    def set_last_run(self, uri: str, at: datetime) -> None:
        self.set([(uri, self.vocab.term("lastRun"), when_text(at))])

    def upsert_sensor(self, uri: str, module: str, version: str, sources: Iterable[str]) -> None:
        v = self.vocab
        self.set([(uri, v.term("hasModule"), Term(module, "lit", XSD + "string")), (uri, v.term("hasVersion"), Term(version, "lit", XSD + "string")), *((uri, v.term("dependsOn"), Term(s)) for s in sources)])
        self.add([(uri, v.type, Term(v.term("SoftSensor")))])

    def points(self) -> DataFrame:
        """``uri, name, types, unit, last_reported, sources`` of every node typed as a stream."""
        v, t = self.vocab, self.main()
        streams = t.where((F.col("p") == v.type) & (F.col("o") == v.term("Stream"))).select("s").distinct()
        value = lambda p: F.when(F.col("p") == p, F.col("o"))
        return (
            t.where(F.col("p").isin(v.type, v.has_unit, v.term("lastReported"), v.term("isCalculatedFrom")))
            .join(streams, "s", "left_semi")
            .groupBy(F.col("s").alias("uri"))
            .agg(F.array_sort(F.collect_set(value(v.type))).alias("types"), F.min(value(v.has_unit)).alias("unit"), F.max(value(v.term("lastReported"))).alias("last_reported"), F.array_sort(F.collect_set(value(v.term("isCalculatedFrom")))).alias("sources"))
            .withColumn("name", F.when(F.col("uri").startswith(v.points), F.substr("uri", F.lit(len(v.points) + 1))).otherwise(F.col("uri")))
        )

    def point(self, uri: str) -> dict | None:
        row = self.points().where(F.col("uri") == self.qualify(uri)).first()
        return row.asDict() if row else None

    def points_by_type(self, cls: str) -> DataFrame:
        return self.points().where(F.array_contains("types", cls))

    def value(self, uri: str, name: str) -> str | None:
        """The smallest value of one of the engine's own properties, such as ``lastRun``."""
        return self.main().where((F.col("s") == uri) & (F.col("p") == self.vocab.term(name))).agg(F.min("o")).first()[0]

    # export

    def export(self, path: str | None = None, use_union: bool = False):
        """N-Triples lines as a DataFrame, or written below ``path``."""
        lines = rdf.ntriples(self.graph(use_union))
        return lines.write.mode("overwrite").text(path) if path else lines


def qualify_column(uri, base, vocab: Vocabulary):
    return qualified(uri, base, vocab.points)
