"""The engine: graph, series, ingestion, derived series and queries behind one object."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .functions.text import Lexicon
from .operators.sensors import Sensors
from .operators.series import SeriesStore, info
from .operators.triples import TripleStore
from .plans import sparql
from .plans.query import Query
from .session import session
from .sources.files import Ingest
from .streaming import ingest as streams
from .vocab import Vocabulary


@dataclass(frozen=True)
class Config:
    """Where data lives; without a folder everything stays in the session."""

    data_dir: str | None = None
    lexicon: str | None = None
    root: str = "."
    recreate: bool = False
    buckets: int = 64

    @classmethod
    def from_env(cls) -> Config:
        e = os.environ
        return cls(e.get("RILL_DATA_DIR"), e.get("RILL_LEXICON"), e.get("RILL_ROOT", "."), e.get("RILL_RECREATE", "") == "1")


class Engine:
    def __init__(self, spark: SparkSession | None = None, config: Config | None = None, vocab: Vocabulary | None = None, lexicon: Lexicon | None = None):
        self.spark, self.config, self.vocab = spark or session(), config or Config(), vocab or Vocabulary()
        at = self.config.data_dir
        if at and self.config.recreate:
            shutil.rmtree(at, ignore_errors=True)
        self.store = TripleStore(self.spark, self.vocab, at and os.path.join(at, "triples"))
        self.series = SeriesStore(self.spark, at and os.path.join(at, "series"), self.config.buckets)
        self.ingest = Ingest(self.spark, self.series, self.config.root)
        self.sensors = Sensors(self.spark, self.series, self.store, self.sparql_query)
        self.lexicon = lexicon or (Lexicon.read(self.config.lexicon) if self.config.lexicon and os.path.exists(self.config.lexicon) else Lexicon())
        self.active: list = []

    def resolve(self, text: str, kind: str | None = None) -> str:
        return self.lexicon.resolve(text, kind)

    # graph

    def load_graph(self, path_or_text: str, format: str = "turtle", replace: bool = True, ingest: bool = False) -> dict[str, int]:
        out = self.store.load(path_or_text, format, replace)
        return out | {"ingest": self.ingest_references()} if ingest else out

    def ingest_references(self) -> dict[str, int]:
        out = self.ingest.run(self.store.main(), self.vocab)
        self.sensors.touched(self.series.streams)
        return out

    def ingest_status(self) -> dict[str, int]:
        return self.ingest.status()

    # queries

    def query(self) -> Query:
        return Query(self)

    def find_entity(self, _class: str | None = None, alias: str | None = None) -> Query:
        return self.query().find_entity(_class, alias)

    def find_all_data(self, **options) -> Query:
        return self.query().find_all_data(**options)

    def sparql_query(self, text: str, use_union: bool = False) -> DataFrame:
        return sparql.select(self.store.graph(use_union), text)

    def sparql_update(self, text: str) -> None:
        for kind, triples in sparql.update(text):
            (self.store.add if kind == "insert" else self.store.remove)(triples)

    def sql_query(self, text: str) -> DataFrame:
        """SQL over ``triples, timeseries, streams, soft_sensors, soft_sensor_runs``."""
        self.store.triples.createOrReplaceTempView("triples")
        self.series.frame().createOrReplaceTempView("timeseries")
        self.spark.createDataFrame([(h, u) for u, h in self.series.streams.items()], "handle string, uri string").createOrReplaceTempView("streams")
        self.sensors.catalog().createOrReplaceTempView("soft_sensors")
        self.sensors.runs().createOrReplaceTempView("soft_sensor_runs")
        return self.spark.sql(text)

    # series

    def timeseries(self, point: str, start=None, end=None, limit: int | None = None, order: str = "asc") -> DataFrame:
        if order not in ("asc", "desc"):
            raise ValueError("order is asc or desc")
        return self.series.scan(point, start, end, limit, order)

    def timeseries_batches(self, point: str, size: int = 50_000, **options):
        """Lists of at most ``size`` rows of a scan, one partition at a time on the driver."""
        rows = []
        for r in self.timeseries(point, **options).toLocalIterator():
            rows.append(r)
            if len(rows) == size:
                yield rows
                rows = []
        if rows:
            yield rows

    def insert(self, batch: dict[str, Iterable[tuple]]) -> int:
        """Upsert ``{point: [(time, value)]}``."""
        n = sum(self.series.upsert(p, list(rows)) for p, rows in batch.items())
        self.sensors.touched(batch)
        return n

    def timeseries_info(self, point: str) -> DataFrame:
        return info(self.series.frame(), point)

    def subscribe(self, messages: DataFrame, checkpoint: str, **options):
        """Feed a message stream into the series by the graph's stream references."""
        running = streams.start(messages, streams.specifications(self.store.main(), self.vocab), self.series, checkpoint, **options)
        self.active.append(running)
        return running

    def close(self) -> None:
        for q in self.active:
            q.processAllAvailable()
            q.stop()
        self.active = []
