"""Derived series: registered functions over a graph of series, run in dependency order when their inputs changed."""

from __future__ import annotations

import hashlib
import importlib
import inspect
import json
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .series import SCHEMA, SeriesStore, local_name, moment, wide


@dataclass(frozen=True)
class Sensor:
    uri: str
    fn: Callable
    sources: tuple[str, ...]
    params: dict = field(default_factory=dict)
    module: str = ""
    schedule: str | None = None

    @property
    def version(self) -> str:
        try:
            code = inspect.getsource(self.fn)
        except (OSError, TypeError):
            code = repr(self.fn)
        told = json.dumps({"code": code, "sources": list(self.sources), "params": self.params}, sort_keys=True, default=str)
        return "sha1:" + hashlib.sha1(told.encode()).hexdigest()


@dataclass(frozen=True)
class Run:
    uri: str
    started: datetime
    duration_ms: float
    rows_out: int
    status: str
    message: str = ""


def ordered(sensors: Iterable[Sensor]) -> list[Sensor]:
    """Sources before what depends on them; ``RuntimeError`` on a cycle."""
    by_uri = {s.uri: s for s in sensors}
    waiting = {u: {x for x in s.sources if x in by_uri} for u, s in by_uri.items()}
    out = []
    while waiting:
        ready = sorted(u for u, w in waiting.items() if not w)
        if not ready:
            raise RuntimeError(f"the sensors depend on each other in a cycle: {sorted(waiting)}")
        for u in ready:
            del waiting[u]
            out.append(by_uri[u])
        for w in waiting.values():
            w.difference_update(ready)
    return out


def affected(dirty: set[str], sensors: Iterable[Sensor]) -> list[str]:
    """The dirty sensors and everything downstream of them, in running order."""
    found = set(dirty)
    out = []
    for s in ordered(sensors):
        if s.uri in found or found & set(s.sources):
            found.add(s.uri)
            out.append(s.uri)
    return out


def as_samples(spark: SparkSession, out) -> DataFrame:
    """What a sensor function returned as ``ts, value``: frames of either kind, tuples, dicts, or nothing."""
    if out is None:
        return spark.createDataFrame([], "ts timestamp, value string")
    if isinstance(out, pd.DataFrame):
        out = spark.createDataFrame(out)
    if isinstance(out, DataFrame):
        at = "time" if "time" in out.columns else "ts"
        value = "value" if "value" in out.columns else next(c for c in out.columns if c != at)
        return out.select(F.col(at).cast("timestamp").alias("ts"), F.col(f"`{value}`").cast("string").alias("value"))
    rows = [(r.get("ts", r.get("time")), r["value"]) if isinstance(r, dict) else tuple(r) for r in out]
    return spark.createDataFrame([(moment(t), None if v is None else str(v)) for t, v in rows], "ts timestamp, value string")


class Sensors:
    def __init__(self, spark: SparkSession, series: SeriesStore, store=None, select: Callable[[str], DataFrame] | None = None):
        self.spark, self.series, self.store, self.select = spark, series, store, select
        self.known: dict[str, Sensor] = {}
        self.ran: dict[str, tuple[str, datetime]] = {}
        self.changed: dict[str, datetime] = {}
        self.log: list[Run] = []

    def register(self, fn: Callable | str, ids: Iterable[str] = (), sparql: str | None = None, uri: str | None = None, params: dict | None = None, name: str | None = None, mode: str = "many-to-one", data_shape: str = "wide", schedule: str | None = None) -> list[Sensor] | None:
        """One sensor over all sources, or one for each (``one-to-one``). No sources: None."""
        if mode not in ("many-to-one", "one-to-one"):
            raise ValueError("mode is many-to-one or one-to-one")
        module = fn if isinstance(fn, str) else f"{fn.__module__}:{fn.__qualname__}"
        if isinstance(fn, str):
            where, _, what = fn.partition(":")
            fn = getattr(importlib.import_module(where), what)
        first = [r[0] for r in self.select(sparql).collect()] if sparql else []
        sources = list(dict.fromkeys([*first, *ids]))
        if not sources:
            return None
        params = {"data_shape": data_shape} | (params or {})
        slug = re.sub(r"[^a-z0-9]+", "-", (name or fn.__name__).lower()).strip("-")
        out = []
        for group in [tuple(sources)] if mode == "many-to-one" else [(s,) for s in sources]:
            own = uri if uri and mode == "many-to-one" else f"{uri or 'urn:rill/virtual/' + slug}_{hashlib.sha1(json.dumps([slug, *group]).encode()).hexdigest()[:8]}"
            sensor = Sensor(own, fn, group, params, module, schedule)
            self.known[own] = sensor
            self.series.ensure_handle(own)
            if self.store is not None:
                self.store.register_virtual_point(own, group)
                self.store.upsert_sensor(own, module, sensor.version, group)
            out.append(sensor)
        return out

    def remove(self, uri: str) -> None:
        """Forget a sensor with its samples, runs and handle."""
        self.known.pop(uri, None)
        self.ran.pop(uri, None)
        self.series.streams.pop(uri, None)
        self.series.delete(uri)
        self.log = [r for r in self.log if r.uri != uri]
        if self.store is not None:
            self.store.delete(uri)

    def keep_only(self, uris: Iterable[str]) -> list[str]:
        stale = sorted(set(self.known) - set(uris))
        for u in stale:
            self.remove(u)
        return stale

    def touched(self, sources: Iterable[str], at: datetime | None = None) -> None:
        """Note that series have new samples."""
        for s in sources:
            self.changed[s] = at or datetime.now(timezone.utc)

    def _input(self, s: Sensor) -> DataFrame:
        rows = self.series.frame().where(F.col("point_uri").isin(*s.sources))
        if s.params.get("data_shape") == "narrow":
            return rows.select(F.col("ts").alias("time"), "value", local_name(F.col("point_uri")).alias("id")).orderBy("time", "id")
        return wide(rows, list(s.sources))

    def _run(self, s: Sensor) -> Run:
        began, t = datetime.now(timezone.utc), time.time()
        try:
            out = as_samples(self.spark, s.fn(self._input(s), s.params)).where("ts is not null").cache()
            n, last = out.agg(F.count("*"), F.max("ts")).first()
            if n:  # published only once it is there as a whole
                self.series.merge(out.withColumn("point_uri", F.lit(s.uri)))
                self.changed[s.uri] = datetime.now(timezone.utc)
                if self.store is not None:
                    self.store.record_last_reported(s.uri, last)
            out.unpersist()
            self.ran[s.uri] = (s.version, began)
            if self.store is not None:
                self.store.set_last_run(s.uri, began)
            run = Run(s.uri, began, (time.time() - t) * 1000, n, "ok")
        except Exception as e:
            run = Run(s.uri, began, (time.time() - t) * 1000, 0, "error", str(e))
        self.log.append(run)
        return run

    def run(self, uris: Iterable[str] | None = None) -> list[Run]:
        chosen = set(self.known if uris is None else uris)
        return [self._run(s) for s in ordered(self.known.values()) if s.uri in chosen]

    def dirty(self, updated: Iterable[str] = ()) -> set[str]:
        updated = set(updated)
        out = set()
        for s in self.known.values():
            version, at = self.ran.get(s.uri, (None, None))
            if version != s.version or updated & set(s.sources) or any(self.changed[x] > at for x in s.sources if x in self.changed):
                out.add(s.uri)
        return out

    def run_scheduled(self, updated: Iterable[str] = ()) -> list[Run]:
        return [self._run(self.known[u]) for u in affected(self.dirty(updated), self.known.values())]

    def runs(self) -> DataFrame:
        return self.spark.createDataFrame([(r.uri, r.started, r.duration_ms, r.rows_out, r.status, r.message) for r in self.log], "uri string, started timestamp, duration_ms double, rows_out long, status string, message string")

    def catalog(self) -> DataFrame:
        return self.spark.createDataFrame([(s.uri, s.module, list(s.sources), json.dumps(s.params, default=str), s.schedule) for s in self.known.values()], "uri string, module_path string, sources array<string>, params string, schedule string")


__all__ = ["SCHEMA", "Run", "Sensor", "Sensors", "affected", "as_samples", "ordered"]
