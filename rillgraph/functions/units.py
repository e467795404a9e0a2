"""Units: definitions from triples, resolution of names and symbols, inference of ratios, exact conversion."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..vocab import QUDT, RDFS, UNIT

#: Everyday names and the units they mean.
ALIASES = {"meter": "M", "metre": "M", "second": "SEC", "minute": "MIN", "hour": "HR", "liter": "L", "litre": "L", "celsius": "DEG_C", "fahrenheit": "DEG_F", "kelvin": "K", "gallon": "GAL_US", "gpm": "GAL_US-PER-MIN", "psi": "LB_F-PER-IN2", "percent": "PERCENT", "gal": "GAL_US", "gallon_us": "GAL_US", "km": "KiloM", "kilometer": "KiloM", "kilometre": "KiloM", "degf": "DEG_F", "degc": "DEG_C"}
#: SI factors of the US gallon and of US gallons a minute.
OVERRIDES = {"GAL_US": "0.003785411784", "GAL_US-PER-MIN": "0.0000630901964"}
_LABELS = (RDFS + "label", "http://www.w3.org/2004/02/skos/core#prefLabel", QUDT + "symbol", QUDT + "ucumCode", QUDT + "uneceCommonCode")


@dataclass(frozen=True)
class Unit:
    uri: str
    quantity_kind: str | None = None
    multiplier: Decimal = Decimal(1)
    offset: Decimal = Decimal(0)
    names: tuple[str, ...] = ()

    @property
    def id(self) -> str:
        return self.uri.rpartition("/")[2]


def definitions(triples: DataFrame) -> DataFrame:
    """``uri, quantity_kind, multiplier, offset, names`` of every unit described in a graph."""
    value = lambda p: F.when(F.col("p") == p, F.col("o"))
    kind = value(QUDT + "hasQuantityKind")
    return (
        triples.where(F.col("p").isin(QUDT + "conversionMultiplier", QUDT + "conversionOffset", QUDT + "hasQuantityKind", *_LABELS))
        .groupBy(F.col("s").alias("uri"))
        .agg(F.coalesce(F.min(F.when(kind.endswith("/Length"), kind)), F.min(kind)).alias("quantity_kind"), F.coalesce(F.min(value(QUDT + "conversionMultiplier")), F.lit("1")).alias("multiplier"), F.coalesce(F.min(value(QUDT + "conversionOffset")), F.lit("0")).alias("offset"), F.array_sort(F.collect_set(F.when(F.col("p").isin(*_LABELS), F.col("o")))).alias("names"))
    )


class Units:
    """A table of units on the driver; vocabularies have a few thousand."""

    def __init__(self, units: Iterable[Unit]):
        self.units = {}
        for u in units:
            fixed = OVERRIDES.get(u.id)
            self.units[u.uri] = Unit(u.uri, u.quantity_kind, Decimal(fixed), u.offset, u.names) if fixed else u
        self.by_id = {u.id: u for u in self.units.values()}
        for u in list(self.units.values()):  # a ratio's factor follows from its parts where both are known
            a, per, b = u.id.partition("-PER-")
            if per and u.id not in OVERRIDES and a in self.by_id and b in self.by_id:
                self._put(Unit(u.uri, u.quantity_kind, self.by_id[a].multiplier / self.by_id[b].multiplier, Decimal(0), u.names))

    def _put(self, unit: Unit) -> None:
        self.units[unit.uri] = self.by_id[unit.id] = unit

    @classmethod
    def of(cls, triples: DataFrame) -> Units:
        return cls(Unit(r.uri, r.quantity_kind, Decimal(r.multiplier), Decimal(r.offset), tuple(r.names)) for r in definitions(triples).collect())

    def resolve(self, text: str) -> Unit:
        """URI, identifier, upper case, underscores, alias, exact name, name without case; else ``ValueError``."""
        if text in self.units:
            return self.units[text]
        for form in (text, text.upper(), re.sub(r"[\s-]+", "_", text).upper(), ALIASES.get(text.lower(), "")):
            if form in self.by_id:
                return self.by_id[form]
        for same in (lambda n: n == text, lambda n: n.casefold() == text.casefold()):
            for u in self.units.values():
                if any(same(n) for n in u.names):
                    return u
        raise ValueError(f"unknown unit {text!r}")

    def infer(self, text: str) -> Unit:
        """As ``resolve``, and ratios such as ``gallon per minute`` or ``m/s``, then label parts."""
        text = text.strip().strip("<>")
        for form in dict.fromkeys((text, text.rpartition("#")[2], text.rpartition("/")[2] if "://" in text else text)):
            try:
                return self.resolve(form)
            except ValueError:
                pass
        for split in (" per ", "-PER-", "/"):
            if split.lower() in text.lower() and "://" not in text:
                a, b = re.split(re.escape(split), text, maxsplit=1, flags=re.I)
                top, bottom = self.infer(a), self.infer(b)
                known = self.by_id.get(f"{top.id}-PER-{bottom.id}")
                if known:
                    return known
                if top.offset or bottom.offset:
                    raise ValueError("a ratio of units with offsets has no factor")
                return Unit(f"{UNIT}{top.id}-PER-{bottom.id}", None, top.multiplier / bottom.multiplier)
        for u in self.units.values():
            if any(text.casefold() in n.casefold() for n in u.names):
                return u
        raise ValueError(f"unknown unit {text!r}")

    def convert(self, x, source: str, target: str) -> float:
        a, b = self.infer(source), self.infer(target)
        if a.quantity_kind and b.quantity_kind and a.quantity_kind != b.quantity_kind:
            raise ValueError(f"{a.id} and {b.id} measure different quantities")
        with localcontext() as c:
            c.prec = 28
            return float((Decimal(str(x)) + a.offset) * a.multiplier / b.multiplier - b.offset)

    def converted(self, value: Column, source: str, target: str) -> Column:
        """The conversion as a double expression, for whole columns."""
        a, b = self.infer(source), self.infer(target)
        if a.quantity_kind and b.quantity_kind and a.quantity_kind != b.quantity_kind:
            raise ValueError(f"{a.id} and {b.id} measure different quantities")
        return (value + float(a.offset)) * float(a.multiplier) / float(b.multiplier) - float(b.offset)
