"""The terms the engine itself gives a meaning to. All can be replaced for a graph that names them otherwise."""

from __future__ import annotations

from dataclasses import dataclass

RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
QUDT = "http://qudt.org/schema/qudt/"
UNIT = "http://qudt.org/vocab/unit/"
S223 = "http://data.ashrae.org/standard223#"


@dataclass(frozen=True)
class Vocabulary:
    base: str = "urn:rill#"
    points: str = "urn:rill/point/"
    type: str = RDF_TYPE
    has_medium: str = S223 + "hasMedium"
    of_substance: str = S223 + "ofSubstance"
    has_quantity_kind: str = QUDT + "hasQuantityKind"
    has_enumeration_kind: str = QUDT + "hasEnumerationKind"
    has_unit: str = QUDT + "hasUnit"
    imports: str = OWL + "imports"

    def term(self, name: str) -> str:
        return self.base + name

    @property
    def external_reference(self) -> str:
        return self.term("hasExternalReference")
