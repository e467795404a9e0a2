"""A small plant: ten machines of classes A-E in rotation, links x, y, z and w with cycles, ten points with references."""

from rillgraph.vocab import Vocabulary

V = Vocabulary()
NS = V.base
EX = "urn:ex/"
LINKS = [(1, "x", 2), (2, "z", 1), (1, "x", 6), (2, "y", 3), (3, "w", 8), (6, "z", 3), (6, "x", 11), (11, "y", 13), (7, "w", 1), (4, "z", 3), (4, "w", 8), (5, "x", 6), (8, "y", 5), (13, "x", 10), (3, "x", 3)]
OWNS = {1: [9], 2: [1, 2], 3: [3], 5: [4], 7: [5, 6], 9: [4], 10: [8], 6: [7, 10]}


def cls(i: int) -> str:
    return {11: "A", 12: "C", 13: "A"}.get(i) or "ABCDE"[(i - 1) % 5]


def turtle(files: bool = True) -> str:
    out = [f"@prefix r: <{NS}> .", f"@prefix ex: <{EX}> .", "@prefix qudt: <http://qudt.org/schema/qudt/> .", "@prefix s: <http://data.ashrae.org/standard223#> ."]
    for i in range(1, 14):
        out.append(f"ex:eq_{i} a r:{cls(i)} .")
    out += [f"ex:eq_{a} r:{p} ex:eq_{b} ." for a, p, b in LINKS]
    out += [f"ex:eq_{e} r:hasProperty ex:point_{p} ." for e, ps in OWNS.items() for p in ps]
    for i in range(1, 11):
        kind = f"qudt:hasQuantityKind r:QK{i % 3}" if i < 9 else f"qudt:hasEnumerationKind r:EK{i % 2}"
        out.append(f"ex:point_{i} a r:Observable ; s:hasMedium r:Medium{i % 4} ; s:ofSubstance r:Substance{i % 3} ; qudt:hasUnit r:Unit{i % 3} ; {kind} ; r:hasExternalReference ex:ref_{i} .")
        if files:
            out.append(f'ex:ref_{i} a r:CSVReference ; r:DataSource "LAB" ; r:hasFilePath "data.csv" ; r:hasTimeColumn 0 ; r:hasValueColumn {i} .')
    return "\n".join(out)
