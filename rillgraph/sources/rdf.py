"""RDF text: readers for Turtle, N-Triples, RDF/XML and TriX, a distributed N-Triples scan, and writers.

Documents are parsed on the driver, as one document is one unit; large N-Triples files go through ``scan_ntriples``,
which splits them by line like any text source.
"""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocab import RDF_TYPE, XSD

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("g", "s", "p", "o", "o_kind", "o_datatype", "o_lang")])
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


class Term(NamedTuple):
    value: str
    kind: str = "iri"  # iri, lit or bnode
    datatype: str | None = None
    lang: str | None = None


Triple = tuple[str, str, Term]

_TOKEN = re.compile(
    r"""(?P<ws>[\s]+|\#[^\n]*)
      |(?P<iri><[^<>"{}|^`\\\s]*>)
      |(?P<long>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3})
      |(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
      |(?P<dt>\^\^)
      |(?P<num>[+-]?(?:\d+\.\d+(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|\d+[eE][+-]?\d+|\d+))
      |(?P<bnode>_:[\w.-]*\w)
      |(?P<name>(?:[\w](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:%.-]|\\.)*(?:[\w:%-]|\\.))?)?)
      |(?P<word>[A-Za-z]+)
      |(?P<punct>[.;,\[\]()])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _PLAIN.get(m[3], m[3]), text)


def resolved(base: str, ref: str) -> str:
    """An IRI reference against a base, by RFC 3986, section 5.2."""
    parts = re.compile(r"^(?:([A-Za-z][\w+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", re.S)
    scheme, host, path, query, fragment = parts.match(ref).groups()
    if scheme is None:
        scheme, base_host, base_path, base_query, _ = parts.match(base).groups()
        if host is None:
            host = base_host
            if path == "":
                path, query = base_path, base_query if query is None else query
            elif not path.startswith("/"):
                path = ("/" if base_host is not None and not base_path else base_path.rpartition("/")[0] + ("/" if "/" in base_path else "")) + path
    out: list[str] = []
    steps = path.split("/")
    for i, step in enumerate(steps):
        if step == "..":
            if len(out) > 1 or out and out[0]:
                out.pop()
        elif step != ".":
            out.append(step)
        if step in (".", "..") and i == len(steps) - 1:
            out.append("")
    path = "/".join(out)
    return "".join([f"{scheme}:" if scheme else "", f"//{host}" if host is not None else "", path, f"?{query}" if query is not None else "", f"#{fragment}" if fragment is not None else ""])


class _Turtle:
    """Recursive descent over the token list."""

    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not Turtle at {text[at : at + 40]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.base, self.blank = 0, {}, "", 0
        self.own = "b"  # what generated labels begin with, and no written one does
        while f"_:{self.own}" in text:
            self.own += "b"
        self.out: list[Triple] = []

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, what: str | None = None) -> tuple[str, str]:
        kind, text = self.peek()
        if what is not None and text != what:
            raise ValueError(f"expected {what!r}, found {text!r}")
        self.at += 1
        return kind, text

    def parse(self) -> list[Triple]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if text.lower() in ("@prefix", "prefix") and kind in ("lang", "word"):
                self.take()
                name = self.take()[1].removesuffix(":")
                self.prefixes[name] = self.iri(self.take()[1])
                self.close(text)
            elif text.lower() in ("@base", "base") and kind in ("lang", "word"):
                self.take()
                self.base = self.iri(self.take()[1])
                self.close(text)
            else:
                boxed = text == "["
                subject = self.term()
                if not (boxed and self.peek()[1] == "."):
                    self.properties(subject.value)
                self.take(".")
        return self.out

    def close(self, directive: str) -> None:
        if directive.startswith("@"):
            self.take(".")

    def iri(self, text: str) -> str:
        value = _unescaped(text[1:-1])
        return resolved(self.base, value) if self.base else value

    def fresh(self) -> Term:
        self.blank += 1
        return Term(f"_:{self.own}{self.blank}", "bnode")

    def properties(self, subject: str) -> None:
        while self.peek()[1] not in (".", "]", ""):
            verb = self.term().value if self.peek() != ("word", "a") else (self.take(), RDF_TYPE)[1]
            while True:
                self.out.append((subject, verb, self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()

    def term(self) -> Term:
        kind, text = self.take()
        if kind == "iri":
            return Term(self.iri(text))
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return Term(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "bnode":
            return Term(text, "bnode")
        if kind in ("str", "long"):
            value = _unescaped(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "dt":
                self.take()
                return Term(value, "lit", self.term().value)
            if self.peek()[0] == "lang":
                return Term(value, "lit", RDF + "langString", self.take()[1][1:].lower())
            return Term(value, "lit", XSD + "string")
        if kind == "num":
            return Term(text, "lit", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "word" and text in ("true", "false"):
            return Term(text, "lit", XSD + "boolean")
        if text == "[":
            node = self.fresh()
            self.properties(node.value)
            self.take("]")
            return node
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            head = Term(RDF + "nil")
            for item in reversed(items):
                cell = self.fresh()
                self.out += [(cell.value, RDF + "first", item), (cell.value, RDF + "rest", head)]
                head = cell
            return head
        raise ValueError(f"unexpected {text!r}")


def _rdf_xml(text: str) -> list[Triple]:
    out: list[Triple] = []
    count = 0
    name = lambda tag: tag[1:].replace("}", "", 1) if tag[0] == "{" else tag

    def node(e: ET.Element) -> Term:
        nonlocal count
        if (about := e.get(f"{{{RDF}}}about")) is not None:
            subject = Term(about)
        elif (own := e.get(f"{{{RDF}}}nodeID")) is not None:
            subject = Term(f"_:{own}", "bnode")
        else:
            count += 1
            subject = Term(f"_:x{count}", "bnode")
        if name(e.tag) != RDF + "Description":
            out.append((subject.value, RDF_TYPE, Term(name(e.tag))))
        for key, value in e.attrib.items():
            if not key.startswith(f"{{{RDF}}}") and not key.startswith("{http://www.w3.org/XML"):
                out.append((subject.value, name(key), Term(value, "lit", XSD + "string")))
        for p in e:
            if (to := p.get(f"{{{RDF}}}resource")) is not None:
                value = Term(to)
            elif (to := p.get(f"{{{RDF}}}nodeID")) is not None:
                value = Term(f"_:{to}", "bnode")
            elif len(p):
                value = node(p[0])
            else:
                lang = p.get("{http://www.w3.org/XML/1998/namespace}lang")
                value = Term(p.text or "", "lit", p.get(f"{{{RDF}}}datatype") or (RDF + "langString" if lang else XSD + "string"), lang and lang.lower())
            out.append((subject.value, name(p.tag), value))
        return subject

    root = ET.fromstring(text)
    for e in root if name(root.tag) == RDF + "RDF" else [root]:
        node(e)
    return out


def _trix(text: str) -> list[Triple]:
    def term(e: ET.Element) -> Term:
        kind, value = e.tag.rpartition("}")[2], e.text or ""
        if kind == "uri":
            return Term(value.strip())
        if kind == "id":
            return Term(f"_:{value.strip()}", "bnode")
        lang = e.get("{http://www.w3.org/XML/1998/namespace}lang")
        return Term(value, "lit", e.get("datatype") or (RDF + "langString" if lang else XSD + "string"), lang and lang.lower())

    out = []
    for e in ET.fromstring(text).iter():
        if e.tag.rpartition("}")[2] == "triple":
            s, p, o = (term(x) for x in e)
            out.append((s.value, p.value, o))
    return out


#: Of N3, the part that is Turtle can be read; formulas and rules raise ``ValueError``.
_READERS = {"turtle": lambda t: _Turtle(t).parse(), "ttl": lambda t: _Turtle(t).parse(), "n3": lambda t: _Turtle(t).parse(), "nt": lambda t: _Turtle(t).parse(), "xml": _rdf_xml, "trix": _trix}


def parse(text: str, format: str = "turtle", scoped: bool = False) -> list[Triple]:
    """The triples of a document. ``scoped`` gives its blank nodes labels that those of other documents don't have."""
    if format not in _READERS:
        raise ValueError(f"unknown format {format!r}; known: {sorted(_READERS)}")
    found = _READERS[format](text)
    if not scoped:
        return found
    scope = hashlib.sha1(text.encode()).hexdigest()[:10]
    own = lambda x: f"_:{scope}-{x[2:]}" if x.startswith("_:") else x
    return [(own(s), p, o._replace(value=own(o.value)) if o.kind == "bnode" else o) for s, p, o in found]


def to_frame(spark: SparkSession, triples: Iterable[Triple], graph: str = "main") -> DataFrame:
    rows = [(graph, s, p, o.value, o.kind, o.datatype, o.lang) for s, p, o in triples]
    return spark.createDataFrame(rows, SCHEMA).distinct()


def scan_ntriples(spark: SparkSession, path: str, graph: str = "main") -> DataFrame:
    """Triples of N-Triples files, split by line over the cluster. Lines that aren't triples are left out."""
    line = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(?:<([^>]*)>|(_:\S+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(?:#.*)?$'
    part = lambda k: F.regexp_extract("value", line, k)
    some = lambda k: F.nullif(part(k), F.lit(""))
    plain = F.replace(F.replace(F.replace(part(5), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\\\"), F.lit("\\"))
    kind = F.when(part(3) != "", "iri").when(part(4) != "", "bnode").otherwise("lit")
    lang = F.lower(some(7))
    return (
        spark.read.text(path)
        .where(F.col("value").rlike(line))
        .select(
            F.lit(graph).alias("g"), F.regexp_replace(part(1), "^<|>$", "").alias("s"), part(2).alias("p"),
            F.when(kind == "iri", part(3)).when(kind == "bnode", part(4)).otherwise(plain).alias("o"), kind.alias("o_kind"),
            F.when(kind == "lit", F.coalesce(some(6), F.when(lang.isNotNull(), RDF + "langString").otherwise(XSD + "string"))).alias("o_datatype"), F.when(kind == "lit", lang).alias("o_lang"),
        )
    )


def ntriples(df: DataFrame) -> DataFrame:
    """One N-Triples line for each triple, in column ``value``."""
    ref = lambda c: F.when(F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    safe = F.replace(F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_datatype").isNotNull() & (F.col("o_datatype") != XSD + "string"), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), safe, F.lit('"'), tail)).otherwise(ref("o"))
    return df.select(F.concat_ws(" ", ref("s"), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value"))
