"""A SPARQL SELECT front-end: text to DataFrame plans, and INSERT DATA / DELETE DATA.

Supported: basic patterns with ``;`` and ``,``, paths (``/ | ^ ? + *``), OPTIONAL,
UNION, MINUS, FILTER (comparisons, IN, logic, arithmetic, bound, regex, str functions, EXISTS), BIND, VALUES,
sub-SELECT, DISTINCT, GROUP BY, HAVING, aggregates, ORDER BY, LIMIT, OFFSET. Anything else raises ``ValueError``.
A variable is two columns while planning, its text and its kind (kind, datatype, language), so terms join as terms.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.hops import closure
from ..sources.rdf import Term, Triple, _Turtle, parse
from ..vocab import RDF_TYPE, XSD

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z-]+)
      |(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+)|(?P<name>(?:[A-Za-z][\w-]*)?:(?:[\w-]|\.(?=[\w-]))*)|(?P<bnode>_:\w+)|(?P<word>[A-Za-z_][\w-]*)
      |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!*/|^?+\-\[\]])""",
    re.X,
)
_AGG = {"COUNT", "SUM", "MIN", "MAX", "AVG", "SAMPLE", "GROUP_CONCAT"}


def kind_of(v: str) -> str:
    return f"{v}#k"


def _term_kind(t: Term) -> str:
    return "\x1f".join([t.kind, t.datatype or "", t.lang or ""])


class _Parser:
    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"not SPARQL at {text[at : at + 30]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at, self.prefixes, self.blank = 0, {}, 0

    def peek(self, k: int = 0) -> str:
        return self.tokens[self.at + k][1] if self.at + k < len(self.tokens) else ""

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else "end"

    def take(self, what: str | None = None) -> str:
        text = self.peek()
        if not text or what is not None and text.upper() != what.upper():
            raise ValueError(f"expected {what or 'more'}, found {text or 'the end'}")
        self.at += 1
        return text

    def has(self, *words: str) -> bool:
        if all(self.peek(i).upper() == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def prologue(self) -> None:
        while self.peek().upper() == "PREFIX":
            self.take()
            name = self.take()[:-1]
            self.prefixes[name] = self.take()[1:-1]

    def term(self) -> str | Term:
        """A variable's name, or a term."""
        kind, text = self.kind(), self.take()
        if kind == "var":
            return text[1:]
        if kind == "bnode":
            return "__" + text[2:]
        if kind == "iri":
            return Term(text[1:-1])
        if kind == "name":
            p, _, local = text.partition(":")
            if p not in self.prefixes:
                raise ValueError(f"unknown prefix {p!r}")
            return Term(self.prefixes[p] + local)
        if kind == "num":
            return Term(text, "lit", XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if text in ("true", "false"):
            return Term(text, "lit", XSD + "boolean")
        if text == "a":
            return Term(RDF_TYPE)
        if kind == "str":
            return _Turtle(text + (self.take() if self.kind() == "lang" else f"^^<{self._datatype()}>" if self.has("^^") else "")).term()
        raise ValueError(f"unexpected {text!r}")

    def _datatype(self) -> str:
        return self.term().value

    # paths

    def path(self):
        out = self.sequence()
        while self.has("|"):
            out = ("or", out, self.sequence())
        return out

    def sequence(self):
        out = self.step()
        while self.has("/"):
            out = ("then", out, self.step())
        return out

    def step(self):
        if self.has("^"):
            return ("back", self.step())
        if self.has("("):
            out = self.path()
            self.take(")")
        else:
            out = self.term()
        while self.peek() in ("?", "*", "+"):
            out = ("many", out, self.take())
        return out

    # groups

    def group(self) -> list:
        self.take("{")
        out: list = []
        if self.peek().upper() == "SELECT":
            out.append(("sub", self.select()))
            self.take("}")
            return out
        while not self.has("}"):
            if self.has("OPTIONAL"):
                out.append(("optional", self.group()))
            elif self.has("MINUS"):
                out.append(("minus", self.group()))
            elif self.has("FILTER"):
                out.append(("filter", self.constraint()))
            elif self.has("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                out.append(("bind", self.term(), e))
                self.take(")")
            elif self.has("VALUES"):
                out.append(self.values())
            elif self.peek() == "{":
                ways = [self.group()]
                while self.has("UNION"):
                    ways.append(self.group())
                out.append(("union", ways))
            elif self.peek().upper() in ("GRAPH", "SERVICE"):
                raise ValueError(f"{self.peek().upper()} isn't supported")
            else:
                s = self.term()
                while True:
                    p = self.path()
                    out.append(("triple", s, p, self.term()))
                    while self.has(","):
                        out.append(("triple", s, p, self.term()))
                    while self.has(";"):
                        pass
                    if self.peek() in (".", "}", "{") or self.peek().upper() in ("OPTIONAL", "FILTER", "MINUS", "BIND", "VALUES"):
                        break
            self.has(".")
        return out

    def values(self):
        names = [self.term()] if self.kind() == "var" else None
        if names is None:
            self.take("(")
            names = []
            while not self.has(")"):
                names.append(self.term())
        many = self.peek(1) == "("
        self.take("{")
        rows = []
        while not self.has("}"):
            if many:
                self.take("(")
            rows.append([None if self.has("UNDEF") else self.term() for _ in names])
            if many:
                self.take(")")
        return ("values", names, rows)

    # expressions

    def constraint(self):
        if self.has("NOT", "EXISTS"):
            return ("exists", False, self.group())
        if self.has("EXISTS"):
            return ("exists", True, self.group())
        if self.peek() == "(":
            self.take()
            out = self.expression()
            self.take(")")
            return out
        return self.primary()

    def expression(self):
        out = self.conjunction()
        while self.has("||"):
            out = ("||", out, self.conjunction())
        return out

    def conjunction(self):
        out = self.relation()
        while self.has("&&"):
            out = ("&&", out, self.relation())
        return out

    def relation(self):
        out = self.sum()
        negated = self.peek().upper() == "NOT" and self.peek(1).upper() == "IN"
        if negated:
            self.take()
        if self.has("IN"):
            self.take("(")
            items = [self.expression()]
            while self.has(","):
                items.append(self.expression())
            self.take(")")
            return ("!", ("in", out, items)) if negated else ("in", out, items)
        if self.peek() in ("=", "!=", "<", ">", "<=", ">="):
            return (self.take(), out, self.sum())
        return out

    def sum(self):
        out = self.product()
        while self.peek() in ("+", "-"):
            out = (self.take(), out, self.product())
        return out

    def product(self):
        out = self.primary()
        while self.peek() in ("*", "/"):
            out = (self.take(), out, self.primary())
        return out

    def primary(self):
        if self.has("!"):
            return ("!", self.primary())
        if self.has("-"):
            return ("-", Term("0", "lit", XSD + "integer"), self.primary())
        if self.has("("):
            out = self.expression()
            self.take(")")
            return out
        if self.peek().upper() in ("EXISTS", "NOT"):
            return self.constraint()
        if self.kind() == "word" and self.peek(1) == "(":
            name = self.take().upper()
            self.take("(")
            distinct, args, separator = self.has("DISTINCT"), [], " "
            if self.has("*"):
                args.append("*")
            while not self.has(")"):
                if self.has(";"):
                    self.take("SEPARATOR")
                    self.take("=")
                    separator = self.term().value
                    continue
                args.append(self.expression())
                self.has(",")
            return ("call", name, args, distinct, separator)
        t = self.term()
        return ("var", t) if isinstance(t, str) else t

    # queries

    def select(self) -> dict:
        self.take("SELECT")
        q: dict = {"distinct": self.has("DISTINCT") or self.has("REDUCED"), "items": [], "group": None, "having": [], "order": [], "limit": None, "offset": None}
        while self.peek().upper() != "WHERE" and self.peek() != "{":
            if self.has("*"):
                q["items"] = None
            elif self.has("("):
                e = self.expression()
                self.take("AS")
                q["items"].append((self.term(), e))
                self.take(")")
            else:
                v = self.term()
                q["items"].append((v, ("var", v)))
        self.has("WHERE")
        q["where"] = self.group()
        while True:
            if self.has("GROUP", "BY"):
                q["group"] = []
                while self.kind() == "var":
                    q["group"].append(self.term())
            elif self.has("HAVING"):
                q["having"].append(self.constraint())
            elif self.has("ORDER", "BY"):
                while self.kind() == "var" or self.peek().upper() in ("ASC", "DESC") or self.peek() == "(":
                    down = self.has("DESC")
                    self.has("ASC")
                    q["order"].append((self.primary(), down))
            elif self.has("LIMIT"):
                q["limit"] = int(self.take())
            elif self.has("OFFSET"):
                q["offset"] = int(self.take())
            else:
                return q


class _Planner:
    def __init__(self, triples: DataFrame):
        self.t = triples.select("s", "p", "o", F.concat_ws("\x1f", "o_kind", F.coalesce("o_datatype", F.lit("")), F.coalesce("o_lang", F.lit(""))).alias("ok"))
        self.spark = triples.sparkSession

    def names(self, df: DataFrame) -> list[str]:
        return [c for c in df.columns if "#k" not in c]

    def edges(self, path, start: Term | None = None) -> DataFrame:
        """Distinct ``a, ak, b, bk`` pairs of a path; repeated steps begin at ``start`` if it is known."""
        iri = F.when(F.col("s").startswith("_:"), F.lit("bnode\x1f\x1f")).otherwise(F.lit("iri\x1f\x1f"))
        if isinstance(path, Term):
            return self.t.where(F.col("p") == path.value).select(F.col("s").alias("a"), iri.alias("ak"), F.col("o").alias("b"), F.col("ok").alias("bk")).distinct()
        if isinstance(path, str):
            raise ValueError("a variable can't be part of a path")
        op = path[0]
        if op == "back":
            return self.edges(path[1]).select(F.col("b").alias("a"), F.col("bk").alias("ak"), F.col("a").alias("b"), F.col("ak").alias("bk"))
        if op == "or":
            return self.edges(path[1]).unionByName(self.edges(path[2])).distinct()
        if op == "then":
            return self.joined(self.edges(path[1]), self.edges(path[2]))
        one = self.edges(path[1])
        zero = self.t.select(F.col("s").alias("a"), iri.alias("ak")).unionByName(self.t.select(F.col("o").alias("a"), F.col("ok").alias("ak"))).distinct().select("a", "ak", F.col("a").alias("b"), F.col("ak").alias("bk"))
        if path[2] == "?":
            return zero.unionByName(one).distinct()
        end = lambda x: F.struct(F.col(x).alias("v"), F.col(f"{x}k").alias("k"))
        first = None if start is None else self.spark.createDataFrame([((start.value, _term_kind(start)),)], "src struct<v:string, k:string>")
        found = closure(one.select(end("a").alias("src"), end("b").alias("dst")), first).select(F.col("src.v").alias("a"), F.col("src.k").alias("ak"), F.col("dst.v").alias("b"), F.col("dst.k").alias("bk"))
        return found if path[2] == "+" else zero.unionByName(found).distinct()

    @staticmethod
    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        return x.join(y.toDF("b", "bk", "c", "ck"), ["b", "bk"]).select("a", "ak", F.col("c").alias("b"), F.col("ck").alias("bk")).distinct()

    def triple(self, s, p, o) -> DataFrame:
        iri = F.when(F.col("s").startswith("_:"), F.lit("bnode\x1f\x1f")).otherwise(F.lit("iri\x1f\x1f"))
        base = self.t.select(F.col("s").alias("a"), iri.alias("ak"), F.col("p").alias("q"), F.col("o").alias("b"), F.col("ok").alias("bk")) if isinstance(p, str) else self.edges(p, s if isinstance(s, Term) else None)
        cols: dict[str, tuple[Column, Column]] = {}
        for end, col, kind in ((s, "a", "ak"), (o, "b", "bk")) + (((p, "q", None),) if isinstance(p, str) else ()):
            k = F.lit("iri\x1f\x1f") if kind is None else F.col(kind)
            if isinstance(end, Term):
                base = base.where((F.col(col) == end.value) & (k == _term_kind(end)))
            elif end in cols:
                base = base.where((F.col(col) == cols[end][0]) & (k == cols[end][1]))
            else:
                cols[end] = (F.col(col), k)
        flat = [x for v, (c, k) in cols.items() for x in (c.alias(v), k.alias(kind_of(v)))]
        return base.select(*(flat or [F.lit(1).alias("__one"), F.lit("").alias("__one#k")])).distinct()

    @staticmethod
    def loose(df: DataFrame) -> set[str]:
        """Variables that some solution may leave unbound."""
        return getattr(df, "_loose", set())

    def marked(self, df: DataFrame, loose: set[str]) -> DataFrame:
        df._loose = {v for v in loose if v in df.columns}
        return df

    def join(self, x: DataFrame | None, y: DataFrame, how: str = "inner", checks: list = ()) -> DataFrame:
        """Compatible solutions: equal where both bind a variable. ``checks`` are conditions of a left join, over both sides."""
        if x is None:
            return y
        y = self.marked(y.drop("__one", "__one#k"), self.loose(y)) if "__one" in x.columns and "__one" in y.columns else y
        shared = [v for v in self.names(x) if v in y.columns]
        loose = (self.loose(x) | self.loose(y)) & set(shared)
        semi = how in ("left_semi", "left_anti")
        after = set() if semi else (self.loose(x) & self.loose(y)) | ((self.loose(x) | self.loose(y)) - set(shared))
        if how == "left":
            after |= self.loose(x) | (set(self.names(y)) - set(shared))
        if not loose and not checks:
            keys = [c for v in shared for c in (v, kind_of(v))]
            if not keys:
                return self.marked(x.crossJoin(y) if how == "inner" else x.join(y, F.lit(True), how), after if not semi else self.loose(x))
            return self.marked(x.join(y, keys, how), after if not semi else self.loose(x))
        other = y.withColumnsRenamed({c: f"__y_{c}" for v in shared for c in (v, kind_of(v))})
        col = lambda c: F.col(f"`{c}`")
        on, both_bound = F.lit(True), F.lit(False)
        for v in shared:
            same = (col(v) == col(f"__y_{v}")) & (col(kind_of(v)) == col(f"__y_{kind_of(v)}"))
            on = on & ((same | col(v).isNull() | col(f"__y_{v}").isNull()) if v in loose else same)
            both_bound = both_bound | (col(v).isNotNull() & col(f"__y_{v}").isNotNull())
        if how == "left_anti":  # MINUS takes away only what shares a bound variable
            on = on & both_bound
        names = x.limit(0).join(y.limit(0).drop(*[c for v in shared for c in (v, kind_of(v))]), F.lit(True)) if checks else None
        for c in checks:
            on = on & self.truth(c, names)
        out = x.join(other, on, how)
        if semi:
            return self.marked(out, self.loose(x))
        for v in shared:
            bound = col(v).isNotNull()
            out = out.withColumns({kind_of(v): F.when(bound, col(kind_of(v))).otherwise(col(f"__y_{kind_of(v)}")), v: F.coalesce(col(v), col(f"__y_{v}"))})
        return self.marked(out.drop(*[f"__y_{c}" for v in shared for c in (v, kind_of(v))]), after)

    def group(self, parts: list) -> DataFrame:
        out: DataFrame | None = None
        filters = [p[1] for p in parts if p[0] == "filter"]
        # connected triples first, so that a product is only planned where the pattern has one
        triples = [p for p in parts if p[0] == "triple"]
        seen: set[str] = set()
        while triples:
            k = next((i for i, t in enumerate(triples) if seen & {x for x in t[1:] if isinstance(x, str)}), 0)
            t = triples.pop(k)
            out = self.join(out, self.triple(*t[1:]))
            seen |= {x for x in t[1:] if isinstance(x, str)}
        for p in parts:
            if p[0] == "values":
                rows = [[x for t in row for x in ((None, None) if t is None else (t.value, _term_kind(t)))] for row in p[2]]
                schema = ", ".join(f"`{v}` string, `{kind_of(v)}` string" for v in p[1])
                unset = {v for i, v in enumerate(p[1]) if any(row[i] is None for row in p[2])}
                out = self.join(out, self.marked(self.spark.createDataFrame(rows, schema), unset))
            elif p[0] == "union":
                ways = [self.group(w) for w in p[1]]
                every = [set(self.names(w)) for w in ways]
                unset = set().union(*every) - set.intersection(*every) | set().union(*(self.loose(w) for w in ways))
                out = self.join(out, self.marked(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ways), unset))
            elif p[0] == "sub":
                out = self.join(out, self.query(p[1], keep_kinds=True))
        out = self.spark.range(1).select(F.lit(1).alias("__one"), F.lit("").alias("__one#k")) if out is None else out
        for p in parts:
            if p[0] == "optional":
                # a condition may speak of variables outside, so it belongs to the join
                checks = [x[1] for x in p[1] if x[0] == "filter"]
                right = self.group([x for x in p[1] if x[0] != "filter"])
                for c in checks:
                    if isinstance(c, tuple) and c[0] == "exists":
                        right = self.filtered(right, c)
                out = self.join(out, right, "left", [c for c in checks if not (isinstance(c, tuple) and c[0] == "exists")])
            elif p[0] == "minus":
                right = self.group(p[1])
                if set(self.names(out)) & set(self.names(right)):
                    out = self.join(out, right, "left_anti")
            elif p[0] == "bind":
                out = self.marked(out.withColumns({p[1]: self.text(p[2], out), kind_of(p[1]): self.kinds(p[2], out)}), self.loose(out) | {p[1]})
        unset = self.loose(out)
        for c in filters:
            out = self.marked(self.filtered(out, c), unset)
        return out

    def filtered(self, df: DataFrame, c) -> DataFrame:
        if isinstance(c, tuple) and c[0] == "exists":
            return self.join(df, self.group(c[2]), "left_semi" if c[1] else "left_anti")
        if isinstance(c, tuple) and c[0] == "&&":
            first = self.marked(self.filtered(df, c[1]), self.loose(df))
            return self.filtered(first, c[2])
        return df.where(self.truth(c, df))

    # expressions

    def text(self, e, df: DataFrame) -> Column:
        if isinstance(e, Term):
            return F.lit(e.value)
        if e[0] == "var":
            return F.col(f"`{e[1]}`") if e[1] in df.columns else F.lit(None).cast("string")
        if e[0] == "call":
            args = [self.text(a, df) for a in e[2]] if e[2] != ["*"] else []
            simple = {"STR": lambda a: a, "UCASE": F.upper, "LCASE": F.lower, "STRLEN": F.char_length, "ABS": lambda a: F.abs(a.try_cast("double")), "ROUND": lambda a: F.round(a.try_cast("double")), "CONCAT": F.concat, "COALESCE": F.coalesce, "STRAFTER": lambda a, b: F.when(a.contains(b), F.substring(a, F.position(b, a) + F.char_length(b), F.char_length(a))).otherwise("")}
            if e[1] in simple:
                return simple[e[1]](*args).cast("string")
            if e[1] == "IF":
                return F.when(self.truth(e[2][0], df), args[1]).otherwise(args[2])
            if e[1] in ("LANG", "DATATYPE"):
                return F.get(F.split(self.kinds(e[2][0], df), "\x1f"), F.lit(2 if e[1] == "LANG" else 1))
        if e[0] in ("+", "-", "*", "/"):
            return self.number(e, df).cast("string")
        return self.truth(e, df).cast("string")

    def kinds(self, e, df: DataFrame) -> Column:
        if isinstance(e, Term):
            return F.lit(_term_kind(e))
        if e[0] == "var":
            return F.col(f"`{kind_of(e[1])}`") if e[1] in df.columns else F.lit(None).cast("string")
        return F.lit(_term_kind(Term("", "lit", XSD + ("double" if e[0] in ("+", "-", "*", "/") else "string"))))

    def number(self, e, df: DataFrame) -> Column:
        if not isinstance(e, Term) and e[0] in ("+", "-", "*", "/"):
            a, b = self.number(e[1], df), self.number(e[2], df)
            return {"+": a + b, "-": a - b, "*": a * b, "/": F.try_divide(a, b)}[e[0]]
        return self.text(e, df).try_cast("double")

    def truth(self, e, df: DataFrame) -> Column:
        if isinstance(e, Term):
            return F.lit(e.value == "true")
        op = e[0]
        if op in ("&&", "||"):
            a, b = self.truth(e[1], df), self.truth(e[2], df)
            return a & b if op == "&&" else a | b
        if op == "!":
            return ~self.truth(e[1], df)
        if op == "in":
            return reduce(lambda a, b: a | b, [self.truth(("=", e[1], x), df) for x in e[2]])
        if op in ("=", "!=", "<", ">", "<=", ">="):
            x, y = self.number(e[1], df), self.number(e[2], df)
            tx, ty = self.text(e[1], df), self.text(e[2], df)
            both = x.isNotNull() & y.isNotNull()
            if op in ("=", "!="):
                same = F.when(both, x == y).otherwise((tx == ty) & (F.substring_index(self.kinds(e[1], df), "\x1f", 1) == F.substring_index(self.kinds(e[2], df), "\x1f", 1)))
                return same if op == "=" else ~same
            less = {"<": (x < y, tx < ty), ">": (x > y, tx > ty), "<=": (x <= y, tx <= ty), ">=": (x >= y, tx >= ty)}[op]
            return F.when(both, less[0]).otherwise(less[1])
        if op == "call":
            a = [self.text(x, df) for x in e[2]] if e[2] != ["*"] else []
            kind = lambda: F.substring_index(self.kinds(e[2][0], df), "\x1f", 1)
            calls = {"BOUND": lambda: a[0].isNotNull(), "CONTAINS": lambda: a[0].contains(a[1]), "STRSTARTS": lambda: a[0].startswith(a[1]), "STRENDS": lambda: a[0].endswith(a[1]), "ISIRI": lambda: kind() == "iri", "ISURI": lambda: kind() == "iri", "ISLITERAL": lambda: kind() == "lit", "ISBLANK": lambda: kind() == "bnode"}
            if e[1] == "REGEX":
                pattern = e[2][1].value
                return a[0].rlike(("(?i)" if len(e[2]) > 2 and "i" in e[2][2].value else "") + pattern)
            if e[1] in calls:
                return calls[e[1]]()
            raise ValueError(f"{e[1]} isn't supported")
        if op == "var":
            return F.col(f"`{e[1]}`") == "true"
        raise ValueError(f"not a condition: {e!r}")

    def aggregate(self, e, df: DataFrame) -> Column:
        _, name, args, distinct, separator = e
        if name == "COUNT":
            if args == ["*"]:
                return F.count("*").cast("string")
            c = self.text(args[0], df)
            return (F.count_distinct(c) if distinct else F.count(c)).cast("string")
        c, n = self.text(args[0], df), self.number(args[0], df)
        if name == "GROUP_CONCAT":
            return F.array_join(F.array_sort(F.collect_set(c) if distinct else F.collect_list(c)), separator)
        if name == "SUM":
            whole = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("decimal(38,0)"))
            total = lambda x: F.sum_distinct(x) if distinct else F.sum(x)
            return F.when(F.count(c) == F.count(whole), F.coalesce(total(whole), F.lit(0).cast("decimal(38,0)")).cast("string")).otherwise(total(n).cast("string"))
        if name == "AVG":
            return F.avg(n).cast("string")
        if name == "SAMPLE":
            return F.min(c)
        numeric = F.min(n) if name == "MIN" else F.max(n)
        return F.when(F.count(n) == F.count(c), F.min_by(c, n) if name == "MIN" else F.max_by(c, n)).otherwise(F.min(c) if name == "MIN" else F.max(c)) if numeric is not None else c

    def query(self, q: dict, keep_kinds: bool = False) -> DataFrame:
        df = self.group(q["where"])
        items = q["items"] if q["items"] is not None else [(v, ("var", v)) for v in self.names(df) if not v.startswith("__")]
        is_agg = lambda e: isinstance(e, tuple) and e[0] == "call" and e[1] in _AGG
        if q["group"] is not None or any(is_agg(e) for _, e in items):
            keys = q["group"] or []
            aggs = {v: e for v, e in items if is_agg(e)}
            extra: dict[str, tuple] = {}

            def lifted(e):
                """Aggregates inside HAVING and ORDER BY become columns."""
                if is_agg(e):
                    name = f"__h{len(extra)}"
                    extra[name] = e
                    return ("var", name)
                return tuple(lifted(x) if isinstance(x, tuple) else x for x in e) if isinstance(e, tuple) and not isinstance(e, Term) else e

            having, order = [lifted(h) for h in q["having"]], [(lifted(e), d) for e, d in q["order"]]
            cols = [self.aggregate(e, df).alias(v) for v, e in {**aggs, **extra}.items()]
            cols += [F.min(F.col(f"`{kind_of(v)}`")).alias(kind_of(v)) for v in keys]
            df = df.groupBy(*[F.col(f"`{v}`") for v in keys]).agg(*cols)
            typed = lambda v, e: F.lit(_term_kind(Term("", "lit", XSD + "integer"))) if e[1] == "COUNT" else F.when(F.col(f"`{v}`").rlike(r"^[+-]?\d+$"), _term_kind(Term("", "lit", XSD + "integer"))).when(F.col(f"`{v}`").try_cast("double").isNotNull(), _term_kind(Term("", "lit", XSD + "decimal"))).otherwise(_term_kind(Term("", "lit", XSD + "string")))
            df = df.withColumns({kind_of(v): typed(v, e) for v, e in {**aggs, **extra}.items()})
            for h in having:
                df = self.filtered(df, h)
            q = q | {"order": order}
            items = [(v, ("var", v)) for v, _ in items]
        else:
            new = {v: e for v, e in items if e != ("var", v)}
            for v, e in new.items():
                df = df.withColumns({v: self.text(e, df), kind_of(v): self.kinds(e, df)})
        names = [v for v, _ in items]
        shown = [F.col(f"`{v}`") if v in df.columns else F.lit(None).cast("string").alias(v) for v in names]
        order = [x for e, down in q["order"] for x in ((self.number(e, df).desc_nulls_last(), self.text(e, df).desc_nulls_last()) if down else (self.number(e, df).asc_nulls_last(), self.text(e, df).asc_nulls_last()))]
        kinds = [F.col(f"`{kind_of(v)}`") if v in df.columns else F.lit(None).cast("string").alias(kind_of(v)) for v in names]
        if q["distinct"]:
            df = df.dropDuplicates([c for v in names if v in df.columns for c in (v, kind_of(v))])
        df = df.orderBy(*order) if order else df
        df = df.offset(q["offset"]) if q["offset"] else df
        df = df.limit(q["limit"]) if q["limit"] is not None else df
        unset = self.loose(df) if hasattr(df, "_loose") else set()
        return self.marked(df.select(*shown, *(kinds if keep_kinds else [])), unset)


def select(triples: DataFrame, text: str) -> DataFrame:
    """The result of a SELECT query, every column a string."""
    p = _Parser(text)
    p.prologue()
    if p.peek().upper() != "SELECT":
        raise ValueError(f"only SELECT is supported, not {p.peek().upper() or 'nothing'}")
    q = p.select()
    if p.at != len(p.tokens):
        raise ValueError(f"unexpected {p.peek()!r}")
    return _Planner(triples).query(q)


def update(text: str) -> list[tuple[str, list[Triple]]]:
    """The steps of INSERT DATA and DELETE DATA."""
    head = "\n".join(f"@prefix {m[1]}: <{m[2]}> ." for m in re.finditer(r"PREFIX\s+([\w-]*):\s*<([^>]*)>", text, re.I))
    found = [(m[1].lower(), parse(head + "\n" + m[2].strip().removesuffix(".") + " .")) for m in re.finditer(r"\b(INSERT|DELETE)\s+DATA\s*\{(.*?)\}", text, re.I | re.S)]
    if not found:
        raise ValueError("only INSERT DATA and DELETE DATA are supported")
    return found
