"""The engine's operators as queries over the driver's tables, each with its SQL.

Graph view: every order, customer, nation, region and supplier is a node of class ``urn:t/<table>``; keys become names
such as ``urn:o/5``. Series view: ``events`` as points ``urn:ev/u<user>/<type>``. All queries read whole tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..functions.text import Concept, Lexicon, match_all
from ..functions.units import Unit, Units
from ..operators import series as S
from ..operators.hops import closure, reachable
from ..operators.triples import TripleStore, union_graph
from ..sources.files import references
from ..sources.rdf import SCHEMA
from ..streaming.ingest import complete_rows, with_payload
from ..vocab import RDF_TYPE, XSD, Vocabulary
from . import sparql
from .compiler import Compiler
from .ir import Pattern
from .query import Query

V = Vocabulary()
P = "urn:p/"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- views -------------------------------------------------------------------------------------------------------

#: name, table, subject prefix, key, [(predicate, column, object prefix or None for a literal)]
_NODES = [
    ("region", "urn:r/", "r_regionkey", [("label", "r_name", None)]),
    ("nation", "urn:n/", "n_nationkey", [("label", "n_name", None), ("inRegion", "n_regionkey", "urn:r/")]),
    ("customer", "urn:c/", "c_custkey", [("segment", "c_mktsegment", None), ("inNation", "c_nationkey", "urn:n/")]),
    ("supplier", "urn:s/", "s_suppkey", [("inNation", "s_nationkey", "urn:n/")]),
    ("orders", "urn:o/", "o_orderkey", [("status", "o_orderstatus", None), ("placedBy", "o_custkey", "urn:c/")]),
]


def triples(spark: SparkSession, sf: str, tables: tuple[str, ...] = ("region", "nation", "customer", "supplier", "orders")) -> DataFrame:
    """The star schema as triples: each table is scanned once and its row exploded into its triples."""
    parts = []
    for name, prefix, key, props in _NODES:
        if name not in tables:
            continue
        s = F.concat(F.lit(prefix), F.col(key).cast("string"))
        rows = [F.struct(F.lit(RDF_TYPE).alias("p"), F.lit(f"urn:t/{name}").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"))]
        for p, col, to in props:
            value = F.col(col).cast("string")
            rows.append(F.struct(F.lit(P + p).alias("p"), (value if to is None else F.concat(F.lit(to), value)).alias("o"), F.lit("lit" if to is None else "iri").alias("o_kind"), F.lit(XSD + "string" if to is None else None).cast("string").alias("o_datatype")))
        if name in ("supplier", "customer"):  # these are the data nodes of the view
            rows.append(F.struct(F.lit(V.external_reference).alias("p"), F.concat(F.lit("urn:ref/"), s).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype")))
        parts.append(table(spark, sf, name).select(s.alias("s"), F.explode(F.array(*rows)).alias("t")).select(F.lit("main").alias("g"), "s", "t.*", F.lit(None).cast("string").alias("o_lang")))
    return reduce(DataFrame.unionByName, parts)


def series(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.concat(F.lit("urn:ev/u"), F.col("user_id").cast("string"), F.lit("/"), "event_type").alias("point_uri"), "ts", F.col("value").cast("string").alias("value"), F.col("value").alias("number"), "event_id", "user_id", "event_type")


_SERIES_SQL = "series as (select 'urn:ev/u' || user_id || '/' || event_type point_uri, ts, value::varchar \"value\", value number, event_id, user_id, event_type from events)"
_EDGES_SQL = """edges as (
 select 'urn:o/' || o_orderkey s, 'placedBy' p, 'urn:c/' || o_custkey o from orders union all
 select 'urn:c/' || c_custkey, 'inNation', 'urn:n/' || c_nationkey from customer union all
 select 'urn:s/' || s_suppkey, 'inNation', 'urn:n/' || s_nationkey from supplier union all
 select 'urn:n/' || n_nationkey, 'inRegion', 'urn:r/' || n_regionkey from nation)"""


def _bindings(spark: SparkSession, sf: str, pattern: Pattern, tables, names: list[str]) -> DataFrame:
    return Compiler(triples(spark, sf, tables), V).compile(pattern).toDF(*names)


def _t(name: str) -> str:
    return f"urn:t/{name}"


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that reach a region within three steps, with the order's latest date in each region's nations."""
    found = _bindings(spark, sf, Pattern().with_node(_t("orders"), "o").with_node(_t("region"), "r").with_edge(0, 1, (), 3), ("region", "nation", "customer", "orders"), ["o", "r"])
    dates = table(spark, sf, "orders").select(F.concat(F.lit("urn:o/"), F.col("o_orderkey").cast("string")).alias("o"), "o_orderdate")
    return found.join(dates, "o").groupBy("r").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("latest"))


query("flagship", "select 'urn:r/' || n_regionkey r, count(*) n_orders, max(o_orderdate) latest from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1")(flagship)

# --- graph patterns ----------------------------------------------------------------------------------------------


@query("type_scan", "select 'urn:c/' || c_custkey c from customer")
def type_scan(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("customer"), "c"), ("customer", "nation"), ["c"])


@query("cross_entities", "select 'urn:n/' || n_nationkey n, 'urn:r/' || r_regionkey r from nation, region")
def cross_entities(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("nation"), "n").with_node(_t("region"), "r"), ("nation", "region"), ["n", "r"])


@query("hop1_any", "select 'urn:c/' || c_custkey c, 'urn:n/' || c_nationkey n from customer join nation on c_nationkey = n_nationkey")
def hop1_any(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("customer"), "c").with_node(_t("nation"), "n").with_edge(0, 1), ("customer", "nation"), ["c", "n"])


@query("hop1_preds", "select 'urn:n/' || n_nationkey a, 'urn:r/' || n_regionkey b from nation join region on n_regionkey = r_regionkey")
def hop1_preds(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("nation"), "a").with_node(_t("region"), "b").with_edge(0, 1, (P + "inRegion", P + "inNation", P + "inRegion")), ("nation", "region"), ["a", "b"])


_NEXT_SQL = "select 'urn:n/' || n_nationkey s, 'urn:n/' || (n_nationkey + 1) % 25 o from nation"


@query("hop2_pred", f"with e as ({_NEXT_SQL}) select s a, o b from e union select x.s, y.o from e x join e y on x.o = y.s")
def hop2_pred(spark, sf):
    """One or two steps of one predicate, on a ring of nations."""
    n = table(spark, sf, "nation")
    name = lambda c: F.concat(F.lit("urn:n/"), c.cast("string"))
    ring = n.select(F.lit("main").alias("g"), name(F.col("n_nationkey")).alias("s"), F.lit(P + "next").alias("p"), name((F.col("n_nationkey") + 1) % 25).alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    t = triples(spark, sf, ("nation",)).unionByName(ring)
    pattern = Pattern().with_node(_t("nation"), "a").with_node(_t("nation"), "b").with_edge(0, 1, (P + "next",), 2)
    return Compiler(t, V).compile(pattern).toDF("a", "b")


@query("hop3_any", "select 'urn:o/' || o_orderkey o, 'urn:r/' || n_regionkey r from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def hop3_any(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("orders"), "o").with_node(_t("region"), "r").with_edge(0, 1, (), 3), ("region", "nation", "customer", "orders"), ["o", "r"])


@query("hop_set_multi", "select 'urn:s/' || s_suppkey s, 'urn:r/' || n_regionkey r from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def hop_set_multi(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("supplier"), "s").with_node(_t("region"), "r").with_edge(0, 1, (P + "inNation", P + "inRegion"), 2), ("supplier", "nation", "region"), ["s", "r"])


@query("all_reachable", f"with recursive {_EDGES_SQL}, walk as (select s, o, 1 k from edges union select w.s, e.o, k + 1 from walk w join edges e on w.o = e.s where k < 3) select distinct s, o from walk where s like 'urn:s/%'")
def all_reachable(spark, sf):
    t = triples(spark, sf).where((F.col("o_kind") == "iri") & ~F.col("p").isin(RDF_TYPE, V.external_reference))
    seeds = t.where(F.col("s").startswith("urn:s/")).select(F.col("s").alias("src"))
    return reachable(t, seeds, 3).toDF("s", "o")


@query("chain_pattern", "select 'urn:c/' || c_custkey a, 'urn:n/' || n_nationkey b, 'urn:r/' || n_regionkey c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def chain_pattern(spark, sf):
    p = Pattern().with_node(_t("customer"), "a").with_node(_t("nation"), "b").with_node(_t("region"), "c").with_edge(0, 1).with_edge(1, 2)
    return _bindings(spark, sf, p, ("customer", "nation", "region"), ["a", "b", "c"])


@query("star_pattern", "select 'urn:c/' || c_custkey a, 'urn:n/' || n_nationkey b, 'urn:r/' || n_regionkey c from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def star_pattern(spark, sf):
    p = Pattern().with_node(_t("customer"), "a").with_node(_t("nation"), "b").with_node(_t("region"), "c").with_edge(0, 1).with_edge(0, 2, (), 2)
    return _bindings(spark, sf, p, ("customer", "nation", "region"), ["a", "b", "c"])


@query("relate_to_pattern", "select 'urn:o/' || o_orderkey o, 'urn:n/' || c_nationkey n from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def relate_to_pattern(spark, sf):
    both, ids = Pattern().with_node(_t("orders"), "o").merged(Pattern().with_node(_t("nation"), "n"))
    return _bindings(spark, sf, both.with_edge(0, ids[0], (), 2), ("orders", "customer", "nation"), ["o", "n"])


@query("data_nodes_all", "select 'urn:c/' || c_custkey d from customer union all select 'urn:s/' || s_suppkey from supplier")
def data_nodes_all(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(None, "d", {}), ("customer", "supplier"), ["d"])


@query("find_data_from", "select 'urn:o/' || o_orderkey o, 'urn:c/' || o_custkey d from orders join customer on o_custkey = c_custkey")
def find_data_from(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("orders"), "o").with_node(None, "d", {}).with_edge(0, 1), ("orders", "customer"), ["o", "d"])


@query("filter_unit", "select 'urn:s/' || s_suppkey d from supplier where s_nationkey = 3 union all select 'urn:c/' || c_custkey from customer where c_nationkey = 3")
def filter_unit(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(None, "d", {P + "inNation": "urn:n/3"}), ("customer", "supplier"), ["d"])


@query("filter_two_props", "select 'urn:c/' || c_custkey d from customer where c_nationkey = 3 and c_mktsegment = 'BUILDING'")
def filter_two_props(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(None, "d", {P + "inNation": "urn:n/3", P + "segment": "BUILDING", P + "none": None}), ("customer", "supplier"), ["d"])


@query("filter_literal", "select 'urn:c/' || c_custkey d from customer where c_mktsegment = 'MACHINERY'")
def filter_literal(spark, sf):
    return _bindings(spark, sf, Pattern().with_node(_t("customer"), "d", {P + "segment": "MACHINERY"}), ("customer",), ["d"])


@query("optional_refs", "select 'urn:n/' || n_nationkey n, 'urn:s/' || s_suppkey s from nation left join supplier on s_nationkey = n_nationkey")
def optional_refs(spark, sf):
    return sparql.select(triples(spark, sf, ("nation", "supplier")), f"SELECT ?n ?s WHERE {{ ?n a <{_t('nation')}> OPTIONAL {{ ?s <{P}inNation> ?n }} }}")


@query("ref_type_in", "select 'urn:r/' || r_regionkey x from region union all select 'urn:n/' || n_nationkey from nation")
def ref_type_in(spark, sf):
    return sparql.select(triples(spark, sf, ("nation", "region", "supplier")), f"SELECT ?x WHERE {{ ?x a ?t FILTER(?t IN (<{_t('nation')}>, <{_t('region')}>)) }}")


@query("sparql_group", "select 'urn:n/' || c_nationkey n, count(*)::varchar k from customer group by 1 having count(*) > 2")
def sparql_group(spark, sf):
    return sparql.select(triples(spark, sf, ("nation", "customer")), f"SELECT ?n (COUNT(?c) AS ?k) WHERE {{ ?c a <{_t('customer')}> . ?c <{P}inNation> ?n }} GROUP BY ?n HAVING (COUNT(?c) > 2)")


@query("sparql_minus", "select 'urn:c/' || c_custkey x from customer")
def sparql_minus(spark, sf):
    return sparql.select(triples(spark, sf, ("nation", "supplier", "customer")), f"SELECT ?x WHERE {{ ?x <{P}inNation> ?n MINUS {{ ?x a <{_t('supplier')}> }} }}")


@query("sparql_optional_filter", "select 'urn:n/' || n_nationkey n, 'urn:s/' || s_suppkey s from nation left join supplier on s_nationkey = n_nationkey and 'urn:s/' || s_suppkey > 'urn:s/' || n_nationkey and n_name <> 'FRANCE'")
def sparql_optional_filter(spark, sf):
    """A condition inside OPTIONAL that speaks of outer variables."""
    rows = triples(spark, sf, ("nation", "supplier")).where(F.col("p") != V.external_reference)
    found = sparql.select(rows, f"SELECT ?n ?s WHERE {{ ?n a <{_t('nation')}> . ?n <{P}label> ?name OPTIONAL {{ ?s <{P}inNation> ?n FILTER(?name != 'FRANCE' && STR(?s) > CONCAT('urn:s/', STRAFTER(STR(?n), 'urn:n/'))) }} }}")
    return found


@query("sparql_values_undef", "select 'urn:n/' || n_nationkey n, 'urn:r/' || n_regionkey r from nation where n_nationkey = 3 or n_regionkey = 2")
def sparql_values_undef(spark, sf):
    return sparql.select(triples(spark, sf, ("nation", "region")), f"SELECT DISTINCT ?n ?r WHERE {{ ?n <{P}inRegion> ?r VALUES (?n ?r) {{ (<urn:n/3> UNDEF) (UNDEF <urn:r/2>) }} }}")


@query("sparql_union_join", "select 'urn:n/' || n_nationkey x, n_name name from nation union all select 'urn:r/' || r_regionkey, n.n_name from region, nation n")
def sparql_union_join(spark, sf):
    """A UNION branch that leaves a variable unbound which is joined later."""
    t = triples(spark, sf, ("nation", "region"))
    return sparql.select(t, f"SELECT ?x ?name WHERE {{ {{ ?x a <{_t('nation')}> . ?x <{P}label> ?name }} UNION {{ ?x a <{_t('region')}> }} ?any <{P}label> ?name . ?any a <{_t('nation')}> }}")


@query("sparql_sum", "select 'urn:r/' || n_regionkey r, count(*)::varchar k, sum(n_nationkey)::varchar total from nation group by 1")
def sparql_sum(spark, sf):
    """Sums of whole numbers are whole numbers."""
    n = table(spark, sf, "nation")
    s_ = F.concat(F.lit("urn:n/"), F.col("n_nationkey").cast("string"))
    numbers = n.select(F.lit("main").alias("g"), s_.alias("s"), F.lit(P + "number").alias("p"), F.col("n_nationkey").cast("string").alias("o"), F.lit("lit").alias("o_kind"), F.lit(XSD + "integer").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    t = triples(spark, sf, ("nation",)).unionByName(numbers)
    return sparql.select(t, f"SELECT ?r (COUNT(?n) AS ?k) (SUM(?x) AS ?total) WHERE {{ ?n <{P}inRegion> ?r . ?n <{P}number> ?x }} GROUP BY ?r")


def _store(spark, sf, tables) -> TripleStore:
    store = TripleStore(spark, V)
    store.triples = triples(spark, sf, tables)
    return store


def _series_store(spark, rows: DataFrame) -> S.SeriesStore:
    store = S.SeriesStore(spark)
    store._frame = rows.select("point_uri", F.col("ts").cast("timestamp").alias("ts"), "value")
    return store


def _plain(rows: DataFrame, *times: str) -> DataFrame:
    """Time columns without a zone, as the driver's tables have them."""
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in times})


class _Source:
    """What a ``Query`` needs of an engine."""

    def __init__(self, spark, store: TripleStore, series: S.SeriesStore):
        self.spark, self.store, self.series, self.vocab = spark, store, series, V

    def resolve(self, text: str, kind: str | None = None) -> str:
        return text


@query("triples_counts", "select n, n u from (select 2 * (select count(*) from region) + 3 * (select count(*) from nation) + 4 * (select count(*) from customer) + 3 * (select count(*) from supplier) + 3 * (select count(*) from orders) n)")
def triples_counts(spark, sf):
    n = _store(spark, sf, ("region", "nation", "customer", "supplier", "orders")).counts()
    return spark.createDataFrame([(n["main"], n["union"])], "n long, u long")


@query("union_graph", "select 'urn:n/' || n_nationkey s, 'label' p, n_name o from nation union select 'urn:r/' || r_regionkey, 'label', r_name from region")
def union_graph_query(spark, sf):
    main = triples(spark, sf, ("nation",)).where(F.col("p") == P + "label")
    link = spark.createDataFrame([("main", "urn:main", V.imports, "urn:ont/r", "iri", None, None)], SCHEMA)
    ontology = triples(spark, sf, ("region",)).where(F.col("p") == P + "label").withColumn("g", F.lit("urn:ont/r"))
    return union_graph(main.unionByName(link), ontology).where(F.col("p") == P + "label").select("s", F.lit("label").alias("p"), "o")


@query("delete_point", "select 'urn:c/' || c_custkey s, 'urn:n/' || c_nationkey o from customer where c_nationkey <> 7")
def delete_point(spark, sf):
    store = _store(spark, sf, ("customer", "nation"))
    store.delete("urn:n/7")
    return store.main().where((F.col("p") == P + "inNation")).select("s", "o")


@query("point_catalog", "select 'urn:n/' || n_nationkey uri, string_agg(x, ';' order by x) suppliers, count(x) n, case when n_nationkey % 2 = 0 then 'urn:u/' || n_regionkey end unit from nation left join (select s_nationkey k, 'urn:s/' || s_suppkey x from supplier) on k = n_nationkey group by n_nationkey, n_regionkey")
def point_catalog(spark, sf):
    """Nations as virtual points calculated from their suppliers, half of them with a unit, read from the store's catalogue."""
    store, n = TripleStore(spark, V), table(spark, sf, "nation")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    fact = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    uri = name("urn:n/", "n_nationkey")
    of_nation = n.select(F.explode(F.array(fact(uri, V.type, F.lit(V.term("Stream"))), fact(uri, V.has_unit, F.when(F.col("n_nationkey") % 2 == 0, name("urn:u/", "n_regionkey"))))).alias("t")).select("t.*").where("o is not null")
    sources = table(spark, sf, "supplier").select(name("urn:n/", "s_nationkey").alias("s"), F.lit(V.term("isCalculatedFrom")).alias("p"), name("urn:s/", "s_suppkey").alias("o"))
    none = F.lit(None).cast("string")
    store.triples = of_nation.unionByName(sources).select(F.lit("main").alias("g"), "s", "p", "o", F.lit("iri").alias("o_kind"), none.alias("o_datatype"), none.alias("o_lang"))
    found = store.points()
    return found.select("uri", F.when(F.size("sources") > 0, F.array_join("sources", ";")).alias("suppliers"), F.size("sources").cast("long").alias("n"), "unit")


# --- series ------------------------------------------------------------------------------------------------------


_ORDER_SERIES = "select 'urn:c/' || o_custkey point_uri, o_orderdate ts, o_totalprice::varchar \"value\", o_orderkey seq from orders"


def order_series(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("urn:c/"), F.col("o_custkey").cast("string")).alias("point_uri"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderkey").alias("seq"))


_ORDER_SQL = f"o as ({_ORDER_SERIES})"


@query("series_range", f"with {_SERIES_SQL}, b as (select date_trunc('second', min(ts)) lo from events) select point_uri, ts, \"value\" from series, b where ts between lo + interval 1 day and lo + interval 9 day")
def series_range(spark, sf):
    from datetime import timedelta

    lo = table(spark, sf, "events").agg(F.min("ts")).first()[0].replace(microsecond=0)
    rows = _series_store(spark, series(spark, sf)).frame()
    return _plain(S.ranged(rows, (lo + timedelta(days=1)).isoformat(), (lo + timedelta(days=9)).isoformat() + "Z"), "ts")


for _order in ("asc", "desc"):

    @query(f"series_topk_{_order}", f"with {_ORDER_SQL}, t as (select point_uri from o group by 1 having count(distinct ts) = count(*) order by count(*) desc, point_uri limit 1) select point_uri, ts, \"value\" from o join t using (point_uri) order by ts {_order} limit 5")
    def series_topk(spark, sf, order=_order):
        """The first samples of the busiest point whose times differ, by the store's scan."""
        rows = order_series(spark, sf)
        point = rows.groupBy("point_uri").agg(F.count("*").alias("n"), F.count_distinct("ts").alias("d")).where("n = d").orderBy(F.desc("n"), "point_uri").first().point_uri
        return _plain(_series_store(spark, rows).scan(point, limit=5, order=order), "ts")


@query("series_limit_per_point", f"with {_SERIES_SQL} select point_uri, ts, \"value\" from series qualify row_number() over (partition by point_uri order by ts) <= 3")
def series_limit_per_point(spark, sf):
    return S.limited(series(spark, sf).select("point_uri", "ts", "value"), 3)


@query("latest_narrow", f"with {_SERIES_SQL} select point_uri, max(ts) ts, arg_max(\"value\", ts) \"value\" from series group by 1")
def latest_narrow(spark, sf):
    return S.latest(series(spark, sf))


_TYPES_SQL = ", ".join(f"max(number) filter (event_type = '{t}') {t}" for t in ("click", "purchase", "signup", "view"))


_KINDS = ("click", "purchase", "signup", "view")
_BY_TYPE_SQL = "k as (select 'urn:ev/' || event_type point_uri, ts, max(value) number from events group by 1, 2)"
_WIDE_SQL = ", ".join(f"max(number) filter (point_uri = 'urn:ev/{t}') {t}" for t in _KINDS)


def by_type(spark, sf) -> DataFrame:
    """One series for each type of event, with the largest value of each time."""
    e = table(spark, sf, "events").groupBy(F.concat(F.lit("urn:ev/"), "event_type").alias("point_uri"), "ts").agg(F.max("value").alias("value"))
    return e


@query("latest_wide", f"with {_BY_TYPE_SQL}, l as (select * from k qualify row_number() over (partition by point_uri order by ts desc) = 1) select ts \"time\", {_WIDE_SQL} from l group by 1")
def latest_wide(spark, sf):
    return S.wide(S.limited(by_type(spark, sf), 1, "desc"), [f"urn:ev/{t}" for t in _KINDS])


@query("wide_frame", f"with {_BY_TYPE_SQL} select ts \"time\", {_WIDE_SQL} from k group by 1")
def wide_frame(spark, sf):
    return S.wide(by_type(spark, sf), [f"urn:ev/{t}" for t in _KINDS])


@query("narrow_frame", f"with {_SERIES_SQL} select ts \"time\", \"value\", string_split(point_uri, '/')[-1] id from series where user_id % 2 = 0")
def narrow_frame(spark, sf):
    s = series(spark, sf)
    points = s.where("user_id % 2 = 0").select("point_uri").distinct()
    return s.join(points, "point_uri").select(F.col("ts").alias("time"), "value", X.local_name(F.col("point_uri")).alias("id"))


@query("cast_float", f"with {_SERIES_SQL} select point_uri, ts, number \"value\" from series")
def cast_float(spark, sf):
    return S.cast_values(series(spark, sf).select("point_uri", "ts", "value"), "float")


@query("cast_int_fallback", f"with {_SERIES_SQL} select point_uri, ts, \"value\" from series")
def cast_int_fallback(spark, sf):
    return S.cast_values(series(spark, sf).select("point_uri", "ts", "value"), "int")


@query("series_info", f"with {_SERIES_SQL} select point_uri, count(*) row_count, min(ts) earliest, max(ts) latest from series group by 1")
def series_info(spark, sf):
    return series(spark, sf).groupBy("point_uri").agg(F.count("*").alias("row_count"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


@query("upsert_lastwins", f"with o as ({_ORDER_SERIES}) select point_uri, ts, arg_max(\"value\", seq) \"value\" from o group by 1, 2")
def upsert_lastwins(spark, sf):
    return S.last_write_wins(order_series(spark, sf))


@query("bulk_merge", f"with o as ({_ORDER_SERIES}), u as (select point_uri, ts, \"value\", seq from o union all select point_uri, ts, 'new', 1000000000 + seq from o where seq % 3 = 0) select point_uri, ts, arg_max(\"value\", seq) \"value\" from u group by 1, 2")
def bulk_merge(spark, sf):
    o = order_series(spark, sf)
    new = o.where("seq % 3 = 0").select("point_uri", "ts", F.lit("new").alias("value"), (F.col("seq") + 1_000_000_000).alias("seq"))
    return S.last_write_wins(o.unionByName(new))


@query("replace_rows", f"with {_ORDER_SQL}, g as (select distinct point_uri from o where seq % 5 = 0), n as (select point_uri, ts, arg_max(\"value\", seq) \"value\" from o where seq % 5 = 0 group by 1, 2) select * from n union all select point_uri, ts, arg_max(\"value\", seq) from o where point_uri not in (from g) group by 1, 2")
def replace_rows(spark, sf):
    """Points with any of the chosen rows keep these only; the store replaces them as a whole."""
    o = order_series(spark, sf)
    store = _series_store(spark, S.last_write_wins(o))
    store.merge(o.where("seq % 5 = 0").withColumn("ts", F.col("ts").cast("timestamp")), replace=True)
    return _plain(store.frame().select("point_uri", "ts", "value"), "ts")


@query("stream_handles", f"with {_SERIES_SQL} select distinct sha1(point_uri)[1:10] handle, point_uri uri from series")
def stream_handles(spark, sf):
    return S.handles(series(spark, sf).select(F.col("point_uri").alias("uri")))


@query("resolve_handle", f"with {_SERIES_SQL}, h as (select distinct sha1(point_uri)[1:10] handle, point_uri uri from series where user_id % 2 = 0), w as (select distinct sha1(point_uri)[1:10] handle from series) select w.handle, coalesce(h.uri, w.handle) resolved from w left join h using (handle)")
def resolve_handle(spark, sf):
    s = series(spark, sf)
    known = S.handles(s.where("user_id % 2 = 0").select(F.col("point_uri").alias("uri")))
    wanted = s.select(X.stream_handle(F.col("point_uri")).alias("handle")).distinct()
    return wanted.join(known, "handle", "left").select("handle", F.coalesce("uri", "handle").alias("resolved"))


@query("bindings_series", "select 'c' || c_custkey id, ts \"time\", value from customer join events on user_id = c_custkey where c_nationkey = 3")
def bindings_series(spark, sf):
    """The series of all customers of one nation, found by pattern and fetched by the query's own frame."""
    e = table(spark, sf, "events").select(F.concat(F.lit("urn:c/"), F.col("user_id").cast("string")).alias("point_uri"), "ts", F.col("value").cast("string").alias("value"))
    source = _Source(spark, _store(spark, sf, ("customer", "nation")), _series_store(spark, e))
    q = Query(source).find_all_data(_class=_t("customer"), filters={P + "inNation": "urn:n/3"}, alias="c")
    return _plain(q.dataframe(cast_value="float"), "time").select(F.concat(F.lit("c"), "id").alias("id"), "time", "value")


# --- scalar rules ------------------------------------------------------------------------------------------------


@query("localname", "select url, case when len(string_split(url, '#')) = 2 then string_split(url, '#')[2] else string_split(url, '/')[-1] end name from pages")
def localname(spark, sf):
    return table(spark, sf, "pages").select("url", X.local_name(F.col("url")).alias("name"))


@query("qualify_uri", "select p_name, case when contains(p_name, '://') or starts_with(p_name, 'urn:') then p_name else 'http://base/' || p_name end uri from part")
def qualify_uri(spark, sf):
    return table(spark, sf, "part").select("p_name", X.qualified(F.col("p_name"), "http://base", V.points).alias("uri"))


@query("jaccard_tokens", "with t as (select p_partkey, list_distinct(string_split(lower(p_name), ' ')) a, list_distinct(string_split(lower(p_type), ' ')) b from part) select p_partkey, len(list_intersect(a, b))::double / len(list_distinct(list_concat(a, b))) j from t")
def jaccard_tokens(spark, sf):
    a, b = F.array_distinct(F.split(F.lower("p_name"), " ")), F.array_distinct(F.split(F.lower("p_type"), " "))
    return table(spark, sf, "part").select("p_partkey", X.jaccard(a, b).cast("double").alias("j"))


@query("initialisms", "select p_partkey, list_aggregate(list_transform(string_split(p_type, ' '), lambda x: x[1:1]), 'string_agg', '') initials from part")
def initialisms(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.initialism(F.split("p_type", " ")).alias("initials"))


@query("ts_parse", "select event_id, ts at_text, ts at_ms from (select event_id, date_trunc('second', ts) ts from events)")
def ts_parse(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    iso = F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ms = (F.unix_millis("t")).cast("string")
    return e.select("event_id", X.parsed_time(iso).cast("timestamp_ntz").alias("at_text"), X.parsed_time(ms).cast("timestamp_ntz").alias("at_ms"))


@query("payload_decode", "select event_id, len(json_keys(props)) n_keys from events")
def payload_decode(spark, sf):
    return with_payload(table(spark, sf, "events").select("event_id", "props"), "props", "found").select("event_id", F.size("found").cast("long").alias("n_keys"))


@query("unit_convert", "select event_id, (value + 459.67::double) * 0.5555555555555556::double / 1.0::double - 273.15::double celsius from events")
def unit_convert(spark, sf):
    from decimal import Decimal

    units = Units([Unit("u/DEG_F", "T", Decimal("0.5555555555555556"), Decimal("459.67")), Unit("u/DEG_C", "T", Decimal(1), Decimal("273.15"))])
    return table(spark, sf, "events").select("event_id", units.converted(F.col("value"), "DEG_F", "DEG_C").alias("celsius"))


@query("ingest_status", "select count(*) total, count(*) filter (o_orderstatus = 'F') done, count(*) filter (o_orderstatus = 'O') scheduled, count(*) filter (o_orderstatus = 'P') error from orders")
def ingest_status(spark, sf):
    is_ = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, sf, "orders").agg(F.count("*").alias("total"), is_("F").alias("done"), is_("O").alias("scheduled"), is_("P").alias("error"))


@query("reference_discovery", "select 'urn:s/' || s_suppkey point, 'urn:ref/urn:s/' || s_suppkey ref, case when s_suppkey % 2 = 0 then 's/' || s_suppkey || '.csv' end path, 0 time_col, (s_suppkey % 4)::int value_col from supplier")
def reference_discovery(spark, sf):
    s = table(spark, sf, "supplier")
    node = F.concat(F.lit("urn:s/"), F.col("s_suppkey").cast("string"))
    ref = F.concat(F.lit("urn:ref/"), node)
    row = lambda a, p, o, kind: F.struct(a.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"))
    path = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("s/"), F.col("s_suppkey").cast("string"), F.lit(".csv")))
    rows = F.array(row(node, V.external_reference, ref, "iri"), row(ref, V.type, F.lit(V.term("CSVReference")), "iri"), row(ref, V.term("hasFilePath"), path, "lit"), row(ref, V.term("hasValueColumn"), (F.col("s_suppkey") % 4).cast("string"), "lit"))
    t = s.select(F.explode(rows).alias("t")).select("t.*").where("o is not null")
    return references(t, V).drop("type")


# --- derived series ----------------------------------------------------------------------------------------------


@query("sensor_wide_mean", f"with {_SERIES_SQL}, w as (select date_trunc('day', ts) d, user_id, {_TYPES_SQL} from series group by 1, 2) select d, user_id, (coalesce(click, 0) + coalesce(\"view\", 0)) / 2 mean from w")
def sensor_wide_mean(spark, sf):
    w = series(spark, sf).groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("d"), "user_id").pivot("event_type", ["click", "purchase", "signup", "view"]).agg(F.max("number"))
    zero = F.lit(0.0)
    return w.select("d", "user_id", ((F.coalesce("click", zero) + F.coalesce("view", zero)) / 2).alias("mean"))


@query("sensor_one_to_one", f"with {_SERIES_SQL} select 'urn:virtual/' || sha1(point_uri)[1:8] uri, ts, number * 2 \"value\" from series")
def sensor_one_to_one(spark, sf):
    return series(spark, sf).select(F.concat(F.lit("urn:virtual/"), F.substring(F.sha1(F.col("point_uri").cast("binary")), 1, 8)).alias("uri"), "ts", (F.col("number") * 2).alias("value"))


@query("dirty_propagation", f"with recursive {_EDGES_SQL}, hit as (select 'urn:n/3' s union select e.s from edges e join hit h on e.o = h.s) select s from hit")
def dirty_propagation(spark, sf):
    """Everything that depends on one changed node, directly or not: backward reachability from it."""
    t = triples(spark, sf).where((F.col("o_kind") == "iri") & ~F.col("p").isin(RDF_TYPE, V.external_reference))
    seed = spark.createDataFrame([("urn:n/3",)], "src string")
    return closure(t.select(F.col("o").alias("src"), F.col("s").alias("dst")), seed).select(F.col("dst").alias("s")).union(seed.toDF("s")).distinct()


@query("stale_difference", "select 'urn:c/' || c_custkey uri from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 250000)")
def stale_difference(spark, sf):
    name = lambda c: F.concat(F.lit("urn:c/"), F.col(c).cast("string")).alias("uri")
    return table(spark, sf, "customer").select(name("c_custkey")).join(table(spark, sf, "orders").where("o_totalprice > 250000").select(name("o_custkey")), "uri", "left_anti")


_DAY_SQL = "d as (select 'urn:ev/' || event_type point_uri, date_trunc('day', ts) ts, max(value) v from events group by 1, 2)"


@query("aligned_rows", f"with {_DAY_SQL} select ts, max(v) filter (point_uri = 'urn:ev/click') click, max(v) filter (point_uri = 'urn:ev/signup') signup from d group by 1 having click is not null and signup is not null")
def aligned_rows(spark, sf):
    """Days on which both points have reported, as wide rows."""
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")
    days = table(spark, sf, "events").groupBy(F.concat(F.lit("urn:ev/"), "event_type").alias("point_uri"), day).agg(F.max("value").alias("value"))
    return complete_rows(days, ["urn:ev/click", "urn:ev/signup"]).select("ts", F.col("`urn:ev/click`").alias("click"), F.col("`urn:ev/signup`").alias("signup"))


@query("last_of_window", f"with {_SERIES_SQL} select point_uri, date_trunc('day', ts) d, arg_max(\"value\", ts) \"value\" from series group by 1, 2")
def last_of_window(spark, sf):
    day = F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("d")
    w = Window.partitionBy("point_uri", "d").orderBy(F.desc("ts"))
    return series(spark, sf).select("point_uri", "ts", "value", day).withColumn("k", F.row_number().over(w)).where("k = 1").select("point_uri", "d", "value")


@query("text_match", None)
def text_match(spark, sf):
    """Market segments and order priorities against a small lexicon; scores have no SQL form."""
    lex = Lexicon([Concept("urn:k/auto", "class", "Automobile", ("car", "automobiles")), Concept("urn:k/build", "class", "Building"), Concept("urn:k/home", "class", "Household"), Concept("urn:k/mach", "class", "Machinery", ("machines",))])
    both = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("text")).unionByName(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("text")))
    return match_all(both, lex, "text", "class")
