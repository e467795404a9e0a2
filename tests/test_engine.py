import itertools
import random
from datetime import datetime, timedelta, timezone

import pytest

from rillgraph import Engine
from rillgraph.operators.hops import reachable
from rillgraph.operators.sensors import ordered
from rillgraph.sources import rdf
from tests.graph import EX, LINKS, NS, OWNS, V, cls, turtle

UTC = timezone.utc


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.load_graph(turtle())
    e.store.triples = e.store.triples.cache()
    return e


def walks(hops, preds=None):
    """Pairs of machines joined by 1..hops steps, by plain enumeration."""
    step = {(a, b) for a, p, b in LINKS if preds is None or p in preds}
    found, now = set(step), set(step)
    for _ in range(hops - 1):
        now = {(a, d) for a, b in now for c, d in step if b == c}
        found |= now
    return found


@pytest.mark.parametrize("a,b,preds,hops,multi", [("A", "C", ["x"], 1, False), ("A", "C", ["x"], 2, True), ("B", "A", ["z", "w"], 1, False), ("A", "B", None, 2, False), ("A", "C", None, 3, False), ("A", "C", ["x", "y"], 3, True)])
def test_related_matches_walks(engine, a, b, preds, hops, multi):
    q = engine.find_entity(NS + a, alias="a").find_related(NS + b, predicates=[NS + p for p in preds] if preds else None, hops=hops, multi_hop_predicates=multi, alias="b")
    want = {(f"eq_{x}", f"eq_{y}") for x, y in walks(hops, preds) if cls(x) == a and cls(y) == b}
    assert {tuple(r) for r in q.metadata().collect()} == want
    assert {tuple(r) for r in q.execute().collect()} == {(EX + x, EX + y) for x, y in want}
    assert {tuple(r) for r in engine.sparql_query(q.to_sparql()).collect()} == {(EX + x, EX + y) for x, y in want}


def test_entities_products_and_relate(engine):
    n = {c: sum(cls(i) == c for i in range(1, 14)) for c in "ABCDE"}
    a = engine.find_entity(NS + "A", alias="a")
    assert a.execute().count() == n["A"]
    assert a.find_entity(NS + "C", alias="c").metadata().count() == n["A"] * n["C"]
    q = a.relate_to(engine.find_entity(NS + "B", alias="b").find_data(), hops=2)
    pairs = [(x, y) for x, y in walks(2) if cls(x) == "A" and cls(y) == "B"]
    assert q.execute().count() == sum(len(OWNS.get(y, [])) for _, y in pairs)
    with pytest.raises(ValueError):
        a.find_related(NS + "B", _from="nobody")


def test_data_nodes_and_filters(engine):
    assert engine.find_all_data().execute().count() == 10
    q = engine.find_entity(NS + "B", alias="b").find_data(alias="d")
    assert q.execute().count() == sum(len(ps) for e, ps in OWNS.items() if cls(e) == "B")
    assert engine.find_all_data().filter_by_unit(NS + "Unit1").execute().count() == sum(i % 3 == 1 for i in range(1, 11))
    both = engine.find_all_data().filter_by_medium(NS + "Medium1").filter_by_substance(NS + "Substance2")
    assert both.execute().count() == sum(i % 4 == 1 and i % 3 == 2 for i in range(1, 11))
    assert engine.find_all_data().filter_data_nodes(V.external_reference, EX + "ref_3").execute().count() == 1
    with pytest.raises(ValueError):
        engine.find_entity(NS + "B").filter_by_unit("x")


def test_hops_against_brute_force(spark):
    rng = random.Random(5)
    for _ in range(4):
        n, e = 6, [(rng.randrange(6), rng.choice("pq"), rng.randrange(6)) for _ in range(9)]
        triples = rdf.to_frame(spark, [(f"n{a}", p, rdf.Term(f"n{b}")) for a, p, b in e])
        seeds = spark.createDataFrame([(f"n{i}",) for i in range(3)], "src string")
        step = {(a, b) for a, _, b in e}
        found, now = set(step), set(step)
        for _ in range(3):
            now = {(a, d) for a, b in now for c, d in step if b == c}
            found |= now
        got = {tuple(r) for r in reachable(triples, seeds, 4).collect()}
        assert got == {(f"n{a}", f"n{b}") for a, b in found if a < 3}


def test_series_shapes_and_upserts(spark, tmp_path):
    for path in (None, str(tmp_path / "series")):
        from rillgraph.operators.series import SeriesStore, info

        s = SeriesStore(spark, path, 4)
        t0 = datetime(2023, 1, 1, tzinfo=UTC)
        rows = [(t0 + timedelta(hours=h), h) for h in range(10)]
        assert s.upsert("urn:a", rows) == 10
        assert s.upsert("urn:a", [(t0, "first"), (t0, "last")]) == 2
        s.upsert("urn:b", [(t0, "ON")])
        assert s.scan("urn:a", limit=1).first().value == "last"
        assert [r.value for r in s.scan("urn:a", start="2023-01-01T08:00:00Z", order="desc").collect()] == ["9", "8"]
        assert info(s.frame(), "urn:a").first().row_count == 10 and info(s.frame(), "urn:x").first().row_count == 0
        s.replace("urn:a", [(t0, "only")])
        assert s.frame().count() == 2
        s.replace("urn:a", [])
        assert [r.point_uri for r in s.frame().collect()] == ["urn:b"]
        assert s.resolve(s.ensure_handle("urn:b")) == "urn:b" and s.resolve("zzz") == "zzz"


def test_ingest_and_dataframe(spark, tmp_path):
    hours = 48
    with open(tmp_path / "data.csv", "w") as f:
        f.write("Timestamp," + ",".join(f"point_{i}" for i in range(1, 11)) + "\n")
        for h in range(hours):
            f.write(f"{datetime(2023, 1, 1) + timedelta(hours=h)}," + ",".join(str(h * i) for i in range(1, 9)) + ",ON,OFF\n")
    from rillgraph.engine import Config

    e = Engine(spark, Config(root=str(tmp_path)))
    out = e.load_graph(turtle(), ingest=True)["ingest"]
    assert out == {"ok": 10, "skipped": 0, "failed": 0, "total": 10}
    assert e.ingest_references()["ok"] == 10 and e.ingest_status() == {"total": 10, "done": 10, "scheduled": 0, "error": 0}
    e.series._frame = spark.createDataFrame(e.series._frame.toPandas(), "point_uri string, ts timestamp, value string")
    q = e.find_all_data()
    assert q.dataframe().count() == 10 * hours and len(q.dataframe().columns) == 3
    wide = q.dataframe(shape="wide", end="2023-01-01T11:00:00")
    assert wide.count() == 12 and len(wide.columns) == 11
    last = q.latest_data()
    assert last.count() == 1 and last.first()["point_2"] == str(47 * 2)
    assert dict(q.dataframe(cast_value="float").dtypes)["value"] == "string"  # ON and OFF
    b = e.find_entity(NS + "B", alias="b").find_data()
    assert dict(b.dataframe(cast_value="int").dtypes)["value"] == "bigint"
    assert q.dataframe(limit=2).count() == 20

    def mean(df, params):
        from pyspark.sql import functions as F

        return df.select("time", ((F.col("point_1").cast("double") + F.col("point_2").cast("double")) / 2).alias("value"))

    s = e.sensors.register(mean, ids=[EX + "point_1", EX + "point_2"])[0]
    assert [r.status for r in e.sensors.run_scheduled()] == ["ok"] and e.sensors.run_scheduled() == []
    assert e.timeseries(s.uri).count() == hours
    assert [r.uri for r in e.sensors.run_scheduled([EX + "point_1"])] == [s.uri]
    assert e.sql_query("select count(*) n from soft_sensor_runs").first().n == 2


def test_sensor_order():
    from rillgraph.operators.sensors import Sensor

    a, b, c = Sensor("a", len, ("x",)), Sensor("b", len, ("a",)), Sensor("c", len, ("b", "a"))
    assert [s.uri for s in ordered([c, b, a])] == ["a", "b", "c"]
    with pytest.raises(RuntimeError):
        ordered([Sensor("a", len, ("b",)), Sensor("b", len, ("a",))])


def test_rdf_round_trip_and_formats(spark, tmp_path):
    text = '@prefix e: <urn:e/> .\ne:a e:p "x\\n\\"y\\"", 5, 1.5, true, "hi"@en, [ e:q e:b ], ( e:c ) ; a e:T .'
    triples = rdf.parse(text)
    df = rdf.to_frame(spark, triples)
    rdf.ntriples(df).write.mode("overwrite").text(str(tmp_path / "nt"))
    again = rdf.scan_ntriples(spark, str(tmp_path / "nt"))
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in df.collect()}
    xml = '<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:e="urn:e/"><e:T rdf:about="urn:e/a"><e:p rdf:resource="urn:e/b"/><e:q>1</e:q></e:T></rdf:RDF>'
    assert len(rdf.parse(xml, "xml")) == 3
    trix = '<TriX xmlns="http://www.w3.org/2004/03/trix/trix-1/"><graph><triple><uri>urn:a</uri><uri>urn:p</uri><plainLiteral>v</plainLiteral></triple></graph></TriX>'
    assert rdf.parse(trix, "trix")[0][2].value == "v"


def test_store_edits(spark, tmp_path):
    e = Engine(spark)
    e.load_graph("<urn:a> <urn:p> <urn:b> .\n<urn:a> <http://www.w3.org/2002/07/owl#imports> <urn:o1> .")
    e.store.register_ontology("urn:o1", "<urn:c> <urn:p> <urn:d> .\n<urn:o1> <http://www.w3.org/2002/07/owl#imports> <urn:o2> .")
    e.store.register_ontology("urn:o2", "<urn:e> <urn:p> <urn:f> .\n")
    assert e.store.counts() == {"main": 2, "union": 5}
    e.sparql_update("PREFIX x: <urn:> INSERT DATA { x:b x:p x:z } ; DELETE DATA { x:a x:p x:b }")
    assert {tuple(r) for r in e.sparql_query("SELECT ?s ?o WHERE { ?s <urn:p> ?o }").collect()} == {("urn:b", "urn:z")}
    e.store.upsert_node("pump", ["urn:T"], "urn:unit/M")
    e.store.record_last_reported(e.store.qualify("pump"), datetime(2024, 1, 1))
    p = e.store.point("pump")
    assert p["name"] == "pump" and p["unit"] == "urn:unit/M" and p["last_reported"].startswith("2024-01-01")
    assert e.store.points_by_type("urn:T").count() == 1
    e.store.delete(e.store.qualify("pump"))
    assert e.store.point("pump") is None


def test_sparql(engine):
    q = engine.sparql_query
    pre = f"PREFIX r: <{NS}> PREFIX ex: <{EX}> "
    assert q(pre + "SELECT ?e WHERE { ?e a r:A }").count() == sum(cls(i) == "A" for i in range(1, 14))
    opt = q(pre + "SELECT ?e ?p WHERE { ?e a r:A OPTIONAL { ?e r:hasProperty ?p } }").collect()
    assert sum(r.p is None for r in opt) == sum(cls(i) == "A" and i not in OWNS for i in range(1, 14))
    by = q(pre + "SELECT ?e (COUNT(?p) AS ?n) WHERE { ?e r:hasProperty ?p } GROUP BY ?e HAVING (COUNT(?p) > 1) ORDER BY DESC(?n) ?e").collect()
    assert {r.e: int(r.n) for r in by} == {f"{EX}eq_{e}": len(p) for e, p in OWNS.items() if len(p) > 1}
    assert q(pre + "SELECT ?r WHERE { ?r r:hasValueColumn ?c FILTER(?c > 8 || ?c IN (1, 2)) }").count() == 4
    assert q(pre + "SELECT ?e WHERE { ?e a ?c FILTER(?c IN (r:A, r:B)) MINUS { ?e r:hasProperty ?p } }").count() == sum(cls(i) in "AB" and i not in OWNS for i in range(1, 14))
    assert q(pre + "SELECT ?e WHERE { ?e a r:A FILTER NOT EXISTS { ?e r:hasProperty ?p } }").count() == sum(cls(i) == "A" and i not in OWNS for i in range(1, 14))
    assert q(pre + "SELECT DISTINCT ?b WHERE { ex:eq_1 r:x+ ?b }").count() == len({b for b in _closure("x", 1)})
    assert q(pre + "SELECT ?e WHERE { { ?e a r:A } UNION { ?e a r:B } } ORDER BY ?e LIMIT 2 OFFSET 1").count() == 2
    assert q(pre + "SELECT ?e ?x WHERE { VALUES ?e { ex:eq_1 ex:eq_2 } ?e (r:x|r:z) ?x }").count() == 3
    for bad in ("ASK { ?s ?p ?o }", "SELECT ?s WHERE { GRAPH ?g { ?s ?p ?o } }"):
        with pytest.raises(ValueError):
            q(bad)


def _closure(pred, start):
    found, now = set(), {start}
    while now:
        now = {b for a, p, b in LINKS if p == pred and a in now} - found
        found |= now
    return found


def test_stream(spark, tmp_path):
    import json

    e = Engine(spark)
    ns = f"@prefix r: <{NS}> ."
    e.load_graph(ns + ' <urn:p1> r:hasExternalReference <urn:r1> . <urn:r1> a r:MQTTReference ; r:Topic "t" . <urn:p2> r:hasExternalReference <urn:r2> . <urn:r2> a r:MQTTReference ; r:Topic "t" ; r:value_key "Other" . <urn:p3> r:hasExternalReference <urn:r3> . <urn:r3> a r:MQTTReference ; r:Topic " " .')
    src = tmp_path / "in"
    src.mkdir()
    msgs = ["{'Timestamp': '2003-01-01 00:00:00', 'Value': 42, 'Other': True}", '{"Timestamp": 1041379200, "Value": 43}', "junk"]
    (src / "a.json").write_text("\n".join(json.dumps({"topic": "t", "payload": m}) for m in msgs))
    for _ in range(2):  # a second run has nothing left to do
        run = e.subscribe(spark.readStream.schema("topic string, payload string").json(str(src)), str(tmp_path / "cp"), dead_letters=str(tmp_path / "dead"), trigger={"availableNow": True})
        run.awaitTermination()
    got = {(r.point_uri, str(r.ts), r.value) for r in e.series.frame().collect()}
    assert {g[0] for g in got} == {"urn:p1", "urn:p2"} and len(got) == 2
    assert spark.read.json(str(tmp_path / "dead")).count() == 1


def test_text_and_units(spark):
    from rillgraph.functions import text
    from rillgraph.functions.units import Unit, Units
    from decimal import Decimal

    assert text.normalize("  AirTemp_Sensór-2") == "air temp sensor 2" and text.tokens("Pumps gas") == ["pump", "gas"]
    assert text.edit_distance("abcd", "acbd", 3) == 1 and text.edit_distance("a", "bbbbb", 2) == 3
    for a, b in itertools.product(["", "ab", "ba", "abc", "acb"], repeat=2):
        assert text.edit_distance(a, b, 9) == text.edit_distance(b, a, 9)
    lex = text.Lexicon([text.Concept("urn:Pump", "class", "Pump", ("centrifugal pump",)), text.Concept("urn:Tank", "class", "Tank"), text.Concept("urn:Flow", "class", "Flow Rate")], {"fr": ["flow rate"]})
    assert lex.resolve("pumps", "class") == "urn:Pump" and lex.resolve("FR") == "urn:Flow" and lex.resolve("urn:x") == "urn:x"
    with pytest.raises(ValueError):
        lex.resolve("zebra")
    u = Units([Unit("http://u/M", "L", names=("meter", "m")), Unit("http://u/KiloM", "L", Decimal(1000), names=("km",)), Unit("http://u/SEC", "T", names=("s",)), Unit("http://u/DEG_F", "K", Decimal("0.5555555555555556"), Decimal("459.67")), Unit("http://u/DEG_C", "K", Decimal(1), Decimal("273.15"))])
    assert u.convert(3, "km", "m") == 3000.0 and abs(u.convert(212, "fahrenheit", "celsius") - 100) < 1e-9
    assert u.infer("m/s").multiplier == 1 and abs(u.convert(u.convert(7, "DEG_F", "DEG_C"), "DEG_C", "DEG_F") - 7) < 1e-9
    with pytest.raises(ValueError):
        u.convert(1, "m", "s")


def test_sparql_unbound_variables(spark):
    e = Engine(spark)
    e.load_graph("@prefix x: <urn:> . x:a x:p 1 ; x:q 2 . x:b x:p 3 ; x:q 2 . x:c x:p 5 . x:a x:r x:b . x:c x:r x:a .")
    q = lambda t: sorted((tuple(None if v is None else v.removeprefix("urn:") for v in r) for r in e.sparql_query("PREFIX x: <urn:> " + t).collect()), key=str)
    assert q("SELECT ?s ?y WHERE { ?s x:p ?x OPTIONAL { ?s x:q ?y FILTER(?y > ?x) } }") == [("a", "2"), ("b", None), ("c", None)]
    assert q("SELECT ?s ?x WHERE { ?s x:p ?x VALUES (?s ?x) { (UNDEF 1) (x:b UNDEF) } }") == [("a", "1"), ("b", "3")]
    assert q("SELECT ?s ?y ?o WHERE { { ?s x:p ?x } UNION { ?s x:q ?y } ?s x:r ?o }") == [("a", "2", "b"), ("a", None, "b"), ("c", None, "a")]
    assert q("SELECT ?s ?y WHERE { { ?s x:p ?x } UNION { ?z x:q ?y } ?z x:q ?y }")[0][0] == "a"
    assert len(q("SELECT ?s ?z ?y WHERE { { ?s x:p ?x } UNION { ?z x:q ?y } ?z x:q ?y }")) == 8
    assert q("SELECT (SUM(?x) AS ?n) WHERE { ?s x:p ?x }") == [("9",)]
    assert q("SELECT ?s WHERE { ?s x:p ?x OPTIONAL { ?s x:q ?y } MINUS { ?t x:q ?y } }") == [("c",)]


def test_rdf_names(spark):
    base = "http://h/a/b"
    for ref, want in {"../c": "http://h/c", "c": "http://h/a/c", "#f": "http://h/a/b#f", "?q": "http://h/a/b?q", "//k/x": "http://k/x", "/y/./z/../w": "http://h/y/w", "": "http://h/a/b", "urn:x:y": "urn:x:y", ".": "http://h/a/", "../../../g": "http://h/g"}.items():
        assert rdf.resolved(base, ref) == want, ref
    assert rdf.parse("@base <http://h/a/b> . <../c> <p> <#d> .")[0] == ("http://h/c", "http://h/a/p", rdf.Term("http://h/a/b#d"))
    found = rdf.parse("_:b1 <urn:p> [ <urn:q> 1 ] .")
    assert {len({s, o.value}) for s, _, o in found} == {2} and '_:b1' in {s for s, _, _ in found} and len({s for s, _, _ in found}) == 2
    e = Engine(spark)
    e.load_graph("[] <urn:p> 1 . _:x <urn:p> 3 .")
    e.load_graph("[] <urn:p> 2 . _:x <urn:p> 4 .", replace=False)
    assert e.sparql_query("SELECT DISTINCT ?s WHERE { ?s <urn:p> ?o }").count() == 4


def test_times(spark):
    from pyspark.sql import functions as F

    from rillgraph.functions.expressions import parsed_time

    forms = {"20240101": "2024-01-01 00:00:00", "20240101T010203": "2024-01-01 01:02:03", "2024-01-01T00:00:00Z": "2024-01-01 00:00:00", "2024-01-01 05:00:00+05:00": "2024-01-01 00:00:00", "1704067200": "2024-01-01 00:00:00", "1704067200000": "2024-01-01 00:00:00", "05/06/2024 00:00:00": None, "x": None, "": None}
    got = spark.createDataFrame([(k,) for k in forms], "t string").select("t", F.date_format(parsed_time(F.col("t")), "yyyy-MM-dd HH:mm:ss").alias("v")).collect()
    assert {r.t: r.v for r in got} == forms


def test_hop_plans_stay_small(spark, tmp_path):
    rdf.to_frame(spark, [("n1", "p", rdf.Term("n2"))]).write.parquet(str(tmp_path / "t"))
    triples = spark.read.parquet(str(tmp_path / "t"))
    seeds = spark.createDataFrame([("n1",)], "src string")
    for hops, most in ((1, 1), (3, 6), (5, 15)):
        plan = reachable(triples, seeds, hops)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= most
