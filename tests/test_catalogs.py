"""Catalog sources, projections and single functions on small inputs."""

import sqlite3
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metaloom.functions import keys as K
from metaloom.functions import redact as R
from metaloom.operators import certify as C
from metaloom.operators import mapping as M
from metaloom.operators import project as P
from metaloom.operators import store as S
from metaloom.operators import traverse as T
from metaloom.operators import validate as V
from metaloom.plans import fleet
from metaloom.plans.model import Canonical, Graph
from metaloom.plans.shared import written
from metaloom.sources import sqlite_fleet
from metaloom.sources.synth import change_types, synth_catalog


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_synthetic_closed_forms(spark):
    for t, c in ((3, 2), (20, 8)):
        canonical = synth_catalog(spark, t, c)
        g = P.project(canonical)
        assert g.nodes.count() == 1 + t * (c + 4) and g.edges.count() == t * (c + 8) - 2
        assert P.check_projection(g, C.emitted_objects(canonical), C.emitted_relations(canonical)).first()["accepted"]
    held = Canonical({n: written(df, n) for n, df in synth_catalog(spark, 3, 2).t.items()})
    assert V.validate(held).isEmpty()
    assert change_types(synth_catalog(spark, 20, 8), 4).columns.where("data_type = 'bigint'").count() > 0


def test_golden_counts(spark, sf):
    g = fleet.graph(spark, sf)
    assert (g.nodes.count(), g.edges.count()) == (2680, 4980)


def test_mapping_gives_the_catalog_back(spark, sf):
    c = fleet.catalog(spark, sf)
    m = M.map_catalog(M.as_information_schema(c))
    for name in ("schemas", "tables", "columns", "constraints", "indexes", "views", "triggers", "routines"):
        assert c.t[name].exceptAll(m.t[name]).isEmpty() and m.t[name].exceptAll(c.t[name]).isEmpty(), name


def test_keys(spark):
    key = K.object_key("a", "b%", "c", "d", "table", F.lit("x:y"), F.lit("é"))
    assert one(spark, key) == "v2:a:b%25:c:d:table:x%3Ay:é"
    assert one(spark, K.parse_key(key)["object_name"]) == "x:y"
    for bad in ("a:b:c:d:table", "a:b:c:d:nothing:x", "a:b:c:d:table:", "v2:a:b:c:d:table:x%2", "a:b:c:d:table:x:y:z"):
        assert one(spark, K.parse_key(F.lit(bad))) is None, bad
    assert one(spark, K.parse_key(F.lit("v2:a:b:c:d:table:%3a%253A"))["object_name"]) == ":%3A"
    assert one(spark, K.comparable_key(F.lit("not a key"))) == "not a key"


def test_redaction(spark):
    cases = {
        "mysql://reader:a:b@c@10.0.0.7:3306/shop?x=1": "mysql://reader:a:***@10.0.0.7:3306/shop?x=1",
        "https://nobody@host/path:with@marks": "https://nobody@host/path:with@marks",
        "ftp://host/no/user": "ftp://host/no/user",
        "Data Source=lake; Pass word = two words ;Timeout=5": "Data Source=lake; Pass word = ***;Timeout=5",
        "pwd='it''s; quoted';App=x": "pwd=***;App=x",
        'A=1;PassWord="semi;colon"': "A=1;PassWord=***",
        "pwd={closed}};still};Z=9": "pwd=***;Z=9",
        "keyword=kept;password=": "keyword=kept;password=***",
        "login as hr/pa:ss/w0rd@//dbhost:1521/svc now": "login as hr/***@//dbhost:1521/svc now",
        "no secret / here": "no secret / here",
    }
    for text, want in cases.items():
        assert one(spark, R.redact(F.lit(text))) == want
    conn = "pwd=k9;Server=north"
    assert one(spark, R.redact_error(F.lit(f"could not open [{conn}]"), F.lit(conn))) == "could not open [pwd=***;Server=north]"
    assert one(spark, F.octet_length(R.redact_error(F.lit("é" * 5000), F.lit("")))) == 8192


def test_starts_that_share_names(spark):
    """A table and a column of one name, a request made twice, and keys with escapes."""
    key = lambda kind, name, sub=None: K.object_key("s", "a", "d", "x", kind, F.lit(name), None if sub is None else F.lit(sub))
    rows = [("Table", "orders", key("table", "orders")), ("Column", "orders", key("column", "t", "orders")), ("Table", "od:d", key("table", "od:d")), ("Column", "y", key("column", "od:d", "y"))]
    nodes = reduce(DataFrame.unionByName, [spark.range(1).select(F.lit("s:a").alias("snapshot_key"), k.alias("node_key"), F.lit(label).alias("label"), F.lit(name).alias("display_name")) for label, name, k in rows])
    asks = [("s:a", None, "orders", None), ("s:a", None, "orders", None), ("s:a", None, None, "orders"), ("s:a", None, "od:d", "y"), ("s:a", None, "od:d", "z"), ("s:a", None, None, None)]
    got = T.resolve_starts(Graph(None, nodes, None), spark.createDataFrame(asks, "snapshot_key string, object_key string, table_name string, column_name string")).collect()
    assert sorted((r.table_name or "", r.column_name or "", r.status, r.start or "") for r in got) == [
        ("", "", "missing", ""), ("", "orders", "found", "s:a:d:x:column:t:orders"), ("od:d", "y", "found", "v2:s:a:d:x:column:od%3Ad:y"), ("od:d", "z", "not_found", ""),
        ("orders", "", "found", "s:a:d:x:table:orders"), ("orders", "", "found", "s:a:d:x:table:orders"),
    ]


def test_parameters_of_overloads(spark):
    db = spark.createDataFrame([("s:a", "s", "a", "d")], "snapshot_key string, source_kind string, connection_alias string, name string")
    routines = spark.createDataFrame([("s:a", "x", "f", s, "FUNCTION", None) for s in ("f", "f_1")], "snapshot_key string, ROUTINE_SCHEMA string, ROUTINE_NAME string, SPECIFIC_NAME string, ROUTINE_TYPE string, ROUTINE_DEFINITION string")
    parameters = spark.createDataFrame([("s:a", "x", s, n, p) for s in ("f", "f_1") for n, p in ((0, None), (1, "p"), (2, None))], "snapshot_key string, SPECIFIC_SCHEMA string, SPECIFIC_NAME string, ORDINAL_POSITION int, PARAMETER_NAME string")
    x = {"databases": db, "routines": routines, "parameters": parameters}
    keys = {r.key for r in M.map_routines(x).collect()}
    objects, links = M.map_parameters(x)
    assert objects.count() == 4 and {r.parent_key for r in objects.collect()} == keys == {r.from_key for r in links.collect()}


def test_diff_envelope_counts_cut_impact(spark, sf):
    from metaloom.operators import diff as D

    a, b = fleet.graph(spark, sf), fleet.graph(spark, sf, 2)
    g = Graph(a.snapshots.unionByName(b.snapshots), a.nodes.unionByName(b.nodes), a.edges.unionByName(b.edges))
    pairs = spark.createDataFrame([("ASIA", "tpch:ASIA", "tpch:ASIA_v2"), ("none", "tpch:ASIA", "tpch:ASIA")], "pair string, a string, b string")
    got = {r.pair: r for r in D.diff_envelope(g, pairs, 30).collect()}
    assert not got["none"].truncated and got["none"].impacted_seeds == 0
    assert got["ASIA"].truncated and got["ASIA"].impact_truncated and 0 < got["ASIA"].impacted_seeds <= 30


def test_sqlite_and_ddl_fleets(spark, tmp_path):
    ddl = "create table customers(id integer primary key, email text unique not null);\ncreate table orders(id integer primary key, customer_id integer references customers(id));\ncreate view v as select o.id, c.email from orders o join customers c on c.id = o.customer_id;"
    db = sqlite3.connect(tmp_path / "shop.db")
    db.executescript(ddl)
    db.close()
    (tmp_path / "bad.db").write_bytes(b"not a database at all" * 100)
    rows = sqlite_fleet.scan_sqlite_fleet(sqlite_fleet.local_files(spark, str(tmp_path)))
    kinds = {(r.snapshot_key, r.kind): r["count"] for r in rows.groupBy("snapshot_key", "kind").count().collect()}
    assert kinds["sqlite:shop", "relation"] == 3 and kinds["sqlite:shop", "foreign_key"] == 1 and kinds["sqlite:bad", "error"] == 1
    seen = {(r.owner, F_json(r.row)["relation"]) for r in rows.where("kind = 'access'").collect()}
    assert ("v", "orders") in seen and ("v", "customers") in seen
    for name, text in (("one/1.sql", ddl.split("\n")[0]), ("one/2.sql", "\n".join(ddl.split("\n")[1:])), ("two/1.sql", "insert into x values (1);")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = sqlite_fleet.scan_ddl_fleet(spark, f"{tmp_path}/*/")
    kinds = {(r.snapshot_key, r.kind): r["count"] for r in got.groupBy("snapshot_key", "kind").count().collect()}
    assert kinds["one", "relation"] == 3 and kinds["two", "error"] == 1


def F_json(text):
    import json

    return json.loads(text)


def test_snapshot_sink_keeps_what_is_refused(spark, sf, tmp_path):
    g = fleet.graph(spark, sf)
    S.write_snapshot(g, str(tmp_path), "g1")
    refused = g.snapshots.select("snapshot_key", (F.col("snapshot_key") == "tpch:ASIA").alias("accepted"))
    S.write_snapshot(type(g)(g.snapshots, g.nodes.where("label = 'Table'"), g.edges), str(tmp_path), "g2", refused)
    got = {r.snapshot_key: r.nodes for r in S.counts(S.read_graph(spark, str(tmp_path))).collect()}
    before = {r.snapshot_key: r.nodes for r in S.counts(g).collect()}
    assert got["tpch:ASIA"] < before["tpch:ASIA"] and got["tpch:EUROPE"] == before["tpch:EUROPE"]
