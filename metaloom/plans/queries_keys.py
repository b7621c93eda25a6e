"""Registered queries over keys and scalar functions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import redact as R
from .fleet import graph
from .oracles import PRIORITY, over_fleet

Q: dict = {}
SQL: dict = {}

# A nation's customers as odd names: every third with reserved characters, every second without a sub-object.
NAMED = "SELECT c_custkey AS id, r_name, n_name, CASE WHEN c_custkey % 3 = 0 THEN c_name || ':a%b' ELSE c_name END AS name, CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'col%3A' || c_custkey END AS sub FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _named(spark, sf):
    n = F.broadcast(_t(spark, sf, "nation").join(F.broadcast(_t(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name"))
    c = _t(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit(":a%b"))).otherwise(F.col("c_name"))
    sub = F.when(F.col("c_custkey") % 2 != 0, F.concat(F.lit("col%3A"), F.col("c_custkey").cast("string")))
    return c.select(F.col("c_custkey").alias("id"), "r_name", "n_name", name.alias("name"), sub.alias("sub"))


def _key():
    return K.object_key("src", F.col("r_name"), "w", F.col("n_name"), "table", F.col("name"), F.col("sub"))


def k1_object_key(spark, sf):
    return _named(spark, sf).select("id", _key().alias("key"))


_PARTS = "['src', r_name, 'w', n_name, 'table', name, sub]"
_ENCODED = f"""CASE WHEN regexp_matches(array_to_string({_PARTS}, ''), '[:%]') THEN 'v2:' || array_to_string([replace(replace(x, '%', '%25'), ':', '%3A') for x in {_PARTS} if x IS NOT NULL], ':') ELSE array_to_string([x for x in {_PARTS} if x IS NOT NULL], ':') END"""
SQL["k1_object_key"] = f"SELECT id, {_ENCODED} AS key FROM ({NAMED})"


def k2_parse_key(spark, sf):
    """Every fifth key is broken, in one of four ways."""
    broken = F.when(F.col("id") % 20 == 0, F.concat(F.lit("x"), F.regexp_replace("key", ":table:", ":"))).when(F.col("id") % 20 == 5, F.replace("key", F.lit(":table:"), F.lit(":tablet:"))).when(F.col("id") % 20 == 10, F.concat(F.lit("v2:a%2:"), F.regexp_replace("key", "^v2:", ""))).when(F.col("id") % 20 == 15, F.concat(F.col("key"), F.lit(":"))).otherwise(F.col("key"))
    p = k1_object_key(spark, sf).select("id", K.parse_key(broken).alias("p"))
    return p.select("id", "p.connection_alias", F.col("p.schema").alias("schema_name"), "p.object_kind", "p.object_name", "p.sub_object")


_OK = "id % 5 <> 0"
SQL["k2_parse_key"] = f"SELECT id, CASE WHEN {_OK} THEN r_name END AS connection_alias, CASE WHEN {_OK} THEN n_name END AS schema_name, CASE WHEN {_OK} THEN 'table' END AS object_kind, CASE WHEN {_OK} THEN name END AS object_name, CASE WHEN {_OK} THEN sub END AS sub_object FROM ({NAMED})"


def k3_comparable_key(spark, sf):
    return graph(spark, sf).nodes.select("node_key", K.comparable_key(F.col("node_key")).alias("ckey"))


SQL["k3_comparable_key"] = over_fleet("SELECT node_key, regexp_replace(node_key, '^tpch:[^:]*:', 'tpch:_:') AS ckey FROM nodes")


def k4_comparable_edge_key(spark, sf):
    return graph(spark, sf).edges.select("edge_key", K.comparable_edge_key(F.col("edge_type"), F.col("edge_from"), F.col("edge_to")).alias("ckey"))


SQL["k4_comparable_edge_key"] = over_fleet("SELECT edge_key, edge_type || ':' || regexp_replace(edge_from, '^tpch:[^:]*:', 'tpch:_:') || '->' || regexp_replace(edge_to, '^tpch:[^:]*:', 'tpch:_:') AS ckey FROM edges")


def k5_comparable_payload(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    json = F.format_string('{"z": %d, "key": {"connection_alias": "a \\"%s\\"", "n": [1, 2]}, "m": {"connection_alias": {"x": ["}", {"y": [1]}], "w": "%s"}, "k": true}, "connection_alias": null}', "o_orderkey", "o_orderpriority", "o_orderpriority")
    return o.select("o_orderkey", K.comparable_payload(json).alias("payload"), K.comparable_payload(F.lit("not json")).alias("other"))


SQL["k5_comparable_payload"] = """SELECT o_orderkey, '{"key":{"n":[1,2]},"m":{"k":true},"z":' || o_orderkey || '}' AS payload, 'not json' AS other FROM orders"""


def k6_kind_label(spark, sf):
    kind = K.parse_key(F.col("node_key"))["object_kind"]
    return graph(spark, sf).nodes.groupBy("label", K.kind_label(kind).alias("of_kind"), K.label_kind(F.col("label")).alias("kind")).agg(F.count("*").alias("n"))


SQL["k6_kind_label"] = over_fleet("SELECT label, label AS of_kind, lower(regexp_replace(label, '([a-z])([A-Z])', '\\1_\\2', 'g')) AS kind, count(*) AS n FROM nodes GROUP BY ALL")

_KINDS = ["depends_on", "uses_type", "uses_sequence", "partition_of", "inherits_from", "synonym_for", "has_parameter", "returns_type", "owned_by", "materializes", "invokes", "includes_column", "excludes_with", "extension"]


def k7_rel_edge_type(spark, sf):
    kind = F.get(F.array(*[F.lit(k) for k in _KINDS]), (F.col("p_partkey") % 14).cast("int"))
    return _t(spark, sf, "part").select("p_partkey", K.rel_edge_type(kind, F.col("p_brand")).alias("edge_type"))


SQL["k7_rel_edge_type"] = f"SELECT p_partkey, CASE WHEN p_partkey % 14 = 13 THEN 'EXTENSION:' || p_brand ELSE upper({_KINDS}[p_partkey % 14 + 1]) END AS edge_type FROM part"


def k8_edge_priority(spark, sf):
    return graph(spark, sf).edges.groupBy("edge_type", K.edge_priority(F.col("edge_type")).alias("priority")).agg(F.count("*").alias("n"))


SQL["k8_edge_priority"] = over_fleet(f"SELECT edge_type, {PRIORITY} AS priority, count(*) AS n FROM edges GROUP BY ALL")


def k9_contains(spark, sf):
    name = F.concat(F.when(F.col("c_custkey") % 2 == 0, F.lit("CAFÉ ")).otherwise(F.lit("Café ")), F.col("c_name"))
    return _t(spark, sf, "customer").select("c_custkey", K.contains_ci(name, "CAFé CUSTOMER").alias("unicode"), K.contains_ascii_ci(name, "cafÉ customer").alias("ascii"), K.contains_ascii_ci(name, "ER#00000000").alias("digits"))


SQL["k9_contains"] = "SELECT c_custkey, contains(lower('CAFÉ ' || c_name), 'café customer') AS \"unicode\", c_custkey % 2 = 0 AS ascii, contains(lower(c_name), 'er#00000000') AS digits FROM customer"


def k10_payload_array(spark, sf):
    p = F.col("payload_json")
    return graph(spark, sf).nodes.where("label in ('Index', 'ForeignKey', 'Table')").select("node_key", K.payload_array_len_ge(p, "columns", 2).alias("two"), K.payload_array_len_ge(p, "referenced_columns", 1).alias("refers"), K.payload_array_len_ge(p, "name", 0).alias("of_text"), K.payload_array_len_ge(F.lit("{bad"), "columns", 0).alias("of_bad"))


SQL["k10_payload_array"] = over_fleet("SELECT key AS node_key, n >= 2 AS two, false AS refers, false AS of_text, false AS of_bad FROM ix UNION ALL SELECT key, false, true, false, false FROM con WHERE kind = 'foreign_key' UNION ALL SELECT tkey, false, false, false, false FROM cust")


def k11_alias_of(spark, sf):
    key = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("pg:"), F.col("s_name"), F.lit(":x"))).otherwise(F.col("s_name"))
    return _t(spark, sf, "supplier").select("s_suppkey", K.alias_of(key).alias("alias"))


SQL["k11_alias_of"] = "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name || ':x' ELSE s_name END AS alias FROM supplier"


def _secrets(spark, sf, text):
    return _t(spark, sf, "customer").select("c_custkey", F.format_string(text, *["c_custkey"] * text.count("%d")).alias("s"))


def k12_redact_url(spark, sf):
    return _secrets(spark, sf, "a postgres://u%d:pa:s@s%d@db.example:5432/x?y=1 and mysql://h%d/z@q:r").select("c_custkey", R.redact_url(F.col("s")).alias("clean"))


SQL["k12_redact_url"] = "SELECT c_custkey, 'a postgres://u' || c_custkey || ':pa:***@db.example:5432/x?y=1 and mysql://h' || c_custkey || '/z@q:r' AS clean FROM customer"


def k13_redact_ado(spark, sf):
    return _secrets(spark, sf, "Server=h;P W D={a;b}}c%d};User=u%d; Password = 'x;''%d';Pwd=plain%d;Last=1").select("c_custkey", R.redact_ado(F.col("s")).alias("clean"))


SQL["k13_redact_ado"] = "SELECT c_custkey, 'Server=h;P W D=***;User=u' || c_custkey || '; Password = ***;Pwd=***;Last=1' AS clean FROM customer"


def k14_redact_oracle(spark, sf):
    return _secrets(spark, sf, "login scott/tiger%d@host:1521/ORCL failed, a:b/c%d@d kept").select("c_custkey", R.redact_oracle(F.col("s")).alias("clean"))


SQL["k14_redact_oracle"] = "SELECT c_custkey, 'login scott/***@host:1521/ORCL failed, a:b/c' || c_custkey || '@d kept' AS clean FROM customer"


def k15_redact_error(spark, sf):
    url = F.format_string("postgres://app:secret%d@db/app", "c_custkey")
    pad = F.when(F.col("c_custkey") % 2 == 0, F.repeat(F.lit("é"), F.lit(5000))).otherwise(F.lit(""))
    got = R.redact_error(F.concat(F.lit("no route to "), url, F.lit("; "), pad), url)
    # The rows are few bytes each, so that one task would read them all; the texts made of them are long.
    rows = _t(spark, sf, "customer").select("c_custkey").repartition(4 * spark.sparkContext.defaultParallelism)
    return rows.select("c_custkey", F.left(got, F.lit(60)).alias("head"), F.octet_length(got).alias("bytes"))


SQL["k15_redact_error"] = "SELECT c_custkey, left('no route to postgres://app:***@db/app; ' || CASE WHEN c_custkey % 2 = 0 THEN repeat('é', 5000) ELSE '' END, 60) AS head, CASE WHEN c_custkey % 2 = 0 THEN 39 + 2 * ((8192 - 39) // 2) ELSE 39 END::INTEGER AS bytes FROM customer"


def k16_capability_warnings(spark, sf):
    o = lambda k: F.get(F.array(F.lit("supported"), F.lit("partial"), F.lit("unsupported"), F.lit("unknown")), ((F.col("o_orderkey") + k) % 4).cast("int"))
    caps = F.struct(F.lit("tpch").alias("source_kind"), o(0).alias("views"), o(1).alias("triggers"), o(2).alias("routines"), F.lit("supported").alias("dependencies"), F.array("o_orderpriority").alias("limitations"))
    return _t(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", K.capability_warnings(caps)).alias("warnings"))


_SAY = "CASE (o_orderkey + {k}) % 4 WHEN 0 THEN NULL WHEN 1 THEN '{t} is partially tracked by the tpch adapter.' WHEN 2 THEN '{t} is not tracked by the tpch adapter.' ELSE '{t} support is unknown for the tpch adapter.' END"
SQL["k16_capability_warnings"] = "SELECT o_orderkey, concat_ws('|', " + ", ".join(_SAY.format(k=k, t=t) for k, t in enumerate(("view dependency metadata", "trigger dependency metadata", "routine dependency metadata"))) + ", o_orderpriority) AS warnings FROM orders"


def k17_fold_name(spark, sf):
    name = F.concat(F.col("c_name"), F.lit("É"))
    return _t(spark, sf, "customer").select("c_custkey", K.fold_name(name, (F.col("c_custkey") % 3).cast("int")).alias("folded"))


SQL["k17_fold_name"] = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(c_name) END || 'É' AS folded FROM customer"


def k18_sanitize_alias(spark, sf):
    return _t(spark, sf, "part").select("p_partkey", K.sanitize_alias(F.concat("p_name", F.lit("-é."), "p_brand")).alias("alias"))


SQL["k18_sanitize_alias"] = "SELECT p_partkey, regexp_replace(upper(replace(p_name || '-é.' || p_brand, 'é', '_')), '[^A-Z0-9]', '_', 'g') AS alias FROM part"


def k19_clamp(spark, sf):
    c = K.clamp(F.col("l_linenumber") * 2, 8)
    return _t(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.first(c).alias("c")).select("n", "c.*")


SQL["k19_clamp"] = "SELECT l_linenumber AS n, l_linenumber * 2 AS requested, least(l_linenumber * 2, 8) AS applied, l_linenumber * 2 > 8 AS clamped FROM lineitem GROUP BY ALL"

Q.update({n: f for n, f in list(globals().items()) if n in SQL and callable(f)})
