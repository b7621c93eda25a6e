"""Registered queries over what only PostgreSQL's catalog has, made from the fleet's own rows, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import postgres as PG
from .oracles import over_fleet
from .queries_graph import _pg

Q: dict = {}
SQL: dict = {}


def _more(s, d):
    """A materialised view over each table whose number divides by 10, with one column, a unique key and an index; an exclusion constraint on the first column of each that divides by 9; a policy on each that divides by 8; a domain and a composite type for each nation; functions return their nation's domain; a group and a member of it beside each database's owner."""
    x = _pg(s, d)
    long = lambda c: F.lit(c).cast("long")
    k = F.substring("relname", 2, 20).try_cast("long")
    tables = x["pg_class"].where("relkind = 'r'")
    of = lambda kind, c="oid": F.xxhash64(F.lit(kind), c)
    at = ["snapshot_key"]
    base = tables.where(k % 10 == 0)
    mats = base.select(*at, of("m").alias("oid"), F.concat(F.lit("m"), "relname").alias("relname"), "relnamespace", F.lit("m").alias("relkind"), F.lit(False).alias("relispartition"), "relpersistence", "relowner", F.lit("select 1").alias("definition"))
    columns = base.select(*at, of("m").alias("attrelid"), F.lit("a").alias("attname"), F.lit(1).alias("attnum"), long(25).alias("atttypid"), F.lit("text").alias("format_type"), F.lit(False).alias("attnotnull"), F.lit("").alias("attgenerated"), F.lit(False).alias("attisdropped"))
    index = base.select(*at, of("mi").alias("indexrelid"), of("m").alias("indrelid"), F.lit(True).alias("indisunique"), F.lit(False).alias("indisprimary"), F.array(F.lit(1)).alias("indkey"), F.lit(1).alias("indnkeyatts"), F.lit(None).cast("string").alias("indpred"), F.lit(None).cast("string").alias("indexprs"))
    indexes = base.select(*at, of("mi").alias("oid"), F.lit("mix").alias("relname"), "relnamespace", F.lit("i").alias("relkind"), F.lit(False).alias("relispartition"), "relpersistence", "relowner", F.lit(None).cast("string").alias("definition"))
    one = lambda df, name, kind, rel, text: df.select(*at, F.xxhash64(F.lit(name), "oid").alias("oid"), F.lit(name).alias("conname"), rel.alias("conrelid"), F.lit(kind).alias("contype"), F.array(F.lit(1)).alias("conkey"), long(0).alias("confrelid"), F.array().cast("array<int>").alias("confkey"), F.lit(text).alias("conbin"))
    with_columns = x["pg_attribute"].where("attnum = 1").select(*at, F.col("attrelid").alias("oid"))
    constraints = one(base, "mu", "u", of("m"), None).unionByName(one(tables.where(k % 9 == 0).join(with_columns, [*at, "oid"], "left_semi"), "ex", "x", F.col("oid"), "a with ="))
    rules = base.select(*at, of("mr").alias("oid"), of("m").alias("ev_class"))
    depends = base.select(*at, F.lit("pg_rewrite").alias("classid"), of("mr").alias("objid"), F.lit("pg_class").alias("refclassid"), F.col("oid").alias("refobjid"), F.lit(0).alias("refobjsubid"), F.lit("n").alias("deptype"))
    nsp = x["pg_namespace"].select(*at, F.col("oid").alias("nsp"))
    made = lambda name, kind: nsp.select(*at, F.xxhash64(F.lit(name), "nsp").alias("oid"), F.lit(name).alias("typname"), F.col("nsp").alias("typnamespace"), F.lit(kind).alias("typtype"), long(0).alias("typrelid"))
    proc = x["pg_proc"].withColumn("prorettype", F.when(F.col("prokind") == "f", F.xxhash64(F.lit("dom"), "pronamespace")).otherwise(long(25)))
    policies = tables.where(k % 8 == 0).select(*at, F.col("oid").alias("polrelid"), F.lit("pol").alias("polname"), F.lit("true").alias("polqual"), F.lit("r").alias("polcmd"))
    roles = x["databases"].select(*at, F.explode(F.array(*[F.struct(long(n).alias("oid"), F.lit(r).alias("rolname")) for n, r in ((10, "owner"), (11, "group"), (12, "member"))])).alias("r")).select(*at, "r.*")
    members = x["databases"].select(*at, long(11).alias("roleid"), long(12).alias("member"))
    put = lambda name, *more: reduce(DataFrame.unionByName, more, x[name])
    return x | {"pg_class": put("pg_class", mats, indexes), "pg_attribute": put("pg_attribute", columns), "pg_index": put("pg_index", index), "pg_constraint": put("pg_constraint", constraints), "pg_rewrite": put("pg_rewrite", rules), "pg_depend": put("pg_depend", depends), "pg_type": made("dom", "d").unionByName(made("comp", "c")), "pg_proc": proc, "pg_policy": policies, "pg_roles": roles, "pg_auth_members": members}


def _mapped(name: str, k: int, where: str, columns: list[str], sql: str, only: str | None = None):
    Q[name], SQL[name] = (lambda s, d: PG.metadata(_more(s, d), only)[k].where(where).select(*columns)), over_fleet(sql)


_OBJ, _REL = ["key", "parent_key", "name"], ["kind", "from_key", "to_key"]
_MAT = "pre || 'materialized_view:mc' || ck"
_mapped("b10_pg_materialized_views", 0, "key rlike ':(materialized_view|view_column):mc'", _OBJ, f"SELECT {_MAT} AS key, skey AS parent_key, 'mc' || ck AS name FROM cust WHERE ck % 10 = 0 UNION ALL SELECT pre || 'view_column:mc' || ck || ':a', {_MAT}, 'a' FROM cust WHERE ck % 10 = 0")
_mapped("b10_pg_keys_and_indexes", 0, "key rlike ':(unique_constraint|index):mc'", _OBJ, f"SELECT pre || 'unique_constraint:mc' || ck || ':mu' AS key, {_MAT} AS parent_key, 'mu' AS name FROM cust WHERE ck % 10 = 0 UNION ALL SELECT pre || 'index:mc' || ck || ':mix', {_MAT}, 'mix' FROM cust WHERE ck % 10 = 0")
_mapped("b10_pg_materializes", 1, "kind = 'materializes' or (kind = 'depends_on' and from_key like '%:materialized_view:%')", _REL, f"SELECT unnest(['materializes', 'depends_on']) AS kind, {_MAT} AS from_key, tkey AS to_key FROM cust WHERE ck % 10 = 0")
_mapped("b13_pg_returns_type", 1, "kind = 'returns_type'", _REL, "SELECT 'returns_type' AS kind, key AS from_key, regexp_replace(key, ':routine:.*$', ':domain:dom') AS to_key FROM rt WHERE pk % 2 = 0", only="returns_type")
_mapped("b15_pg_domains_and_composites", 0, "key rlike ':(domain|user_defined_type):'", _OBJ, "SELECT pre || 'domain:dom' AS key, skey AS parent_key, 'dom' AS name FROM nat UNION ALL SELECT pre || 'user_defined_type:comp', skey, 'comp' FROM nat")
_mapped("b17_pg_members", 1, "from_key like '%:principal:%'", _REL, "SELECT 'depends_on' AS kind, replace(dkey, ':database:w', ':principal:member') AS from_key, replace(dkey, ':database:w', ':principal:group') AS to_key FROM db", only="depends_on")
_mapped("b18_pg_policies", 0, "key like '%:policy:%'", [*_OBJ, "definition"], "SELECT pre || 'policy:c' || ck || ':pol' AS key, tkey AS parent_key, 'pol' AS name, 'true' AS definition FROM cust WHERE ck % 8 = 0", only="policy")
_mapped("b23_pg_exclusion_constraints", 1, "kind = 'excludes_with'", [*_REL, "ordinal"], "SELECT 'excludes_with' AS kind, pre || 'exclusion_constraint:c' || ck || ':ex' AS from_key, ckey AS to_key, 1 AS ordinal FROM col WHERE pos = 1 AND ck % 9 = 0", only="excludes_with")
