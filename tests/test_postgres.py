"""What of a PostgreSQL catalog the fleet's rows can't show, on a few rows, and the whole mapping against the fleet."""

from metaloom.operators import mapping as M
from metaloom.operators import postgres as PG
from metaloom.operators import validate as V
from metaloom.plans import fleet
from metaloom.plans.shared import written_all

S = "snapshot_key string, "


def test_fleet_comes_back(spark, sf):
    c = fleet.catalog(spark, sf)
    m = M.map_catalog(PG.as_pg_catalog(c), "postgres")
    for name in ("schemas", "tables", "columns", "constraints", "indexes", "views", "routines"):
        assert c.t[name].exceptAll(m.t[name]).isEmpty() and m.t[name].exceptAll(c.t[name]).isEmpty(), name


def extract(spark):
    rows = lambda schema, *values: spark.createDataFrame([("pg:a", *v) for v in values], S + schema)
    return {
        "databases": rows("source_kind string, connection_alias string, name string", ("pg", "a", "d")),
        "pg_namespace": rows("oid long, nspname string, nspowner long", (1, "s", 10)),
        "pg_class": rows(
            "oid long, relname string, relnamespace long, relkind string, relispartition boolean, relpersistence string, relowner long, definition string",
            (100, "t", 1, "p", False, "p", 10, None), (101, "t_1", 1, "r", True, "p", 10, None), (102, "v", 1, "v", False, "p", 11, "select"), (103, "m", 1, "m", False, "p", 10, "select"), (104, "ix_m", 1, "i", False, "p", 10, None), (105, "tmp", 1, "r", False, "t", 10, None), (106, "far", 1, "f", False, "p", 10, None), (107, "odd", 1, "q", False, "p", 10, None), (108, "kid", 1, "r", False, "p", 10, None),
        ),
        "pg_attribute": rows(
            "attrelid long, attname string, attnum int, atttypid long, format_type string, attnotnull boolean, attgenerated string, attisdropped boolean",
            (100, "a", 1, 501, "dom", True, "", False), (100, "gone", 2, 25, "text", False, "", True), (100, "b", 3, 25, "text", False, "s", False), (102, "va", 1, 25, "text", False, "", False), (103, "ma", 1, 25, "text", False, "", False),
        ),
        "pg_attrdef": rows("adrelid long, adnum int, adbin string", (100, 3, "a + 1")),
        "pg_constraint": rows("oid long, conname string, conrelid long, contype string, conkey array<int>, confrelid long, confkey array<int>, conbin string", (200, "ex", 100, "x", [3, 1], 0, [], "EXCLUDE"), (201, "ck", 100, "c", [1], 0, [], "a > 0")),
        "pg_index": rows("indexrelid long, indrelid long, indisunique boolean, indisprimary boolean, indkey array<int>, indnkeyatts int, indpred string, indexprs string", (104, 103, True, False, [1], 1, None, None)),
        "pg_type": rows("oid long, typname string, typnamespace long, typtype string, typrelid long", (501, "dom", 1, "d", 0), (502, "row_of_t", 1, "c", 100)),
        "pg_rewrite": rows("oid long, ev_class long", (300, 102), (301, 103)),
        "pg_depend": rows("classid string, objid long, refclassid string, refobjid long, refobjsubid int, deptype string", ("pg_rewrite", 300, "pg_class", 100, 1, "n"), ("pg_rewrite", 300, "pg_class", 102, 0, "i"), ("pg_rewrite", 301, "pg_class", 102, 0, "n")),
        "pg_proc": rows("oid long, proname string, pronamespace long, prokind string, arguments string, prorettype long, proargnames array<string>, proargtypes array<string>, prosrc string, language string", (400, "f", 1, "f", "integer", 501, ["n"], ["integer"], "x", "sql"), (401, "f", 1, "p", "", 0, [], [], "x", "plpgsql")),
        "pg_trigger": rows("tgrelid long, tgname string, tgfoid long, tgtype int, tgattr array<int>, tgisinternal boolean, definition string", (100, "tr", 400, 2 + 4 + 16, [3], False, "d"), (100, "inner", 400, 4, [], True, "d")),
        "pg_inherits": rows("inhrelid long, inhparent long, inhseqno int", (101, 100, 1), (108, 100, 2)),
        "pg_policy": rows("polrelid long, polname string, polcmd string, polqual string", (100, "own", "r", "true")),
        "pg_roles": rows("oid long, rolname string", (10, "boss"), (11, "hand")),
        "pg_auth_members": rows("roleid long, member long", (10, 11)),
        "pg_event_trigger": rows("evtname string, evtfoid long, evtevent string", ("ev", 401, "ddl_command_end")),
        "pg_extension": rows("extname string, extnamespace long, extversion string", ("hstore", 1, "1.8")),
    }


def test_own_objects(spark):
    x = extract(spark)
    c = M.map_catalog(x, "postgres")
    c = c.with_tables(**written_all({n: c.t[n] for n in ("metadata_objects", "relationships")}))
    assert {(r.name, r.kind) for r in c.tables.collect()} == {("t", "partitioned"), ("t_1", "partition"), ("tmp", "temporary"), ("far", "foreign"), ("kid", "base_table")}
    assert {(r.name, r.is_nullable, r.default_value, r.is_generated) for r in c.columns.collect()} == {("a", False, None, False), ("b", True, "a + 1", True)}
    assert [(r.kind, r.columns, r.expression) for r in c.constraints.collect()] == [("check", ["pg:a:d:s:column:t:a"], "a > 0")]
    assert [r.depends_on for r in c.views.collect()] == [["pg:a:d:s:column:t:a"]] and c.indexes.isEmpty()
    assert {r.key for r in c.routines.collect()} == {"pg:a:d:s:routine:f:integer", "pg:a:d:s:routine:f"}
    assert [(r.timing, r.events, r.executes_routine_key) for r in c.triggers.collect()] == [("BEFORE", ["INSERT", "UPDATE"], "pg:a:d:s:routine:f:integer")]
    p, d = "pg:a:d:s:", "pg:a:d:d:"
    assert {(r.key, r.parent_key) for r in c.metadata_objects.collect()} == {
        (p + "view_column:v:va", p + "view:v"), (p + "view_column:m:ma", p + "materialized_view:m"), (p + "materialized_view:m", p + "schema:s"), (p + "index:m:ix_m", p + "materialized_view:m"), (p + "exclusion_constraint:t:ex", p + "table:t"), (p + "domain:dom", p + "schema:s"), ("v2:" + p + "routine_parameter:f:integer#1%3An", p + "routine:f:integer"),
        (d + "principal:boss", d + "database:d"), (d + "principal:hand", d + "database:d"), (p + "policy:t:own", p + "table:t"), (d + "event:ev", d + "database:d"), (p + "extension:hstore", p + "schema:s"),
    }
    got = {(r.kind, r.from_key.split(":")[-1], r.to_key.split(":")[-1], r.ordinal) for r in c.relationships.collect()}
    assert got == {
        ("depends_on", "m", "v", None), ("materializes", "m", "v", None), ("excludes_with", "ex", "b", 1), ("excludes_with", "ex", "a", 2), ("uses_type", "a", "dom", None), ("returns_type", "integer", "dom", None), ("has_parameter", "integer", "integer#1%3An", 1),
        ("owned_by", "s", "boss", None), ("owned_by", "t", "boss", None), ("owned_by", "t_1", "boss", None), ("owned_by", "v", "hand", None), ("owned_by", "m", "boss", None), ("owned_by", "tmp", "boss", None), ("owned_by", "far", "boss", None), ("owned_by", "kid", "boss", None),
        ("depends_on", "hand", "boss", None), ("depends_on", "own", "t", None), ("partition_of", "t_1", "t", None), ("inherits_from", "kid", "t", 2), ("invokes", "ev", "f", None), ("depends_on", "tr", "b", None),
    }
    assert [r.message for r in PG.unsupported(x).collect()] == ["q"] and [r.message for r in PG.open_dependencies(x).collect()] == ["plpgsql"]
    bad = {r.code for r in V.parents(c).unionByName(V.relationships(c)).collect()}
    assert not bad, bad
