"""Inventory checks (B32) on raw catalogs whose rows refer to one another by numbers: which ids repeat, and which references lead nowhere.

The references of a vendor are declared in one list; all of them are checked by one union and one anti join on ids tagged by their class, and all ids by one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mapping import Extract

AT = ["snapshot_key"]


@dataclass(frozen=True)
class Ids:
    """Rows of a table are the things of a class, told apart by one number or two."""

    table: str
    of_class: str
    major: str
    minor: str | None = None


@dataclass(frozen=True)
class Reference:
    """Columns of a table name things of a class. minor may be an array, for each of whose numbers there is a reference; 0 in an optional reference means none."""

    table: str
    of_class: str
    major: str
    minor: str | None = None
    optional: bool = False
    where: str = "true"


# What the catalogs' own documentation says that their columns refer to.
IDS = {
    "postgres": [Ids("pg_namespace", "namespace", "oid"), Ids("pg_class", "relation", "oid"), Ids("pg_attribute", "attribute", "attrelid", "attnum"), Ids("pg_constraint", "constraint", "oid"), Ids("pg_type", "type", "oid"), Ids("pg_proc", "routine", "oid"), Ids("pg_roles", "role", "oid")],
    "sqlserver": [Ids("schemas", "schema", "schema_id"), Ids("tables", "object", "object_id"), Ids("views", "object", "object_id"), Ids("objects", "object", "object_id"), Ids("triggers", "object", "object_id"), Ids("key_constraints", "object", "object_id"), Ids("foreign_keys", "object", "object_id"), Ids("check_constraints", "object", "object_id"), Ids("sequences", "object", "object_id"), Ids("synonyms", "object", "object_id"), Ids("columns", "column", "object_id", "column_id"), Ids("indexes", "index", "object_id", "index_id"), Ids("parameters", "parameter", "object_id", "parameter_id"), Ids("types", "type", "user_type_id"), Ids("database_principals", "principal", "principal_id"), Ids("partition_functions", "partition function", "function_id"), Ids("partition_schemes", "data space", "data_space_id"), Ids("xml_schema_collections", "XML collection", "xml_collection_id")],
}
REFERENCES = {
    "postgres": [
        Reference("pg_class", "namespace", "relnamespace"),
        Reference("pg_class", "role", "relowner"),
        Reference("pg_attribute", "relation", "attrelid"),
        Reference("pg_attrdef", "attribute", "adrelid", "adnum"),
        Reference("pg_constraint", "relation", "conrelid", optional=True),
        Reference("pg_constraint", "relation", "confrelid", optional=True),
        Reference("pg_constraint", "attribute", "conrelid", "conkey"),
        Reference("pg_constraint", "attribute", "confrelid", "confkey"),
        Reference("pg_index", "relation", "indexrelid"),
        Reference("pg_index", "relation", "indrelid"),
        Reference("pg_index", "attribute", "indrelid", "indkey", optional=True),
        Reference("pg_rewrite", "relation", "ev_class"),
        Reference("pg_proc", "namespace", "pronamespace"),
        Reference("pg_trigger", "relation", "tgrelid"),
        Reference("pg_trigger", "routine", "tgfoid", optional=True),
        Reference("pg_type", "namespace", "typnamespace"),
        Reference("pg_enum", "type", "enumtypid"),
        Reference("pg_sequence", "relation", "seqrelid"),
        Reference("pg_inherits", "relation", "inhrelid"),
        Reference("pg_inherits", "relation", "inhparent"),
        Reference("pg_policy", "relation", "polrelid"),
        Reference("pg_depend", "relation", "refobjid", where="refclassid = 'pg_class'"),
    ],
    "sqlserver": [
        Reference("schemas", "principal", "principal_id"),
        Reference("tables", "schema", "schema_id"),
        Reference("views", "schema", "schema_id"),
        Reference("objects", "schema", "schema_id"),
        Reference("columns", "object", "object_id"),
        Reference("key_constraints", "object", "parent_object_id"),
        Reference("key_constraints", "index", "parent_object_id", "unique_index_id"),
        Reference("foreign_keys", "object", "parent_object_id"),
        Reference("foreign_keys", "object", "referenced_object_id"),
        Reference("foreign_key_columns", "object", "constraint_object_id"),
        Reference("foreign_key_columns", "column", "parent_object_id", "parent_column_id"),
        Reference("foreign_key_columns", "column", "referenced_object_id", "referenced_column_id"),
        Reference("check_constraints", "object", "parent_object_id"),
        Reference("default_constraints", "column", "parent_object_id", "parent_column_id"),
        Reference("indexes", "object", "object_id"),
        Reference("index_columns", "index", "object_id", "index_id"),
        Reference("index_columns", "column", "object_id", "column_id"),
        Reference("triggers", "object", "parent_id", optional=True),
        Reference("trigger_events", "object", "object_id"),
        Reference("sql_modules", "object", "object_id"),
        Reference("parameters", "object", "object_id"),
        Reference("partition_schemes", "partition function", "function_id"),
        Reference("partition_range_values", "partition function", "function_id"),
        Reference("partitions", "object", "object_id"),
        Reference("xml_schema_namespaces", "XML collection", "xml_collection_id"),
        Reference("sql_expression_dependencies", "object", "referencing_id", where="referencing_class = 1"),
    ],
}
IDS["yugabytedb"], REFERENCES["yugabytedb"] = IDS["postgres"], REFERENCES["postgres"]


def _number(c: Column) -> Column:
    return c.cast("long")


def inventory(x: Extract, vendor: str) -> DataFrame:
    """(snapshot_key, code, object_key, message): ids that more than one row has, and references to what the extract lacks, with how many rows make them. Classes that the extract has no table for aren't checked: nothing can be said of references to them."""
    if vendor not in IDS:
        from .mapping import inventory_issues

        return inventory_issues(x)
    known = [i for i in IDS[vendor] if i.table in x]
    zero = F.lit(0).cast("long")
    ids = reduce(DataFrame.unionByName, [x[i.table].select(*AT, F.lit(i.of_class).alias("class"), _number(F.col(i.major)).alias("major"), (_number(F.col(i.minor)) if i.minor else zero).alias("minor")) for i in known])
    counted = ids.groupBy(*AT, "class", "major", "minor").agg(F.count("*").alias("n"))
    classes, parts = {i.of_class for i in known}, []
    for r in (r for r in REFERENCES[vendor] if r.table in x and r.of_class in classes):
        df = x[r.table].where(r.where)
        many = r.minor is not None and dict(df.dtypes)[r.minor].startswith("array")
        minor = zero if r.minor is None else F.explode(r.minor) if many else F.col(r.minor)
        rows = df.select(*AT, F.lit(r.of_class).alias("class"), F.lit(r.table + "." + (r.minor or r.major)).alias("column"), _number(F.col(r.major)).alias("major"), minor.alias("minor")).withColumn("minor", _number(F.col("minor")))
        number = F.col("major") if r.minor is None else F.col("minor")
        parts.append(rows.where(number.isNotNull() & ((number != 0) if r.optional else F.lit(True))))
    wanted = reduce(DataFrame.unionByName, parts).groupBy(*AT, "class", "major", "minor", "column").agg(F.count("*").alias("n"))
    lost = wanted.join(counted.drop("n"), [*AT, "class", "major", "minor"], "left_anti")
    subject = F.concat_ws(":", "class", F.col("major").cast("string"), F.col("minor").cast("string"))
    issue = lambda df, code, message: df.select(*AT, F.lit(code).alias("code"), subject.alias("object_key"), message.alias("message"))
    return issue(counted.where("n > 1"), "duplicate_id", F.format_string("%d rows have this id", "n")).unionByName(issue(lost, "reference_missing", F.format_string("%d rows of %s name it", "n", "column")))
