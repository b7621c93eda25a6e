"""The canonical model of catalog metadata: its tables, kinds, labels, edge types and count categories."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

if TYPE_CHECKING:
    from ..operators.proof import Proof

KEY_PARTS = ["source_kind", "connection_alias", "database", "schema", "object_kind", "object_name", "sub_object"]

# Object kinds and the graph's node labels for them.
LABELS = {
    "database": "Database",
    "schema": "Schema",
    "table": "Table",
    "column": "Column",
    "primary_key": "PrimaryKey",
    "foreign_key": "ForeignKey",
    "unique_constraint": "UniqueConstraint",
    "check_constraint": "CheckConstraint",
    "index": "Index",
    "view": "View",
    "view_column": "ViewColumn",
    "trigger": "Trigger",
    "routine": "Routine",
    "materialized_view": "MaterializedView",
    "sequence": "Sequence",
    "routine_parameter": "RoutineParameter",
    "user_defined_type": "UserDefinedType",
    "domain": "Domain",
    "enum_value": "EnumValue",
    "synonym": "Synonym",
    "exclusion_constraint": "ExclusionConstraint",
    "event": "Event",
    "package": "Package",
    "principal": "Principal",
    "policy": "Policy",
    "extension": "Extension",
}
#: Labels of metadata objects whose kind has a typed table of its own.
OTHER_LABEL = "MetadataObject"
METADATA_LABELS = {k: v for k, v in LABELS.items() if k in "materialized_view view_column sequence routine_parameter user_defined_type domain enum_value synonym exclusion_constraint event package principal policy extension".split()}

# Constraint kinds and the object kinds of their keys.
CONSTRAINTS = {"primary_key": "primary_key", "foreign_key": "foreign_key", "unique": "unique_constraint", "check": "check_constraint"}

# Relationship kinds and their edge types.
RELATIONSHIPS = {
    "depends_on": "DEPENDS_ON",
    "uses_type": "USES_TYPE",
    "uses_sequence": "USES_SEQUENCE",
    "partition_of": "PARTITION_OF",
    "inherits_from": "INHERITS_FROM",
    "synonym_for": "SYNONYM_FOR",
    "has_parameter": "HAS_PARAMETER",
    "returns_type": "RETURNS_TYPE",
    "owned_by": "OWNED_BY",
    "materializes": "MATERIALIZES",
    "invokes": "INVOKES",
    "includes_column": "INCLUDES_COLUMN",
    "excludes_with": "EXCLUDES_WITH",
}

# The kinds that a metadata object may have.
METADATA_KINDS = "primary_key unique_constraint check_constraint index routine materialized_view view_column sequence routine_parameter user_defined_type domain enum_value synonym exclusion_constraint event package principal policy trigger extension".split()

# Allowed parents of metadata objects, by the child's kind; kinds not named may have any.
PARENTS = {
    "view_column": "view materialized_view",
    "materialized_view": "schema",
    "sequence": "schema",
    "user_defined_type": "schema",
    "domain": "schema",
    "synonym": "schema",
    "package": "schema",
    "primary_key": "materialized_view",
    "unique_constraint": "materialized_view",
    "routine": "package user_defined_type",
    "check_constraint": "domain materialized_view",
    "index": "materialized_view",
    "event": "database schema",
    "routine_parameter": "routine",
    "enum_value": "user_defined_type",
    "exclusion_constraint": "table",
    "principal": "database schema",
    "policy": "schema table view",
    "trigger": "database schema table view materialized_view",
}

# Allowed kinds at the ends of a relationship, "from > to", * for any; kinds not named may join any two.
ENDPOINTS = {
    "uses_type": ["column view_column routine routine_parameter sequence user_defined_type extension > user_defined_type domain"],
    "uses_sequence": ["column > sequence"],
    "partition_of": ["table > table"],
    "inherits_from": ["table > table", "user_defined_type > user_defined_type"],
    "synonym_for": ["synonym > *"],
    "has_parameter": ["routine package > routine_parameter"],
    "returns_type": ["routine > user_defined_type domain"],
    "owned_by": ["* > principal"],
    "materializes": ["materialized_view > table view"],
    "invokes": ["routine trigger event > routine"],
    "includes_column": ["index > column view_column"],
    "excludes_with": ["exclusion_constraint > column"],
}

OBJECT_CATEGORIES = list(LABELS)
# The categories of relation counts.
RELATION_CATEGORIES = "database_has_schema schema_has_table table_has_column table_has_constraint constraint_column foreign_key_column_pair table_has_index index_column schema_has_view view_dependency trigger_target trigger_routine schema_has_routine routine_dependency metadata_parent metadata_relationship".split()

# Size limits.
MAX_TEXT, MAX_PROPERTIES, MAX_PROPERTY_NAME, MAX_PROPERTY_TEXT, MAX_PROPERTY_ITEMS = 1_048_576, 256, 256, 65_536, 4_096
MAX_DEPTH, MAX_RESULTS, MAX_QUERY = 8, 200, 500

SCHEMAS = {
    "databases": "snapshot_key string, key string, name string, source_kind string, connection_alias string",
    "schemas": "snapshot_key string, key string, database_key string, name string",
    "tables": "snapshot_key string, key string, schema_key string, name string, kind string",
    "columns": "snapshot_key string, key string, table_key string, name string, ordinal_position int, data_type string, is_nullable boolean, default_value string, is_generated boolean",
    "constraints": "snapshot_key string, key string, table_key string, name string, kind string, columns array<string>, referenced_table_key string, referenced_columns array<string>, expression string",
    "indexes": "snapshot_key string, key string, table_key string, name string, columns array<string>, is_unique boolean, is_primary boolean, predicate string, expression string",
    "views": "snapshot_key string, key string, schema_key string, name string, definition string, depends_on array<string>",
    "triggers": "snapshot_key string, key string, table_key string, name string, timing string, events array<string>, definition string, executes_routine_key string",
    "routines": "snapshot_key string, key string, schema_key string, name string, kind string, definition string, depends_on array<string>",
    "capabilities": "snapshot_key string, source_kind string, metadata_only boolean, schemas boolean, tables boolean, columns boolean, constraints boolean, indexes boolean, views string, triggers string, routines string, dependencies string, limitations array<string>, notes array<string>",
    "metadata_objects": "snapshot_key string, key string, parent_key string, name string, extension_kind string, definition string, properties map<string,struct<type:string,value:string>>",
    "annotations": "snapshot_key string, object_key string, definition string, properties map<string,struct<type:string,value:string>>",
    "relationships": "snapshot_key string, kind string, extension_name string, from_key string, to_key string, ordinal int, properties map<string,struct<type:string,value:string>>",
}
#: The lists whose rows are objects with a key of their own.
OBJECT_LISTS = ["databases", "schemas", "tables", "columns", "constraints", "indexes", "views", "triggers", "routines", "metadata_objects"]


@dataclass
class Canonical:
    """The canonical tables of any number of snapshots, by the names of SCHEMAS."""

    t: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return self.t[name]
        raise AttributeError(name)

    def with_tables(self, **tables: DataFrame) -> Canonical:
        return replace(self, t=self.t | tables)

    @classmethod
    def of(cls, spark, **tables: DataFrame) -> Canonical:
        """Tables cast to their schemas; those not given are empty."""
        from pyspark.sql import functions as F
        from pyspark.sql.types import StructType

        out = {}
        for name, ddl in SCHEMAS.items():
            schema = StructType.fromDDL(ddl)
            if name in tables:
                have = set(tables[name].columns)
                out[name] = tables[name].select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
            else:
                out[name] = spark.createDataFrame([], schema)
        return cls(out)


@dataclass
class Graph:
    """The property graph of any number of snapshots, and the proofs stored with it, if any."""

    snapshots: DataFrame
    nodes: DataFrame
    edges: DataFrame
    proof: Proof | None = None
