"""Stable object keys and other scalar expressions over names, payloads and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.model import KEY_PARTS, LABELS, METADATA_LABELS, OTHER_LABEL, RELATIONSHIPS

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _col(c: Column | str) -> Column:
    return F.lit(c) if isinstance(c, str) else c


def object_key(source: Column | str, alias: Column | str, database: Column | str, schema: Column | str, kind: Column | str, name: Column | str, sub: Column | None = None) -> Column:
    """K1: the parts joined by colons; if any holds a colon or a percent sign, with both escaped and v2: in front. A null sub-object is left out; any other null part gives null."""
    parts = [_col(c) for c in (source, alias, database, schema, kind, name)]
    every = parts + ([sub] if sub is not None else [])
    escape = lambda c: F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit(":"), F.lit("%3A"))
    special = reduce(lambda a, b: a | b, [F.coalesce(c.rlike("[:%]"), F.lit(False)) for c in every])
    key = F.when(special, F.concat(F.lit("v2:"), F.concat_ws(":", *[escape(c) for c in every]))).otherwise(F.concat_ws(":", *every))
    return F.when(reduce(lambda a, b: a & b, [c.isNotNull() for c in parts]), key)


def parse_key(key: Column) -> Column:
    """K2: struct of the parts, or null for anything but 6 or 7 non-empty parts of a known kind with good escapes."""
    v2 = key.startswith("v2:")
    raw = F.when(v2, F.substr(key, F.lit(4))).otherwise(key)
    parts = F.split(raw, ":", -1)
    decode = lambda c: F.when(v2, F.replace(F.replace(F.replace(c, F.lit("%3A"), F.lit(":")), F.lit("%3a"), F.lit(":")), F.lit("%25"), F.lit("%"))).otherwise(c)
    good = F.size(parts).isin(6, 7) & ~F.array_contains(parts, "") & F.get(parts, F.lit(4)).isin(*LABELS) & ~(v2 & raw.rlike("%(?!25|3[Aa])"))
    return F.when(good, F.struct(*[decode(F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(KEY_PARTS)]))


def encode_parts(p: Column) -> Column:
    return object_key(*[p[n] for n in KEY_PARTS[:6]], sub=p["sub_object"])


def comparable_key(key: Column) -> Column:
    """K3: the key with alias _, or as it is if it can't be parsed."""
    p = parse_key(key)
    return F.coalesce(object_key(p["source_kind"], F.lit("_"), *[p[n] for n in KEY_PARTS[2:6]], sub=p["sub_object"]), key)


def comparable_edge_key(edge_type: Column, from_: Column, to: Column) -> Column:
    """K4."""
    return F.format_string("%s:%s->%s", edge_type, comparable_key(from_), comparable_key(to))


#: Levels of objects and arrays that a connection_alias value may hold.
ALIAS_DEPTH = 20


def comparable_payload(payload: Column) -> Column:
    """K5: JSON in canonical order of fields without any connection_alias member, whatever the member holds (objects and arrays up to ALIAS_DEPTH levels deep); text that isn't JSON stays as it is."""
    text, plain = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', r'[^\[\]{}"]*+'
    value = f"{plain}(?:{text}{plain})*+"
    for _ in range(ALIAS_DEPTH - 1):
        value = f"{plain}(?:(?:{text}|[\\[{{]{value}[\\]}}]){plain})*+"
    member = f'"connection_alias":(?:{text}|null|true|false|-?[0-9.eE+-]++|[\\[{{]{value}[\\]}}])'
    canonical = F.to_json(F.try_parse_json(payload))
    return F.coalesce(F.regexp_replace(F.regexp_replace(canonical, member + ",", ""), ",?" + member, ""), payload)


def _mapped(c: Column, values: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def kind_label(kind: Column) -> Column:
    """K6: node label of an object kind; null for an unknown one."""
    return _mapped(kind, LABELS)


def label_kind(label: Column) -> Column:
    return _mapped(label, {v: k for k, v in LABELS.items()})


def metadata_label(kind: Column) -> Column:
    return F.coalesce(_mapped(kind, METADATA_LABELS), F.lit(OTHER_LABEL))


def rel_edge_type(kind: Column, extension: Column) -> Column:
    """K7."""
    return F.when(kind == "extension", F.concat(F.lit("EXTENSION:"), extension)).otherwise(_mapped(kind, RELATIONSHIPS))


# Edge types of broad ownership.
BROAD = ["DATABASE_HAS_SCHEMA", "SCHEMA_HAS_TABLE", "SCHEMA_HAS_VIEW", "SCHEMA_HAS_ROUTINE", "TABLE_HAS_COLUMN"]


def edge_priority(edge_type: Column) -> Column:
    """K8: 2 for broad ownership, 1 for indexes of a table, else 0."""
    return F.when(edge_type.isin(*BROAD), 2).when(edge_type == "TABLE_HAS_INDEX", 1).otherwise(0)


def contains_ci(c: Column, needle: str) -> Column:
    """K9: Unicode case folding."""
    return F.coalesce(F.contains(F.lower(c), F.lower(F.lit(needle))), F.lit(False))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def contains_ascii_ci(c: Column, needle: str) -> Column:
    """K9: A-Z alone are folded."""
    return F.coalesce(F.contains(ascii_lower(c), ascii_lower(F.lit(needle))), F.lit(False))


def payload_array_len_ge(payload: Column, field: str, n: int) -> Column:
    """False for a missing field, another type or bad JSON."""
    return F.coalesce(F.json_array_length(F.get_json_object(payload, f"$.{field}")) >= n, F.lit(False))


def alias_of(snapshot_key: Column) -> Column:
    """What follows the first colon, or the whole key."""
    at = F.instr(snapshot_key, ":")
    return F.when(at > 0, F.substr(snapshot_key, at + 1)).otherwise(snapshot_key)


def capability_warnings(caps: Column) -> Column:
    """An array of warnings for the four supports that aren't full, then the limitations. caps: a struct of a capabilities row."""
    # The warnings' texts.
    levels = {"partial": "is partially tracked by", "unsupported": "is not tracked by", "unknown": "support is unknown for"}
    topics = {"views": "view dependency metadata", "triggers": "trigger dependency metadata", "routines": "routine dependency metadata", "dependencies": "cross-object dependency metadata"}
    said = [F.when(caps[n] != "supported", F.format_string("%s %s the %s adapter.", F.lit(t), _mapped(caps[n], levels), caps["source_kind"])) for n, t in topics.items()]
    return F.concat(F.array_compact(F.array(*said)), F.coalesce(caps["limitations"], F.array().cast("array<string>")))


def fold_name(c: Column, mode: Column | int) -> Column:
    """Names as they are where mode (lower_case_table_names) is 0, else folded over A-Z."""
    mode = F.lit(mode) if isinstance(mode, int) else mode
    return F.when(mode == 0, c).otherwise(ascii_lower(c))


def sanitize_alias(c: Column) -> Column:
    """Upper case over a-z, all but ASCII letters and digits as underscores."""
    return F.regexp_replace(F.translate(c, LOWER, UPPER), "[^A-Z0-9]", "_")


def clamp(requested: Column | int, most: int) -> Column:
    """Struct of requested, applied and clamped."""
    r = F.lit(requested) if isinstance(requested, int) else requested
    return F.struct(r.alias("requested"), F.least(r, F.lit(most)).alias("applied"), (r > most).alias("clamped"))
