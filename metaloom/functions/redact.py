"""Redaction of secrets in connection strings and error texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK, MOST_BYTES = "***", 8192


def redact_url(c: Column) -> Column:
    """The password of scheme://user:password@host, from the userinfo's last colon to the authority's last at sign."""
    return F.regexp_replace(c, r"(://[^/?#]*:)[^/?#:]*(@[^/?#@]*)(?=[/?#]|$)", "$1" + MASK + "$2")


def redact_ado(c: Column) -> Column:
    """Values of password and pwd segments; braces and quotes may hold semicolons, a doubled closing mark stands for itself, and what isn't closed goes to the end."""
    value = r"""(?:\{(?:[^}]|\}\})*(?:\}|$)|"(?:[^"]|"")*(?:"|$)|'(?:[^']|'')*(?:'|$)|[^;]*)"""
    name = r"(?:p\s*a\s*s\s*s\s*w\s*o\s*r\s*d|p\s*w\s*d)"
    return F.regexp_replace(c, rf"(?i)((?:^|;)\s*{name}\s*=\s*){value}", "$1" + MASK)


def redact_oracle(c: Column) -> Column:
    """user/password@host, user without a colon, from the last white space or quote on."""
    return F.regexp_replace(c, r"""(^|[\s'"])([^\s'"/:@]++)/[^\s'"@]++@""", "$1$2/" + MASK + "@")


def redact(c: Column) -> Column:
    return redact_oracle(redact_ado(redact_url(c)))


def redact_error(message: Column, connection: Column) -> Column:
    """Echoes of the connection string replaced, then K12 to K14, then at most 8192 bytes, whole characters."""
    echoed = F.when(F.length(connection) > 0, F.replace(message, connection, redact(connection))).otherwise(message)
    # The cut is an expression of the clean text as a variable: where it names it again and again, nothing is redacted again.
    return F.get(F.transform(F.array(redact(F.coalesce(echoed, message))), _cut), F.lit(0))


def _cut(clean: Column) -> Column:
    """At most MOST_BYTES bytes: back to the start of the character that the limit would split; bytes 10xxxxxx continue one."""
    raw = clean.cast("binary")
    cut = F.aggregate(F.sequence(F.lit(0), F.lit(3)), F.lit(MOST_BYTES), lambda n, _: F.when(F.hex(F.substr(raw, n + 1, F.lit(1))).rlike("^[89AB]"), n - 1).otherwise(n))
    return F.when(F.octet_length(clean) <= MOST_BYTES, clean).otherwise(F.substr(raw, F.lit(1), cut).cast("string"))
