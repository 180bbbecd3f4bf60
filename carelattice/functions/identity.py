"""Deterministic identifiers and hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 identifier of a text, as expressions: SHA-1 with version and variant bits set."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1)
    part = lambda a, n: F.substring(digest, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def sorted_fields(x: Column, kind: DataType) -> Column:
    """``x`` with the fields of every struct in it in the order of their names."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        return F.when(x.isNotNull(), F.struct(*(sorted_fields(x[f.name], f.dataType).alias(f.name) for f in fields)))
    if isinstance(kind, ArrayType):
        return F.transform(x, lambda e: sorted_fields(e, kind.elementType))
    return x


def canonical_json(x: Column, kind: DataType) -> Column:
    """Compact JSON with sorted keys at every level; null fields are kept."""
    return F.to_json(sorted_fields(x, kind), {"ignoreNullFields": "false"})


def context_hash(x: Column, kind: DataType, confirmed: Column | None = None) -> Column:
    """The confirmed hash where there is one, else SHA-256 of the canonical JSON."""
    own = F.sha2(canonical_json(x, kind), 256)
    return own if confirmed is None else F.coalesce(F.nullif(confirmed, F.lit("")), own)
