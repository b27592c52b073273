"""Canonical JSON texts of nested values: the same value gives the same text, however its keys are ordered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType


def canonical_json(value: Column, kind: DataType, jsonb: bool = False) -> Column:
    """``value`` of type ``kind`` as JSON text with sorted keys at every depth; a null of any depth is ``null``.

    Keys go by name, without spaces. With ``jsonb`` they go by length in bytes and then by name, with a space after colons and
    commas, as the database writes such values. Keys of maps are texts.
    """
    comma, colon = (", ", ": ") if jsonb else (",", ":")

    def text(v: Column, k: DataType) -> Column:
        if isinstance(k, StructType):
            order = sorted(k.fields, key=lambda f: ((len(f.name.encode()),) if jsonb else ()) + (f.name.encode(),))
            fields = [F.concat(_atom(F.lit(f.name)), F.lit(colon), text(v[f.name], f.dataType)) for f in order]
            whole = F.concat(F.lit("{"), F.concat_ws(comma, *fields), F.lit("}"))
        elif isinstance(k, MapType):
            size = (lambda name: F.octet_length(name)) if jsonb else (lambda name: F.lit(0))
            names = F.array_sort(F.transform(F.map_keys(v), lambda name: F.struct(size(name).alias("size"), name.alias("name"))))
            each = F.transform(names, lambda n: F.concat(_atom(n["name"]), F.lit(colon), text(F.element_at(v, n["name"]), k.valueType)))
            whole = F.concat(F.lit("{"), F.array_join(each, comma), F.lit("}"))
        elif isinstance(k, ArrayType):
            whole = F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: text(x, k.elementType)), comma), F.lit("]"))
        else:
            whole = _atom(v)
        return F.when(v.isNull(), "null").otherwise(whole)

    return text(value, kind)


def _atom(value: Column) -> Column:
    """One value as JSON: what Spark writes in a list of it."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)
