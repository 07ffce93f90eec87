"""JSON documents as VARIANT: types, contract-driven leaves, template fill, token serialisation, validation.

A contract lists the scalar paths of a document; one array of items may hold scalar paths of its own. Leaves of a contract
come from expressions over the parsed VARIANT, without Python; documents of unknown shape go through exact.leaf_map.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    scalars: Sequence[str]
    array: str = ""
    item_scalars: Sequence[str] = ()


def json_type(v: Column) -> Column:
    """null, boolean, integer, number, string, array or object; SQL NULL for a missing value."""
    s = F.schema_of_variant(v)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s == "VOID", "null")
        .when(s == "BOOLEAN", "boolean")
        .when(s == "BIGINT", "integer")
        .when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "number")
        .when(s == "STRING", "string")
        .when(s.startswith("ARRAY"), "array")
        .otherwise("object")
    )


def pick(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def text_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _leaf(path: Column, v: Column) -> Column:
    return F.struct(path.alias("key"), F.struct(json_type(v).alias("jtype"), text_of(v).alias("value")).alias("value"))


def contract_leaves(doc: Column, contract: Contract) -> Column:
    """map<path, struct<jtype, value>> of the leaves that exist in doc (a VARIANT); empty for a null document."""
    own = F.array(*[_leaf(F.lit(p), pick(doc, p)) for p in contract.scalars])
    if contract.array:
        items = F.coalesce(F.try_variant_get(doc, f"$.{contract.array}", "array<variant>"), F.array().cast("array<variant>"))
        inner = F.transform(items, lambda x, i: F.array(*[_leaf(F.concat(F.lit(f"{contract.array}["), i.cast("string"), F.lit(f"].{p}")), pick(x, p)) for p in contract.item_scalars]))
        own = F.concat(own, F.flatten(inner))
    return F.map_from_entries(F.filter(own, lambda e: e["value"]["jtype"].isNotNull()))


def fill_template(doc: Column, contract: Contract) -> Column:
    """JSON text in the contract's shape: unknown keys dropped, missing ones null, items mapped one by one."""

    def scalar(v: Column, path: str) -> Column:
        picked = pick(v, path)
        return F.coalesce(F.when(json_type(picked).isin("array", "object"), F.lit(None)).otherwise(F.to_json(picked)), F.lit("null"))

    def nested(v: Column, paths: Sequence[str]) -> Column:
        parts: list[Column] = []
        seen: dict[str, list[str]] = {}
        for p in paths:
            head, _, rest = p.partition(".")
            seen.setdefault(head, []).append(rest)
        for n, (head, rests) in enumerate(seen.items()):
            parts.append(F.lit(("," if n else "") + f'"{head}":'))
            parts.append(nested(pick(v, head), rests) if rests[0] else scalar(v, head))
        return F.concat(F.lit("{"), *parts, F.lit("}"))

    own = nested(doc, contract.scalars)
    if not contract.array:
        return own
    items = F.coalesce(F.try_variant_get(doc, f"$.{contract.array}", "array<variant>"), F.array().cast("array<variant>"))
    listed = F.array_join(F.transform(items, lambda x: nested(x, contract.item_scalars)), ",")
    return F.concat(F.substring(own, F.lit(1), F.length(own) - 1), F.lit(f',"{contract.array}":['), listed, F.lit("]}"))


def to_tokens(doc: Column, contract: Contract) -> Column:
    """<s_key>...</s_key> in the contract's order, items joined by <sep/>, null as <null/>."""

    def scalar(v: Column, path: str) -> Column:
        return F.coalesce(text_of(pick(v, path)), F.lit("<null/>"))

    def nested(v: Column, paths: Sequence[str]) -> Column:
        parts, seen = [], {}
        for p in paths:
            head, _, rest = p.partition(".")
            seen.setdefault(head, []).append(rest)
        for head, rests in seen.items():
            parts += [F.lit(f"<s_{head}>"), nested(pick(v, head), rests) if rests[0] else scalar(v, head), F.lit(f"</s_{head}>")]
        return F.concat(*parts)

    own = nested(doc, contract.scalars)
    if not contract.array:
        return own
    items = F.coalesce(F.try_variant_get(doc, f"$.{contract.array}", "array<variant>"), F.array().cast("array<variant>"))
    return F.concat(own, F.lit(f"<s_{contract.array}>"), F.array_join(F.transform(items, lambda x: nested(x, contract.item_scalars)), "<sep/>"), F.lit(f"</s_{contract.array}>"))
