"""JSON: pointers, flattening, differences and patches."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def pointer_path(pointer: str) -> str:
    """JS-04: /a/0 as a path of the variant functions; ~1 is /, ~0 is ~. Numbers are taken as array places."""
    out = "$"
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if re.fullmatch(r"0[0-9]+", part):
            raise ValueError("106: a place must not begin with 0")
        out += f"[{part}]" if part.isdigit() else '["' + part.replace('"', '\\"') + '"]'
    return out


def without_key(text: Column, key: Column) -> Column:
    """JS-02: the object without that key of its top level; values stay as they are written."""
    own = F.from_json(text, "map<string,variant>")
    return F.to_json(F.map_filter(own, lambda k, _: k != key))


def at_pointer(variant: Column, pointer: str, kind: str) -> Column:
    """JS-04: the value, or an error if it isn't there."""
    found = F.try_variant_get(variant, pointer_path(pointer), "variant")
    return F.when(found.isNull(), F.raise_error(F.lit(f"403: nothing at {pointer}")).cast(kind)).otherwise(F.variant_get(variant, pointer_path(pointer), kind))


def value_or(variant: Column, pointer: str, kind: str, default) -> Column:
    """JS-05."""
    return F.coalesce(F.try_variant_get(variant, pointer_path(pointer), kind), F.lit(default).cast(kind))


def flatten(value: Any, at: str = "") -> dict[str, Any]:
    """JS-06: pointer -> scalar; empty arrays and objects are null."""
    if isinstance(value, (dict, list)) and value:
        pairs = value.items() if isinstance(value, dict) else enumerate(value)
        out: dict[str, Any] = {}
        for k, v in pairs:
            out |= flatten(v, f"{at}/" + str(k).replace("~", "~0").replace("/", "~1"))
        return out
    return {at: None if isinstance(value, (dict, list)) else value}


def unflatten(flat: dict[str, Any]) -> Any:
    """JS-06: keys that are all places from 0 make an array."""
    if set(flat) == {""}:
        return flat[""]
    tree: dict = {}
    for pointer, v in flat.items():
        here, parts = tree, [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
        for p in parts[:-1]:
            here = here.setdefault(p, {})
        here[parts[-1]] = ("leaf", v)

    def build(node: Any) -> Any:
        if isinstance(node, tuple):
            return node[1]
        if node and set(node) == {str(i) for i in range(len(node))}:
            return [build(node[str(i)]) for i in range(len(node))]
        return {k: build(v) for k, v in node.items()}

    return build(tree)


def difference(a: Any, b: Any, at: str = "") -> list[dict]:
    """JS-07: operations that turn a into b."""
    if type(a) is not type(b) or not isinstance(a, (dict, list)):
        return [] if a == b and type(a) is type(b) else [{"op": "replace", "path": at, "value": b}]
    out: list[dict] = []
    if isinstance(a, list):
        for i in range(min(len(a), len(b))):
            out += difference(a[i], b[i], f"{at}/{i}")
        out += [{"op": "remove", "path": f"{at}/{i}"} for i in range(len(a) - 1, len(b) - 1, -1)]
        return out + [{"op": "add", "path": f"{at}/-", "value": x} for x in b[len(a) :]]
    for k in a:
        path = f"{at}/" + k.replace("~", "~0").replace("/", "~1")
        out += difference(a[k], b[k], path) if k in b else [{"op": "remove", "path": path}]
    return out + [{"op": "add", "path": f"{at}/" + k.replace("~", "~0").replace("/", "~1"), "value": b[k]} for k in b if k not in a]


def patched(value: Any, operations: list[dict]) -> Any:
    """JS-07: add, remove, replace, copy, move and test."""
    value = json.loads(json.dumps(value))
    root = {"": value}

    def place(path: str) -> tuple[Any, Any]:
        here, key = root, ""
        for part in path.split("/")[1:]:
            here = here[key]
            key = part.replace("~1", "/").replace("~0", "~")
            if isinstance(here, list):
                key = len(here) if key == "-" else int(key)
        return here, key

    for o in operations:
        if o["op"] in ("move", "copy"):
            source, key = place(o["from"])
            new = json.loads(json.dumps(source[key]))
            if o["op"] == "move":
                del source[key]
        else:
            new = o.get("value")
        here, key = place(o["path"])
        if o["op"] == "test":
            if here[key] != new:
                raise ValueError(f"501: unequal at {o['path']}")
        elif o["op"] == "remove":
            del here[key]
        elif isinstance(here, list) and o["op"] != "replace":
            here.insert(key, new)
        else:
            here[key] = new
    return root[""]


def merge_patched(value: Any, patch: Any) -> Any:
    """JS-08: null deletes, objects merge, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(value) if isinstance(value, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patched(out.get(k), v)
    return out


def flattened(text: Column) -> Column:
    """JS-06 over a column: map of pointer to JSON scalar."""
    def one(x: str) -> dict[str, str]:
        return {k: json.dumps(v) for k, v in flatten(json.loads(x)).items()}

    def run(a: pd.Series) -> pd.Series:
        return a.map(one, na_action="ignore")

    run.__annotations__ = {"a": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "map<string,string>")(text)


def _binary_op(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else json.dumps(f(json.loads(x), json.loads(y)), separators=(",", ":"), sort_keys=True) for x, y in zip(a, b)])

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def differences(a: Column, b: Column) -> Column:
    """JS-07 over columns."""
    return _binary_op(difference)(a, b)


def with_patch(a: Column, operations: Column) -> Column:
    """JS-07 over columns."""
    return _binary_op(patched)(a, operations)


def with_merge_patch(a: Column, patch: Column) -> Column:
    """JS-08 over columns."""
    return _binary_op(merge_patched)(a, patch)


# Order of the kinds when values of different kinds are compared.
KINDS = ("NULL", "BOOLEAN", "NUMBER", "OBJECT", "ARRAY", "STRING")


def kind_of(variant: Column) -> Column:
    """JS-11: name of the kind of a variant."""
    schema = F.schema_of_variant(variant)
    return (F.when(schema.isNull() | (schema == "VOID"), "NULL").when(schema == "BOOLEAN", "BOOLEAN").when(schema.startswith("OBJECT"), "OBJECT")
            .when(schema.startswith("ARRAY"), "ARRAY").when(schema == "STRING", "STRING").otherwise("NUMBER"))


def kind_rank(variant: Column) -> Column:
    """JS-12: sort by this first, then by the value."""
    return F.array_position(F.array(*[F.lit(k) for k in KINDS]), kind_of(variant))
