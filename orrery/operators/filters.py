"""The JSON predicate language, compiled to one boolean Column.

Predicates have two values: a compiled leaf is never null under a negation, so that negation is plain. A field is read either from a typed
metadata map, where each row may hold another kind, or from a native column of one type, whose comparisons reach the scan.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import query_words, words
from ..model import InvalidArgument

EARTH_RADIUS = 6371008.8
MAX_TEXT_QUERY = 1024
COMPARISONS = ("$gt", "$gte", "$lt", "$lte")


@dataclass(frozen=True)
class Node:
    """op: and, or, not, geo, or a field operator; `value` holds the operand."""

    op: str
    field: str = ""
    value: object = None
    children: tuple[Node, ...] = ()


TRUE = Node("and")


def is_number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _scalar(x):
    if x is None or isinstance(x, (str, bool)):
        return x
    if is_number(x):
        if not math.isfinite(x):
            raise InvalidArgument("numbers in a filter must be finite")
        return x
    raise InvalidArgument("filter values must be scalars")


def _items(name: str, x) -> list:
    if not isinstance(x, (list, tuple)) or not x:
        raise InvalidArgument(f"{name} needs a non-empty array")
    return list(x)


def _object(name: str, x) -> dict:
    if not isinstance(x, dict):
        raise InvalidArgument(f"{name} needs an object")
    return x


def _geo(x) -> dict:
    spec = {"lat_field": "lat", "lon_field": "lon"} | _object("$geo_radius", x)
    if set(spec) != {"lat", "lon", "meters", "lat_field", "lon_field"}:
        raise InvalidArgument("$geo_radius takes lat, lon, meters, lat_field and lon_field")
    for name in ("lat_field", "lon_field"):
        if not isinstance(spec[name], str) or not spec[name] or spec[name][0] == "$":
            raise InvalidArgument(f"{name} must name a field")
    if not all(is_number(spec[n]) and math.isfinite(spec[n]) for n in ("lat", "lon", "meters")):
        raise InvalidArgument("lat, lon and meters must be finite numbers")
    if abs(spec["lat"]) > 90 or abs(spec["lon"]) > 180 or not 0 < spec["meters"] <= math.pi * EARTH_RADIUS:
        raise InvalidArgument("lat, lon or meters out of range")
    return spec


def _operand(op: str, x):
    if op in ("$in", "$nin"):
        return [_scalar(i) for i in _items(op, x)]
    if op == "$exists":
        if not isinstance(x, bool):
            raise InvalidArgument("$exists needs a boolean")
        return x
    if op == "$text":
        if not isinstance(x, str) or len(x.encode()) > MAX_TEXT_QUERY or not query_words(x):
            raise InvalidArgument(f"$text needs a string of at most {MAX_TEXT_QUERY} bytes with a word")
        return x
    if op in ("$eq", "$ne", *COMPARISONS):
        return _scalar(x)
    raise InvalidArgument(f"unknown operator {op!r}")


def parse(filter: Mapping | None) -> Node:
    """A filter as a tree; an empty one is true. Every fault is found here, before any plan."""
    if filter is None:
        return TRUE
    parts = []
    for key in sorted(_object("a filter", filter)):
        x = filter[key]
        if key in ("$and", "$or"):
            parts.append(Node(key[1:], children=tuple(parse(_object(key, i)) for i in _items(key, x))))
        elif key == "$not":
            parts.append(Node("not", children=(parse(_object(key, x)),)))
        elif key == "$geo_radius":
            parts.append(Node("geo", value=_geo(x)))
        elif not key or key[0] == "$":
            raise InvalidArgument(f"unknown operator {key!r}")
        elif isinstance(x, dict):
            if not x:
                raise InvalidArgument(f"{key} has no operator")
            parts += [Node(op, key, _operand(op, x[op])) for op in sorted(x)]
        else:
            parts.append(Node("$eq", key, _scalar(x)))
    return parts[0] if len(parts) == 1 else Node("and", children=tuple(parts))


class TypedMap:
    """Fields of a map from name to (kind, s, d, b, raw); kinds: n null, s string, b bool, d number, x no scalar."""

    def __init__(self, column: str = "metadata"):
        self.column = column

    def _entry(self, name: str) -> Column:
        return F.col(self.column)[name]

    def exists(self, name: str) -> Column:
        return F.coalesce(self._entry(name)["kind"] != "x", F.lit(False))

    def null(self, name: str) -> Column:
        return F.coalesce(self._entry(name)["kind"] == "n", F.lit(False))

    def get(self, name: str, kind: str) -> Column:
        """The field's value where it has the kind, else null."""
        entry = self._entry(name)
        return F.when(entry["kind"] == kind, entry[kind])


class NativeColumns:
    """Fields that are columns of one type; a null cell is a missing field."""

    def __init__(self, columns: Mapping[str, tuple[Column | str, str]]):
        self.columns = {n: (F.col(c) if isinstance(c, str) else c, k) for n, (c, k) in columns.items()}

    def exists(self, name: str) -> Column:
        return self.columns[name][0].isNotNull() if name in self.columns else F.lit(False)

    def null(self, name: str) -> Column:
        return F.lit(False)

    def get(self, name: str, kind: str) -> Column:
        if name in self.columns and self.columns[name][1] == kind:
            return self.columns[name][0]
        return F.lit(None).cast({"s": "string", "b": "boolean", "d": "double"}[kind])


def _kind(x) -> str:
    return "b" if isinstance(x, bool) else "d" if is_number(x) else "s"


def _known(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(fields, name: str, x, known: Callable = _known) -> Column:
    if x is None:
        return fields.null(name)
    return known(fields.get(name, _kind(x)) == F.lit(float(x) if _kind(x) == "d" else x))


def _among(fields, name: str, items: list, known: Callable = _known) -> Column:
    found = [fields.null(name)] if None in items else []
    for kind in "sbd":
        own = [float(i) if kind == "d" else i for i in items if i is not None and _kind(i) == kind]
        if own:
            found.append(known(fields.get(name, kind).isin(own)))
    return reduce(lambda a, b: a | b, found)


def _compared(fields, op: str, name: str, x, known: Callable = _known) -> Column:
    if x is None or isinstance(x, bool):
        return F.lit(False)
    cell, to = fields.get(name, _kind(x)), F.lit(float(x) if is_number(x) else x)
    return known({"$gt": cell > to, "$gte": cell >= to, "$lt": cell < to, "$lte": cell <= to}[op])


def haversine(lat: Column, lon: Column, to_lat: float, to_lon: float) -> Column:
    """Metres along the great circle."""
    half_lat, half_lon = F.radians(lat - F.lit(float(to_lat))) / 2, F.radians(lon - F.lit(float(to_lon))) / 2
    a = F.sin(half_lat) ** 2 + F.cos(F.radians(lat)) * math.cos(math.radians(to_lat)) * F.sin(half_lon) ** 2
    return 2 * EARTH_RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _near(fields, spec: dict, known: Callable = _known) -> Column:
    """A box on latitude first, as scans can use it; longitude too where the circle holds no pole or antimeridian."""
    lat, lon = fields.get(spec["lat_field"], "d"), fields.get(spec["lon_field"], "d")
    reach = math.degrees(spec["meters"] / EARTH_RADIUS) * (1 + 1e-9) + 1e-9
    low, high = spec["lat"] - reach, spec["lat"] + reach
    near = (lat >= low) & (lat <= high)
    if low > -90 and high < 90:
        ratio = math.sin(math.radians(min(reach, 90.0))) / math.cos(math.radians(spec["lat"]))
        if ratio < 1:
            side = math.degrees(math.asin(ratio)) * (1 + 1e-9) + 1e-9
            west, east = spec["lon"] - side, spec["lon"] + side
            if west >= -180 and east <= 180:
                near = near & (lon >= west) & (lon <= east)
    return known(near & (haversine(lat, lon, spec["lat"], spec["lon"]) <= F.lit(float(spec["meters"]))))


def _sure(c: Column) -> Column:
    """A comparison for a WHERE clause, where null is as good as false: left bare, so that the scan can take it over."""
    return c


def compile_node(node: Node, fields, exact: bool = True) -> Column:
    """A tree as a Column without nulls; if not `exact`, one that holds where the tree holds and is else false or null."""
    known = _known if exact else _sure
    join: dict[str, tuple[Callable, bool]] = {"and": (lambda a, b: a & b, True), "or": (lambda a, b: a | b, False)}
    if node.op in join:
        both, start = join[node.op]
        return reduce(both, [compile_node(c, fields, exact) for c in node.children]) if node.children else F.lit(start)
    if node.op == "not":
        return ~compile_node(node.children[0], fields, True)
    if node.op == "geo":
        return _near(fields, node.value, known)
    name, x = node.field, node.value
    if node.op == "$exists":
        return fields.exists(name) if x else ~fields.exists(name)
    if node.op == "$eq":
        return _equal(fields, name, x, known)
    if node.op == "$ne":
        return fields.exists(name) & ~_equal(fields, name, x, _known)
    if node.op == "$in":
        return _among(fields, name, x, known)
    if node.op == "$nin":
        return fields.exists(name) & ~_among(fields, name, x)
    if node.op == "$text":
        wanted = F.array(*[F.lit(w) for w in dict.fromkeys(query_words(x))])
        return known(F.size(F.array_except(wanted, words(fields.get(name, "s")))) == 0)
    return _compared(fields, node.op, name, x, known)


def where(filter: Mapping | None, fields=None, exact: bool = True) -> Column:
    """The Column of a JSON filter, over the `metadata` map unless other fields are given; see compile_node for `exact`."""
    return compile_node(parse(filter), fields or TypedMap(), exact)


def metadata_map(columns: Mapping[str, Column | str], kinds: Mapping[str, str]) -> Column:
    """Native columns as a typed map; null cells are left out."""
    null = {"s": F.lit(None).cast("string"), "d": F.lit(None).cast("double"), "b": F.lit(None).cast("boolean")}
    entries = []
    for name, c in columns.items():
        c = F.col(c) if isinstance(c, str) else c
        cells = null | {kinds[name]: c.cast({"s": "string", "d": "double", "b": "boolean"}[kinds[name]])}
        value = F.struct(F.lit(kinds[name]).alias("kind"), cells["s"].alias("s"), cells["d"].alias("d"), cells["b"].alias("b"), F.lit(None).cast("string").alias("raw"))
        entries.append(F.when(c.isNotNull(), F.struct(F.lit(name).alias("k"), value.alias("v"))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def metadata_of(values: Mapping | None) -> dict | None:
    """A Python metadata object as the typed map's cells."""
    import json

    if values is None:
        return None
    out = {}
    for name, x in values.items():
        cell = {"kind": "x", "s": None, "d": None, "b": None, "raw": None}
        if x is None:
            cell["kind"] = "n"
        elif isinstance(x, bool):
            cell |= {"kind": "b", "b": x}
        elif is_number(x):
            cell |= {"kind": "d", "d": float(x)}
        elif isinstance(x, str):
            cell |= {"kind": "s", "s": x}
        else:
            cell["raw"] = json.dumps(x)
        out[name] = cell
    return out
