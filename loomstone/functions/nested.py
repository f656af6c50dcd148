"""Reading and updating nested values: paths through structs, arrays and maps, JSON pointers, and errors gathered per cell.

A path is a list of steps: a field name, ``each()`` for all elements, ``at(i)`` for one, ``matching(p)`` for those that
satisfy a predicate, ``key(k)`` for a map's value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Update = Callable[[Column], Column]


@dataclass(frozen=True)
class Step:
    kind: str
    value: Any = None


def each() -> Step:
    return Step("each")


def at(i: int) -> Step:
    return Step("at", i)


def matching(p: Callable[[Column], Column]) -> Step:
    return Step("matching", p)


def key(k: str) -> Step:
    return Step("key", k)


Path = Sequence[str | Step]


def modify(c: Column, path: Path, f: Update) -> Column:
    """``c`` with ``f`` applied at all places that the path leads to; the rest stays as it is."""
    if not path:
        return f(c)
    step, rest = path[0], path[1:]
    inner = lambda x: modify(x, rest, f)
    if isinstance(step, str):
        return c.withField(step, inner(c.getField(step)))
    if step.kind == "each":
        return F.transform(c, inner)
    if step.kind == "at":
        return F.transform(c, lambda x, i: F.when(i == step.value, inner(x)).otherwise(x))
    if step.kind == "matching":
        return F.transform(c, lambda x: F.when(step.value(x), inner(x)).otherwise(x))
    return F.transform_values(c, lambda k, v: F.when(k == step.value, inner(v)).otherwise(v))


def assign(c: Column, updates: Sequence[tuple[Path, Column | Any]]) -> Column:
    """``c`` with several places set, one after the other."""
    for path, value in updates:
        new = value if isinstance(value, Column) else F.lit(value)
        c = modify(c, path, _constant(new))
    return c


def _constant(new: Column) -> Update:
    return lambda _: new


def get(c: Column, path: Path) -> Column:
    """What the path leads to; ``each`` and ``matching`` give arrays."""
    for n, step in enumerate(path):
        if isinstance(step, str):
            c = c.getField(step)
        elif step.kind == "at":
            c = F.get(c, F.lit(step.value))
        elif step.kind == "key":
            c = F.try_element_at(c, F.lit(step.value))
        else:
            elements = c if step.kind == "each" else F.filter(c, step.value)
            rest = path[n + 1 :]
            return F.transform(elements, lambda x: get(x, rest))
    return c


# JSON


def pointer_path(pointer: str) -> str:
    """A JSON pointer (``/a/0/b~1c``) as a JSON path."""
    out = "$"
    for part in pointer.split("/")[1:] if pointer else []:
        part = part.replace("~1", "/").replace("~0", "~")
        out += f"[{part}]" if part.isdigit() else "['" + part.replace("'", "\\'") + "']"
    return out


def json_at(s: Column, pointer: str) -> Column:
    """The text at a pointer into JSON text, or null."""
    return F.get_json_object(s, pointer_path(pointer))


def variant_at(v: Column, pointer: str, kind: str) -> Column:
    """The value at a pointer into a VARIANT, or null where it is absent or not of the kind."""
    return F.try_variant_get(v, pointer_path(pointer), kind)


def by_kind(s: Column, cases: dict[str, str], tag: str = "kind") -> Column:
    """A struct with a field per case, of which the one is set that ``tag`` names; ``cases`` maps tags to schemas."""
    kind = F.get_json_object(s, f"$.{tag}")
    return F.struct(kind.alias(tag), *[F.when(kind == k, F.from_json(s, schema)).alias(k) for k, schema in cases.items()])


def pretty(c: Column) -> Column:
    return F.to_json(c, {"pretty": "true"})


def merge_patch(m: Column, patch: Column) -> Column:
    """A string map after a patch: null values remove keys, others set them."""
    joined = F.map_zip_with(m, patch, lambda k, x, y: F.struct(x.alias("x"), y.alias("y"), F.map_contains_key(patch, k).alias("set")))
    kept = F.map_filter(joined, lambda k, v: ~v["set"] | v["y"].isNotNull())
    return F.transform_values(kept, lambda k, v: F.coalesce(v["y"], v["x"]))


_JSON_TYPES = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
_JSON_FORMATS = {"date-time": T.TimestampType(), "date": T.DateType()}


def from_json_schema(schema: dict) -> T.DataType:
    """The Spark type that a JSON Schema describes; what is not required is nullable."""
    kind = schema.get("type", "string")
    if kind == "object":
        needed = set(schema.get("required", []))
        return T.StructType([T.StructField(k, from_json_schema(v), k not in needed) for k, v in schema.get("properties", {}).items()])
    if kind == "array":
        return T.ArrayType(from_json_schema(schema.get("items", {})))
    if kind == "string" and schema.get("format") in _JSON_FORMATS:
        return _JSON_FORMATS[schema["format"]]
    return _JSON_TYPES[kind]


def to_json_schema(t: T.DataType) -> dict:
    """The JSON Schema of a Spark type."""
    if isinstance(t, T.StructType):
        properties = {f.name: to_json_schema(f.dataType) for f in t.fields}
        return {"type": "object", "properties": properties, "required": [f.name for f in t.fields if not f.nullable]}
    if isinstance(t, T.ArrayType):
        return {"type": "array", "items": to_json_schema(t.elementType)}
    for name, kind in _JSON_FORMATS.items():
        if t == kind:
            return {"type": "string", "format": name}
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return {"type": "integer"}
    if isinstance(t, T.NumericType):
        return {"type": "number"}
    return {"type": "boolean"} if t == T.BooleanType() else {"type": "string"}


# Patterns of the string formats of JSON Schema.
_FORMAT_PATTERNS = {
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "uuid": r"^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "time": r"^\d{2}:\d{2}:\d{2}",
    "duration": r"^P(?!$)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?$",
}


def schema_errors(s: Column, schema: dict, pointer: str = "") -> list[Column]:
    """For each constraint of a JSON Schema on the JSON text ``s``: the pointer and what is wrong, or null."""
    kind, out = schema.get("type", "string"), []
    text = json_at(s, pointer) if pointer else s
    name = pointer or "/"
    flag = lambda bad, why: out.append(F.when(bad, F.lit(f"{name}: {why}")))
    if kind == "object":
        for field, inner in schema.get("properties", {}).items():
            place = f"{pointer}/{field.replace('~', '~0').replace('/', '~1')}"
            if field in schema.get("required", []):
                out.append(F.when(text.isNotNull() & json_at(s, place).isNull(), F.lit(f"{place}: missing")))
            out += schema_errors(s, inner, place)
        return out
    present = text.isNotNull()
    if kind == "integer":
        flag(present & ~text.rlike(r"^-?\d+$"), "not an integer")
    elif kind == "number":
        flag(present & text.try_cast("double").isNull(), "not a number")
    elif kind == "boolean":
        flag(present & ~text.isin("true", "false"), "not a boolean")
    number = text.try_cast("double")
    if "minimum" in schema:
        flag(present & (number < schema["minimum"]), "too small")
    if "maximum" in schema:
        flag(present & (number > schema["maximum"]), "too large")
    if "minLength" in schema:
        flag(present & (F.length(text) < schema["minLength"]), "too short")
    if "maxLength" in schema:
        flag(present & (F.length(text) > schema["maxLength"]), "too long")
    if "pattern" in schema:
        flag(present & ~text.rlike(schema["pattern"]), "does not match")
    if "enum" in schema:
        flag(present & ~text.isin(*map(str, schema["enum"])), "not among the values")
    if schema.get("format") in _FORMAT_PATTERNS:
        flag(present & ~text.rlike(_FORMAT_PATTERNS[schema["format"]]), f"not a {schema['format']}")
    return out


def gathered(errors: Sequence[Column]) -> Column:
    """All errors of a row in one array; empty where there is none."""
    if not errors:
        return F.array().cast("array<string>")
    return F.filter(F.array(*errors), lambda e: e.isNotNull())


def verify(s: Column, schema: dict) -> Column:
    """All that is wrong with JSON text under a schema."""
    bad = F.when(F.try_parse_json(s).isNull(), F.array(F.lit("/: not JSON")))
    return F.coalesce(bad, gathered(schema_errors(s, schema)))


# Flattening records over flat columns


def flat_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """The leaf columns that a nested record spans, in order, named by their path."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        out += flat_columns(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def flatten_record(schema: T.StructType, prefix: str = "") -> list[Column]:
    """The leaf columns of a DataFrame with this schema, named by their path with underscores."""
    return [F.col(f"{prefix}{name}").alias(name.replace(".", "_")) for name, _ in flat_columns(schema)]


def nest_record(schema: T.StructType, columns: Sequence[Column]) -> list[Column]:
    """The nested columns of a record from as many flat ones as it spans."""
    left = list(columns)

    def build(t: T.StructType) -> list[Column]:
        return [(F.struct(*build(f.dataType)) if isinstance(f.dataType, T.StructType) else left.pop(0).try_cast(f.dataType)).alias(f.name) for f in t.fields]

    return build(schema)


# Absence


def or_(c: Column, default: Any) -> Column:
    return F.coalesce(c, default if isinstance(default, Column) else F.lit(default))


def lay(c: Column, absent: Column, present: Callable[[Column], Column]) -> Column:
    """``present`` of the value, or ``absent``."""
    return F.when(c.isNull(), absent).otherwise(present(c))


# XML


def xml_at(s: Column, path: str, kind: str = "string") -> Column:
    """What an XPath leads to: string, number, boolean or nodes (an array of texts); null where the text is no XML."""
    by = {"string": F.xpath_string, "number": F.xpath_double, "boolean": F.xpath_boolean, "nodes": F.xpath}
    return by[kind](s, F.lit(path))


def xml_struct(s: Column, schema: str, **options: str) -> Column:
    """XML text as a struct; attributes are fields that begin with an underscore unless ``attributePrefix`` says otherwise."""
    return F.from_xml(s, schema, options)


def to_xml(c: Column, row_tag: str = "ROW") -> Column:
    return F.to_xml(c, {"rowTag": row_tag})


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts have one value: the order of keys and trailing zeros do not matter; null where one is no JSON."""
    return F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b))


def json_kind(s: Column) -> Column:
    """``object``, ``array``, ``string``, ``number``, ``boolean`` or ``null``; null where the text is no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(s))
    return (
        F.when(kind.startswith("OBJECT"), "object")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "VOID", "null")
        .when(kind.isNotNull(), "number")
    )
