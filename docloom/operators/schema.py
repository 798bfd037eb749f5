"""JSON Schemas compiled to expressions over parsed data, so that a document is validated where it is read.

A schema becomes one expression for the list of what a value breaks: properties are looked up, the members of arrays and
objects are visited by higher-order functions, and in-place applicators combine the lists of their parts. Nothing is
shuffled. A schema that refers to itself below its own place leaves the inner values for another round (Compiler.pending).
Which members a schema has evaluated is an expression of its own, made only where ``unevaluated*`` asks for it.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ERROR = "struct<pointer: string, keyword: string, message: string, value: variant>"
#: The keyword of values that wait for another round; the message is then the name of the schema to apply.
PENDING = "$pending"
#: Keywords that only describe.
ANNOTATIONS = frozenset("$id $schema $comment $anchor $defs $vocabulary definitions title description default examples deprecated readOnly writeOnly contentEncoding contentMediaType contentSchema".split())
KEYWORDS = frozenset(
    "$ref type enum const pattern format minimum maximum exclusiveMinimum exclusiveMaximum multipleOf minLength maxLength minItems maxItems uniqueItems items prefixItems additionalItems contains minContains maxContains "
    "required minProperties maxProperties properties patternProperties additionalProperties propertyNames dependentRequired dependentSchemas dependencies allOf anyOf oneOf not if then else unevaluatedProperties unevaluatedItems".split()
)
#: Those that look at an object's keys, and at an array's items.
MEMBERS = frozenset("required minProperties maxProperties patternProperties additionalProperties propertyNames dependentRequired dependentSchemas dependencies unevaluatedProperties".split())
ITEMS = frozenset("minItems maxItems uniqueItems items prefixItems additionalItems contains unevaluatedItems".split())
#: Formats as patterns; dates are also looked up in the calendar.
FORMATS = {
    "date": r"^\d{4}-\d\d-\d\d$",
    "date-time": r"^\d{4}-\d\d-\d\d[Tt]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)$",
    "duration": r"^P(?=\d|T\d)(\d+Y)?(\d+M)?(\d+W)?(\d+D)?(T(?=\d)(\d+H)?(\d+M)?(\d+S)?)?$",
    "email": r"^[^@\s]+@[^@\s]+\.[^@\s]+$",
    "hostname": r"^(?=.{1,253}$)[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?(\.[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?)*$",
    "ipv4": r"^((25[0-5]|2[0-4]\d|1?\d?\d)(\.(?!$)|$)){4}$",
    "json-pointer": r"^(/([^~/]|~[01])*)*$",
    "time": r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]\d\d:\d\d)?$",
    "uri": r"^[A-Za-z][A-Za-z0-9+.-]*:\S*$",
    "uri-reference": r"^[^\s\\<>^`{|}]*$",
    "uuid": r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
}


def nothing() -> Column:
    return F.expr(f"cast(array() as array<{ERROR}>)")


def error(at: Column, keyword: str, message: Column | str, value: Column | None = None) -> Column:
    told = F.lit(message) if isinstance(message, str) else message
    return F.struct(at.alias("pointer"), F.lit(keyword).alias("keyword"), told.alias("message"), (F.lit(None) if value is None else value).cast("variant").alias("value"))


def step(at: Column, key: Column | str) -> Column:
    """A pointer one step on."""
    if isinstance(key, str):
        return F.concat(at, F.lit("/" + key.replace("~", "~0").replace("/", "~1")))
    return F.concat(at, F.lit("/"), F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("\\", "\\\\").replace("'", "\\'") + "']", "variant")


def keys_of(v: Column) -> Column:
    return F.map_keys(F.try_variant_get(v, "$", "map<string, variant>"))


def items_of(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def indices(v: Column) -> Column:
    n = F.size(items_of(v))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def equals(v: Column, want: object) -> Column:
    """Whether a value is a given one; numbers are compared as such, and keys in any order."""
    kind = F.schema_of_variant(v)
    if isinstance(want, bool):
        return (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == want)
    if want is None:
        return kind == "VOID"
    if isinstance(want, int | float):
        return number(kind) & (F.try_variant_get(v, "$", "double") == float(want))
    if isinstance(want, str):
        return (kind == "STRING") & (F.try_variant_get(v, "$", "string") == want)
    no = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(want, list):
        return reduce(Column.__and__, (no(equals(F.get(items_of(v), i), x)) for i, x in enumerate(want)), kind.startswith("ARRAY") & (F.size(items_of(v)) == len(want)))
    return reduce(Column.__and__, (no(equals(member(v, k), x)) for k, x in want.items()), kind.startswith("OBJECT") & (F.size(keys_of(v)) == len(want)))


class Compiler:
    """Expressions for schemas (name to schema, a dict or a boolean); ``pending`` are the schemas that inner rounds apply."""

    def __init__(self, schemas: dict[str, dict | bool]):
        self.schemas = schemas
        self.ids = {s["$id"]: n for n, s in schemas.items() if isinstance(s, dict) and "$id" in s}
        self.pending: dict[str, tuple[object, str]] = {}

    def target(self, ref: str, base: str) -> tuple[object, str]:
        """The schema of a reference and the name of the document that holds it."""
        name, _, where = ref.partition("#")
        base = self.ids.get(name, name) or base
        if base not in self.schemas:
            raise ValueError(f"unknown schema {ref}")
        found = self.schemas[base]
        if where and not where.startswith("/"):
            found = next((s for s in _all(found) if s.get("$anchor") == where), None)
            if found is None:
                raise ValueError(f"unknown anchor {ref}")
            return found, base
        for part in where.split("/")[1:]:
            key = part.replace("~1", "/").replace("~0", "~")
            try:
                found = found[int(key)] if isinstance(found, list) else found[key]
            except (KeyError, IndexError, ValueError) as x:
                raise ValueError(f"unknown reference {ref}") from x
        return found, base

    def errors(self, name: str, v: Column, at: Column | None = None) -> Column:
        """What a value breaks of a schema by name, or of a pending one by its key."""
        schema, base = self.pending[name] if name in self.pending else (self.schemas[name], name)
        key = name if name in self.pending else f"{base}#"
        return self._errors(schema, v, F.lit("") if at is None else at, base, {key: True}, True)

    def valid(self, schema: object, v: Column, base: str) -> Column:
        return F.size(self._errors(schema, v, F.lit(""), base, {}, False)) == 0

    def _errors(self, schema: object, v: Column, at: Column, base: str, above: dict[str, bool], told: bool) -> Column:
        """The array of errors. above: schemas being compiled, True where the value is another one by now's place; told: whether errors count by themselves, so that they can come from a later round."""
        if schema is True or schema == {}:
            return nothing()
        if schema is False:
            return F.when(v.isNotNull(), F.array(error(at, "false schema", "must not be there"))).otherwise(nothing())
        if unknown := sorted(k for k in schema if k not in KEYWORDS and k not in ANNOTATIONS and not k.startswith("x-")):
            raise ValueError(f"unsupported keywords: {', '.join(unknown)}")
        if not set(schema) - ANNOTATIONS:
            return nothing()
        # what several keywords look at is made once
        held = {"v": v, "kind": F.schema_of_variant(v), "at": at}
        if MEMBERS & set(schema):
            held["members"] = F.try_variant_get(v, "$", "map<string, variant>")
        if ITEMS & set(schema):
            held["items"] = items_of(v)
        whole = F.struct(*(c.alias(n) for n, c in held.items()))
        return F.when(v.isNull(), nothing()).otherwise(let(whole, lambda s: self._of(schema, {n: s[n] for n in held}, base, above, told)))

    def _of(self, schema: dict, held: dict[str, Column], base: str, above: dict[str, bool], told: bool) -> Column:
        v, kind, at = held["v"], held["kind"], held["at"]
        tests: list[tuple[Column, Column]] = []
        lists: list[Column] = []
        add = lambda broken, keyword, message: tests.append((broken, error(at, keyword, message)))
        inside = dict.fromkeys(above, False)  # a member's place isn't its holder's
        here = lambda s: self._errors(s, v, at, base, above, told)
        below = lambda s, x, place: self._errors(s, x, place, base, inside, told)
        ok = lambda s, x=v: F.size(self._errors(s, x, F.lit(""), base, above if x is v else inside, False)) == 0
        is_text, is_number, is_array, is_object = kind == "STRING", number(kind), kind.startswith("ARRAY"), kind.startswith("OBJECT")
        text, value = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
        items, members = held.get("items"), held.get("members")
        keys = None if members is None else F.map_keys(members)

        if "$ref" in schema:
            s, b = self.target(schema["$ref"], base)
            key = f"{b}#{schema['$ref'].partition('#')[2]}"
            if key in above:
                if above[key] or not told:
                    raise ValueError(f"{schema['$ref']} refers to itself " + ("at one place" if above[key] else "inside a condition"))
                self.pending[key] = (s, b)
                lists.append(F.array(error(at, PENDING, key, v)))
            else:
                lists.append(self._errors(s, v, at, b, above | {key: True}, told))
        if "type" in schema:
            wanted = [schema["type"]] if isinstance(schema["type"], str) else schema["type"]
            types = {"string": is_text, "number": is_number, "integer": is_number & (value == F.floor(value)), "boolean": kind == "BOOLEAN", "null": kind == "VOID", "array": is_array, "object": is_object}
            add(~reduce(Column.__or__, (types[t] for t in wanted)), "type", f"must be {' or '.join(wanted)}")
        for word in ("enum", "const"):
            if word in schema:
                allowed = schema[word] if word == "enum" else [schema[word]]
                add(~reduce(Column.__or__, (F.coalesce(equals(v, x), F.lit(False)) for x in allowed), F.lit(False)), word, f"must be one of {json.dumps(allowed, ensure_ascii=False)}")
        if "pattern" in schema:
            add(is_text & ~text.rlike(schema["pattern"]), "pattern", f"must match {schema['pattern']}")
        if "format" in schema:
            fmt = schema["format"]
            if fmt not in FORMATS:
                raise ValueError(f"unsupported format {fmt}")
            sound = text.rlike(FORMATS[fmt])
            if fmt.startswith("date"):
                sound &= F.left(text, F.lit(10)).try_cast("date").isNotNull()
            add(is_text & ~sound, "format", f"must be a {fmt}")
        for word, broken in (("minimum", value.__lt__), ("maximum", value.__gt__), ("exclusiveMinimum", value.__le__), ("exclusiveMaximum", value.__ge__)):
            if word in schema:
                add(is_number & broken(schema[word]), word, f"must have {word} {schema[word]}")
        if "multipleOf" in schema:
            ratio = value / F.lit(float(schema["multipleOf"]))
            add(is_number & (F.abs(ratio - F.round(ratio)) > 1e-9), "multipleOf", f"must be a multiple of {schema['multipleOf']}")
        sizes = {"Length": (is_text, lambda: F.char_length(text)), "Items": (is_array, lambda: F.size(items)), "Properties": (is_object, lambda: F.size(members))}
        for what, (applies, size) in sizes.items():
            if f"min{what}" in schema:
                add(applies & (size() < schema[f"min{what}"]), f"min{what}", f"must have min{what} {schema[f'min{what}']}")
            if f"max{what}" in schema:
                add(applies & (size() > schema[f"max{what}"]), f"max{what}", f"must have max{what} {schema[f'max{what}']}")

        if schema.get("uniqueItems"):
            add(is_array & (F.size(F.array_distinct(F.transform(items, lambda x: F.to_json(x)))) < F.size(items)), "uniqueItems", "must not repeat an item")  # noqa: PLW0108
        prefix, rest = schema.get("prefixItems", []), schema.get("items")
        if isinstance(rest, list):  # as before the year 2020
            prefix, rest = rest, schema.get("additionalItems")
        for i, s in enumerate(prefix):
            lists.append(F.when(is_array, below(s, F.get(items, F.lit(i)), step(at, str(i)))))
        if rest is not None:
            tail = F.slice(items, F.lit(len(prefix) + 1), F.greatest(F.size(items), F.lit(1)))
            lists.append(F.when(is_array, F.flatten(F.transform(tail, lambda x, i: below(rest, x, step(at, (i + len(prefix)).cast("string")))))))
        if "contains" in schema:
            n = F.size(F.filter(items, lambda x: ok(schema["contains"], x)))
            least, most = schema.get("minContains", 1), schema.get("maxContains")
            add(is_array & ((n < least) | (F.lit(False) if most is None else n > most)), "contains", f"must hold {least} or more" + (f", {most} at most" if most is not None else ""))

        for k in schema.get("required", []):
            add(is_object & ~F.array_contains(keys, k), "required", f"must have {k}")
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        for k, s in own.items():
            lists.append(F.when(is_object, below(s, member(v, k), step(at, k))))
        for p, s in patterns.items():
            lists.append(self._members(members, is_object, lambda k, p=p: k.rlike(p), lambda k, x, s=s: below(s, x, step(at, k))))
        if "additionalProperties" in schema:
            s = schema["additionalProperties"]
            if s is False:
                extra = F.filter(keys, lambda k: self._others(k, own, patterns))
                add(is_object & (F.size(extra) > 0), "additionalProperties", F.concat(F.lit("must not have "), F.array_join(F.array_sort(extra), ", ")))
            else:
                lists.append(self._members(members, is_object, lambda k: self._others(k, own, patterns), lambda k, x: below(s, x, step(at, k))))
        if "propertyNames" in schema:
            named = F.transform(keys, lambda k: F.when(~ok(schema["propertyNames"], _text(k)), error(at, "propertyNames", F.concat(F.lit("must not have the name "), k))))
            lists.append(F.when(is_object, F.array_compact(named)))
        needs = dict(schema.get("dependentRequired", {})) | {k: x for k, x in schema.get("dependencies", {}).items() if isinstance(x, list)}
        for k, names in needs.items():
            for n in names:
                add(is_object & F.array_contains(keys, k) & ~F.array_contains(keys, n), "dependentRequired", f"must have {n} with {k}")
        depends = dict(schema.get("dependentSchemas", {})) | {k: x for k, x in schema.get("dependencies", {}).items() if not isinstance(x, list)}
        for k, s in depends.items():
            lists.append(F.when(is_object & F.array_contains(keys, k), here(s)))

        lists += [here(s) for s in schema.get("allOf", [])]
        for word, least, most in (("anyOf", 1, None), ("oneOf", 1, 1)):
            if word in schema:
                n = reduce(Column.__add__, (F.when(ok(s), 1).otherwise(0) for s in schema[word]))
                add((n < least) | (F.lit(False) if most is None else n > most), word, f"must match {'one' if most else 'any'} of the schemas")
        if "not" in schema:
            add(ok(schema["not"]), "not", "must not match the schema")
        if "if" in schema:
            lists.append(F.when(ok(schema["if"]), here(schema.get("then", True))).otherwise(here(schema.get("else", True))))

        if "unevaluatedProperties" in schema:
            seen, s = self._keys({k: x for k, x in schema.items() if k != "unevaluatedProperties"}, v, base), schema["unevaluatedProperties"]
            if s is False:
                extra = F.array_except(keys, seen)
                add(is_object & (F.size(extra) > 0), "unevaluatedProperties", F.concat(F.lit("must not have "), F.array_join(F.array_sort(extra), ", ")))
            else:
                lists.append(self._members(members, is_object, lambda k: ~F.array_contains(seen, k), lambda k, x: below(s, x, step(at, k))))
        if "unevaluatedItems" in schema:
            seen, s = self._indices({k: x for k, x in schema.items() if k != "unevaluatedItems"}, v, base), schema["unevaluatedItems"]
            left = F.array_except(indices(v), seen)
            if s is False:
                add(is_array & (F.size(left) > 0), "unevaluatedItems", F.concat(F.lit("must not have items "), F.array_join(left.cast("array<string>"), ", ")))
            else:
                lists.append(F.when(is_array, F.flatten(F.transform(left, lambda i: below(s, F.get(items, i), step(at, i.cast("string")))))))

        if tests:
            lists.insert(0, F.array_compact(F.array(*(F.when(F.coalesce(b, F.lit(False)), e) for b, e in tests))))
        return F.concat(*(F.coalesce(x, nothing()) for x in lists)) if lists else nothing()

    def _members(self, members: Column, applies: Column, which: Callable, of: Callable) -> Column:
        """The errors of an object's members of some keys."""
        return F.when(applies, F.flatten(F.transform(F.filter(F.map_entries(members), lambda e: which(e["key"])), lambda e: of(e["key"], e["value"]))))

    @staticmethod
    def _others(k: Column, own: dict, patterns: dict) -> Column:
        named = k.isin(*own) if own else F.lit(False)
        return ~reduce(Column.__or__, (k.rlike(p) for p in patterns), named)

    def _parts(self, schema: dict, v: Column, base: str) -> list[tuple[Column | None, object, str]]:
        """The in-place parts of a schema: when they count (None: always), and what they are."""
        out: list[tuple[Column | None, object, str]] = []
        if "$ref" in schema:
            out.append((None, *self.target(schema["$ref"], base)))
        out += [(None, s, base) for s in schema.get("allOf", [])]
        out += [(self.valid(s, v, base), s, base) for w in ("anyOf", "oneOf") for s in schema.get(w, [])]
        if "if" in schema:
            holds = self.valid(schema["if"], v, base)
            out += [(holds, schema["if"], base), (holds, schema.get("then", True), base), (~holds, schema.get("else", True), base)]
        out += [(F.array_contains(keys_of(v), k), s, base) for k, s in schema.get("dependentSchemas", {}).items()]
        return out

    def _keys(self, schema: object, v: Column, base: str) -> Column:
        """The keys of v that a schema and its parts have evaluated."""
        none = F.expr("cast(array() as array<string>)")
        if not isinstance(schema, dict):
            return none
        keys = keys_of(v)
        if "additionalProperties" in schema or "unevaluatedProperties" in schema:
            return F.coalesce(keys, none)
        own, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
        out = F.coalesce(F.filter(keys, lambda k: ~self._others(k, own, patterns)), none)
        for when, s, b in self._parts(schema, v, base):
            more = self._keys(s, v, b)
            out = F.array_union(out, more if when is None else F.when(when, more).otherwise(none))
        return out

    def _indices(self, schema: object, v: Column, base: str) -> Column:
        """The places of v's items that a schema and its parts have evaluated."""
        none = F.expr("cast(array() as array<int>)")
        if not isinstance(schema, dict):
            return none
        if "unevaluatedItems" in schema or isinstance(schema.get("items"), dict | bool):
            return indices(v)
        prefix = schema.get("prefixItems", schema.get("items") or [])
        if isinstance(schema.get("items"), list) and "additionalItems" in schema:
            return indices(v)
        out = F.filter(indices(v), lambda i: i < len(prefix))
        if "contains" in schema:
            out = F.array_union(out, F.filter(indices(v), lambda i: self.valid(schema["contains"], F.get(items_of(v), i), base)))
        for when, s, b in self._parts(schema, v, base):
            more = self._indices(s, v, b)
            out = F.array_union(out, more if when is None else F.when(when, more).otherwise(none))
        return out


def _text(k: Column) -> Column:
    """A text as a parsed JSON value."""
    return k.cast("variant")


def _all(schema: object):
    """All schemas inside a schema, itself first."""
    if isinstance(schema, dict):
        yield schema
        for x in schema.values():
            yield from _all(x)
    elif isinstance(schema, list):
        for x in schema:
            yield from _all(x)
