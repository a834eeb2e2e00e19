"""Strict JSON reading over VARIANT, and JSON-Schema checks as Columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_strict(text: Column, closing: str = "}") -> Column:
    """VARIANT of ``text`` when it is exactly one JSON value, else NULL.

    ``closing`` is the character such a value ends with, ``}`` or ``]``.
    """
    return let(boxed(text), lambda box: unboxed(box, text, closing))


def boxed(text: Column) -> Column:
    """First half of :func:`parse_strict`: the text parsed inside two brackets.

    ``try_parse_json`` stops after the first complete value, so ``{"a":1} x``
    would pass. Inside brackets leftovers are malformed or a second element.
    """
    return F.try_parse_json(F.concat(F.lit("[["), text, F.lit("]]")))


def unboxed(box: Column, text: Column, closing: str = "}") -> Column:
    """Second half: the value if it is alone in its box.

    Only leftovers that begin with ``]]`` can close the brackets early. Texts
    with ``closing``, ``]``, ``]`` in a row get a second look inside an object,
    which such leftovers cannot close.
    """

    def at(path: str) -> Column:
        return F.try_variant_get(box, path, "variant")

    alone = at("$[1]").isNull() & at("$[0][1]").isNull()
    suspicious = text.rlike(rf"\{closing}\s*\]\s*\]")
    in_object = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}"))).isNotNull()
    return F.when(alone & (~suspicious | in_object), at("$[0][0]"))


def member(doc: Column, name: str) -> Column:
    """Member of a VARIANT object as VARIANT; NULL when absent (not when null)."""
    return F.try_variant_get(doc, f"$['{name}']", "variant")


def kind(value: Column) -> Column:
    """JSON kind of a VARIANT: STRING, VOID (null), BOOLEAN, ARRAY, OBJECT or a number type."""
    return F.substring_index(F.schema_of_variant(value), "<", 1)


def is_number(kind_name: Column) -> Column:
    return ~kind_name.isin("STRING", "VOID", "BOOLEAN", "ARRAY", "OBJECT")


_KIND_OF_TYPE = {"string": "STRING", "null": "VOID", "array": "ARRAY"}


def kinds(doc: Column, names: Sequence[str]) -> Column:
    """ARRAY<STRING> of the kinds of the members ``names``, NULL for absent ones."""
    return F.array(*[kind(member(doc, name)) for name in names])


def violations(
    found: Column, id_text: Column, types: Mapping[str, Sequence[str]], required: Sequence[str]
) -> Column:
    """Sorted ``field:rule`` strings of everything wrong with one JSON object.

    ``found`` are the :func:`kinds` of the fields of ``types``. Rules are
    ``required`` (absent), ``type`` (wrong kind) and ``empty`` for the id.
    """
    checks = [F.when(id_text == "", F.lit("id:empty"))]
    for position, (name, allowed) in enumerate(types.items()):
        own = F.get(found, F.lit(position))
        absent = F.lit(f"{name}:required") if name in required else F.lit(None)
        fits = own.isin(*[_KIND_OF_TYPE[t] for t in allowed])
        checks.append(F.when(own.isNull(), absent).when(~fits, F.lit(f"{name}:type")))
    return F.sort_array(F.array_compact(F.array(*checks)))
