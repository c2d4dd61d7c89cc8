"""Typed access to JSON documents, and ordered rule checks on their fields.

Validation depends on the JSON type of each field, which a plain ``from_json``
into strings would hide (the number 123 and the text "123" look alike). So a
document becomes a VARIANT, each object is opened once into a struct of VARIANT
members, and all members of interest are described by one array of

``type``  the JSON type, NULL if the field is absent
``text``  the text to use, NULL if the field has no usable text

Expressions per member are kept short: longer ones make generated methods that the
JVM does not compile.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import rules
from ..functions import text as fields


def parse_document(df: DataFrame, column: str, into: str) -> DataFrame:
    """Add a VARIANT column, NULL where the text is not exactly one JSON document.

    Spark's JSON reader stops after the first document and ignores what follows.
    The text is therefore parsed as the first element of an array whose second
    element is a hash of that text: whatever stands behind a first document either
    breaks the array or keeps the hash from being its second and last element.
    """
    mark = F.xxhash64(F.col(column))
    wrapped = F.concat(F.lit("["), F.col(column), F.lit(","), mark.cast("string"), F.lit("]"))
    packed = f"__{into}"
    whole = (F.try_variant_get(packed, "$[1]", "bigint") == mark) & F.try_variant_get(
        packed, "$[2]", "variant"
    ).isNull()
    return (
        df.withColumn(packed, F.try_parse_json(wrapped))
        .withColumn(into, F.when(whole, F.try_variant_get(packed, "$[0]", "variant")))
        .drop(packed)
    )


def open_object(variant: Column, path: str, names: list[str]) -> Column:
    """Struct with the named members of the object at ``path``, each still a VARIANT."""
    shape = ", ".join(f"`{name}`: variant" for name in names)
    return F.try_variant_get(variant, path, f"struct<{shape}>")


def _scalar_text(kind: Column, member: Column) -> Column:
    """Request coercion (V10) of a scalar: null to empty, numbers and booleans to text.

    Whole floating-point numbers are written without fraction or exponent.
    """
    plain = F.try_variant_get(member, "$", "string")
    number = F.try_variant_get(member, "$", "double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e18)
    return (
        F.when(kind == "VOID", "")
        .when((kind == "DOUBLE") & whole, number.cast("bigint").cast("string"))
        .when(kind.startswith("OBJECT<") | kind.startswith("ARRAY<"), None)
        .otherwise(plain)
    )


def _described(kind: Column, text: Column) -> Column:
    return F.struct(kind.alias("type"), text.alias("text"))


@dataclass(frozen=True)
class Member:
    """A member to describe; ``opened`` is its struct where it has been opened."""

    value: Column
    opened: Column | None = None

    def kind(self) -> Column:
        kind = F.schema_of_variant(self.value)
        if self.opened is None:
            return kind
        return F.when(self.opened.isNotNull(), "OBJECT<").otherwise(kind)


def describe_strict(members: list[Member]) -> Column:
    """Type and text of every member, in order; only JSON strings have a text."""

    def one(member: Member) -> Column:
        kind = member.kind()
        text = F.try_variant_get(member.value, "$", "string")
        return _described(kind, F.when(kind == "STRING", text))

    return F.array(*[one(member) for member in members])


def needs_care(document: Column) -> Column:
    """Whether a JSON text may hold arrays or numbers with an exponent."""
    return document.contains("[") | document.rlike(r":\s*-?[0-9][0-9.]*[eE]")


def kinds_of(members: list[Member]) -> Column:
    """The JSON types alone, in order."""
    return F.array(*[member.kind() for member in members])


def describe_coerced(members: list[Member], kinds: Column, care: Column) -> Column:
    """Type and text of every member, in order, with request coercion.

    Null becomes an empty text, numbers and booleans become their text and a
    one-element array stands for its element. Documents without arrays and
    exponents, nearly all, take a short way that compiles to small methods. ``kinds``
    are the types, as a column computed before.
    """

    def short(place: int, member: Member) -> Column:
        kind = F.get(kinds, F.lit(place))
        text = F.try_variant_get(member.value, "$", "string")
        return _described(kind, F.when(kind == "VOID", "").when(~kind.startswith("OBJECT<"), text))

    def careful(member: Column, kind: Column) -> Column:
        inner = F.try_variant_get(member, "$[0]", "variant")
        single = (
            kind.startswith("ARRAY<")
            & inner.isNotNull()
            & F.try_variant_get(member, "$[1]", "variant").isNull()
        )
        inner_kind = F.schema_of_variant(inner)
        return F.when(single, _described(inner_kind, _scalar_text(inner_kind, inner))).otherwise(
            _described(kind, _scalar_text(kind, member))
        )

    values = F.array(*[member.value for member in members])
    return F.when(care, F.zip_with(values, kinds, careful)).otherwise(
        F.array(*[short(place, member) for place, member in enumerate(members)])
    )


def rule_values(**values) -> str:
    return json.dumps(values, separators=(",", ":"))


@dataclass(frozen=True)
class Check:
    """One rule: what kind it is, where it applies, and when it is broken.

    ``params`` are the rule's own values as JSON. ``other`` says what else the member may
    be, ``null`` or ``undefined``: the rule is then one branch of a choice.
    """

    kind: str
    path: str
    member: int
    message: str | None
    broken: Column
    params: str = "{}"
    other: str = ""


class Members:
    """Builds the checks on members of one object.

    ``described`` is a column made by :func:`describe`; ``places`` says where in it
    each member is; ``path`` is the position of the object in the document. With
    ``coerce`` nulls have become texts, otherwise they are known by their type.
    """

    def __init__(self, described: str, places: dict[str, int], path: str, coerce: bool):
        self.described = described
        self.places = places
        self.path = path
        self.coerce = coerce

    def kind(self, name: str) -> Column:
        return F.get(F.col(self.described), F.lit(self.places[name]))["type"]

    def text(self, name: str) -> Column:
        return F.get(F.col(self.described), F.lit(self.places[name]))["text"]

    def object(self, kind: Column) -> list[Check]:
        holds = F.coalesce(kind.startswith("OBJECT<"), F.lit(False))
        params = rule_values(type="object")
        return [Check("object", self.path, -1, "must be object", ~holds, params)]

    def required(self, *names: str) -> list[Check]:
        return [
            Check(
                "required", self.path, -1, f"must have required property '{name}'",
                self.kind(name).isNull(), rule_values(missingProperty=name),
            )
            for name in names
        ]

    def _rule(self, kind: str, name: str, holds: Column, params: str = "{}") -> list[Check]:
        broken = ~F.coalesce(holds, F.lit(False))
        return [Check(kind, f"{self.path}/{name}", self.places[name], None, broken, params)]

    def string(self, name: str) -> list[Check]:
        return self._rule("string", name, self.text(name).isNotNull())

    def nonempty(self, name: str) -> list[Check]:
        return self._rule("nonempty", name, fields.is_nonempty(self.text(name)))

    def nonblank(self, name: str) -> list[Check]:
        return self._rule("nonblank", name, fields.is_nonblank(self.text(name)))

    def guid(self, name: str) -> list[Check]:
        return self._rule("guid", name, fields.is_guid(self.text(name)), rule_values(format="uuid"))

    def guid_or_undefined(self, name: str) -> list[Check]:
        holds = fields.is_guid_or_undefined(self.text(name))
        return either(self._rule("guid", name, holds, rule_values(format="uuid")), rules.UNDEFINED)

    def iso_millis(self, name: str) -> list[Check]:
        holds = fields.is_iso_millis(self.text(name))
        return self._rule("iso", name, holds, rule_values(format="date-time"))

    def constant(self, name: str, value: str) -> list[Check]:
        return self._rule("constant", name, self.text(name) == value, rule_values(allowedValue=value))

    def one_of(self, name: str, values: list[str]) -> list[Check]:
        holds = self.text(name).isin(*values)
        return self._rule("one_of", name, holds, rule_values(allowedValues=list(values)))

    def optional(self, name: str, checks: list[Check]) -> list[Check]:
        """The checks, unless the member is absent."""
        return when(self.kind(name).isNotNull(), checks)

    def nullable(self, name: str, checks: list[Check]) -> list[Check]:
        """The checks, unless the member is null (a coerced null has a text already)."""
        if self.coerce:
            return checks
        return when(~F.coalesce(self.kind(name) == "VOID", F.lit(False)), checks)


def when(condition: Column, checks: list[Check]) -> list[Check]:
    """The checks, applied only where the condition holds."""
    return [replace(c, broken=condition & c.broken) for c in checks]


def either(checks: list[Check], other: str) -> list[Check]:
    """The checks as a branch of a choice: the member may also be null or ``undefined``."""
    return [replace(c, other=other) for c in checks]


def first_broken(checks: list[Check]) -> Column:
    """Position of the first broken rule, counted from 0; NULL if all hold."""
    chain = F
    for position, check in enumerate(checks):
        chain = chain.when(check.broken, F.lit(position))
    return chain


def path_at(checks: list[Check], position: Column) -> Column:
    return F.get(F.array(*[F.lit(c.path) for c in checks]), position)


def message_at(
    checks: list[Check], position: Column, context: str, described: str
) -> Column:
    """What the rule at a position has to say about the member it is about."""

    def at(values: list) -> Column:
        return F.get(F.array(*[F.lit(value) for value in values]), position)

    # Rules about no member in particular have place -1, where there is nothing.
    text = F.get(F.col(described), at([c.member for c in checks]))["text"]
    kind = at([c.kind for c in checks])
    fixed = at([c.message or "" for c in checks])
    said = (
        F.when(fixed != "", fixed)
        .when(text.isNull(), "must be string")
        .when(
            kind.isin("nonempty", "nonblank") & (text == ""),
            "must NOT have fewer than 1 characters",
        )
        .when(kind == "nonblank", f"must match pattern \"{rules.NONBLANK_PATTERN}\"")
        .when(kind == "guid", 'must match format "uuid"')
        .when(kind == "iso", 'must match format "date-time"')
        .when(kind == "constant", "must be equal to constant")
        .otherwise("must be equal to one of the allowed values")
    )
    message = F.concat(F.lit(context), path_at(checks, position), F.lit(" "), said)
    return F.when(position.isNotNull(), message)


def failure(path: Column, keyword: Column | str, params: Column | str, message: Column | str) -> Column:
    """One entry of a list of failures; ``params`` is JSON."""

    def text(value: Column | str) -> Column:
        return F.lit(value) if isinstance(value, str) else value

    return F.struct(
        path.alias("instance_path"), text(keyword).alias("keyword"),
        text(params).alias("params"), text(message).alias("message"),
    )


def failures_at(checks: list[Check], position: Column, described: str) -> Column:
    """All that the rule at a position has to report, in order; NULL if all rules hold.

    A plain rule reports itself. A rule that is a branch of a choice is followed by the
    failure of the other branch and by that of the choice.
    """

    def at(values: list) -> Column:
        return F.get(F.array(*[F.lit(value) for value in values]), position)

    text = F.get(F.col(described), at([c.member for c in checks]))["text"]
    kind, params, other = (at([getattr(c, n) for c in checks]) for n in ("kind", "params", "other"))
    path = path_at(checks, position)
    too_short = kind.isin("nonempty", "nonblank") & (text == "")
    not_text = failure(path, "type", rule_values(type="string"), "must be string")
    itself = (
        F.when(kind.isin("object", "required"), failure(
            path, F.when(kind == "required", "required").otherwise("type"), params,
            at([c.message or "" for c in checks]),
        ))
        .when(text.isNull(), not_text)
        .when(too_short, failure(
            path, "minLength", rule_values(limit=1), "must NOT have fewer than 1 characters",
        ))
        .when(kind == "nonblank", failure(
            path, "pattern", rule_values(pattern=rules.NONBLANK_PATTERN),
            f'must match pattern "{rules.NONBLANK_PATTERN}"',
        ))
        .when(kind == "guid", failure(path, "format", params, 'must match format "uuid"'))
        .when(kind == "iso", failure(path, "format", params, 'must match format "date-time"'))
        .when(kind == "constant", failure(path, "const", params, "must be equal to constant"))
        .otherwise(failure(path, "enum", params, "must be equal to one of the allowed values"))
    )
    # The other branch wants null, or the text that stands for nothing.
    branch = (
        F.when(other == "null", failure(path, "type", rule_values(type="null"), "must be null"))
        .when((other == rules.UNDEFINED) & text.isNull(), not_text)
        .when(other == rules.UNDEFINED, failure(
            path, "const", rule_values(allowedValue=rules.UNDEFINED), "must be equal to constant",
        ))
    )
    choice = F.when(other != "", failure(path, "anyOf", "{}", "must match a schema in anyOf"))
    return F.when(position.isNotNull(), F.array_compact(F.array(itself, branch, choice)))
