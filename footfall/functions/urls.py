"""Request URLs: query pairs, form coding and the rewrites built on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import has_ink, none_if_empty


def path_of(url: Column) -> Column:
    """Path of an origin-form or absolute URL, without query and fragment."""
    bare = F.regexp_replace(url, r"\A(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", "")
    path = F.regexp_extract(bare, r"\A[^?#]*", 0)
    return F.when(path == "", "/").otherwise(path)


#: Characters that a path has only as escapes, and segments that stand for a folder.
_CODED = r"""[^\x21-\x7E]|["#<>?^`{}]"""
_DOTS = r"(?i)(?:\.|%2e)"


def _escaped(path: Column) -> Column:
    """Raw blanks, marks and characters outside ASCII as escapes of their UTF-8 bytes."""

    def one(char: Column) -> Column:
        return F.when(char.rlike(_CODED), F.replace(F.url_encode(char), F.lit("+"), F.lit("%20"))).otherwise(char)

    chars = F.regexp_extract_all(path, F.lit("(?s)."), F.lit(0))
    return F.when(path.rlike(_CODED), F.array_join(F.transform(chars, one), "")).otherwise(path)


def _folded(path: Column) -> Column:
    """The path without ``.`` and ``..``: a fold over the segments with those kept so far."""
    segments = F.split(F.substr(path, F.lit(2)), "/")
    up, here = rf"\A{_DOTS}{{2}}\z", rf"\A{_DOTS}\z"

    def step(kept: Column, segment: Column) -> Column:
        return (
            F.when(segment.rlike(up), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(segment.rlike(here), kept)
            .otherwise(F.array_append(kept, segment))
        )

    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    # A path that ends in dots ends in the folder that they stand for.
    folder = F.element_at(segments, -1).rlike(rf"\A{_DOTS}{{1,2}}\z")
    whole = F.concat(F.lit("/"), F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))
    return F.when(path.rlike(rf"/{_DOTS}{{1,2}}(?:/|\z)"), whole).otherwise(path)


def normal_path(path: Column) -> Column:
    """A path as URL parsers write it: slashes, escapes and dot segments settled."""
    return _folded(_escaped(F.translate(path, "\\", "/")))


def query_of(url: Column) -> Column:
    """Text between the first ``?`` and the fragment; empty if there is none."""
    return F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1)


def _where_coded(text: Column, decoded: Column) -> Column:
    """``decoded`` where the text has anything to decode."""
    return F.when(text.contains("%") | text.contains("+"), decoded).otherwise(text)


def form_decode(text: Column) -> Column:
    """Form decoding; a stray ``%`` stands for itself."""
    escaped = F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")
    return _where_coded(text, F.try_url_decode(escaped))


def lenient_decode(text: Column) -> Column:
    """Query-string decoding: text with any bad escape stays as it is, ``+`` aside."""
    decoded = F.coalesce(F.try_url_decode(text), F.translate(text, "+", " "))
    return _where_coded(text, decoded)


def query_pairs(query: Column, decode=form_decode) -> Column:
    """``array<struct<key, value>>`` in query order, empty pieces left out."""

    def pair(piece: Column) -> Column:
        key = F.substring_index(piece, "=", 1)
        value = F.substr(piece, F.length(key) + F.lit(2))
        return F.struct(decode(key).alias("key"), decode(value).alias("value"))

    return F.transform(F.filter(F.split(query, "&"), lambda piece: piece != ""), pair)


def write_pairs(pairs: Column) -> Column:
    """Form-encode pairs back into query text."""
    return F.array_join(
        F.transform(
            pairs, lambda p: F.concat(F.url_encode(p["key"]), F.lit("="), F.url_encode(p["value"]))
        ),
        "&",
    )


def first_value(pairs: Column, key: str) -> Column:
    """Value of the first pair with this key, NULL if there is none."""
    place = F.array_position(pairs["key"], key).cast("int") - F.lit(1)
    return F.get(pairs["value"], place)


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def grouped(pairs: Column) -> Column:
    """``array<struct<key, values>>``: values per key, keys in order of first appearance.

    The pairs are sorted by key and cut where the key changes, so a query string of
    very many keys costs a sort, not a comparison of every key with every other.
    """
    numbered = F.transform(
        pairs, lambda p, i: F.struct(p["key"].alias("key"), i.alias("place"), p["value"].alias("value"))
    )

    def cut(rows: Column) -> Column:
        def opening(row: Column, i: Column) -> Column:
            before = F.get(rows, i - F.lit(1))["key"]
            return F.when((i == 0) | (row["key"] != before), i)

        def groups(starts: Column) -> Column:
            def group(start: Column, number: Column) -> Column:
                end = F.coalesce(F.get(starts, number + F.lit(1)), F.size(rows))
                part = F.slice(rows, start + F.lit(1), end - start)
                first = F.get(rows, start)
                return F.struct(
                    first["place"].alias("place"), first["key"].alias("key"),
                    F.transform(part, lambda r: r["value"]).alias("values"),
                )

            return F.transform(starts, group)

        return _bound(F.array_compact(F.transform(rows, opening)), groups)

    ordered = F.array_sort(_bound(F.array_sort(numbered), cut))
    return F.transform(
        ordered, lambda g: F.struct(g["key"].alias("key"), g["values"].alias("values"))
    )


def without_keys(pairs: Column, *keys: str) -> Column:
    return F.filter(pairs, lambda p: ~p["key"].isin(*keys))


def with_query(path: Column, query: Column) -> Column:
    return F.when(query == "", path).otherwise(F.concat(path, F.lit("?"), query))


def split_signed_url(url: Column, pairs: Column) -> dict[str, Column]:
    """Signature, signing time, signed text and the URL without both parameters.

    ``pairs`` are the form-decoded query pairs of ``url``; pass a column that is
    already computed so that the URL is taken apart once.
    """
    path = normal_path(path_of(url))
    return {
        "hmac": none_if_empty(first_value(pairs, "hmac")),
        "t": none_if_empty(first_value(pairs, "t")),
        "validation_url": with_query(path, write_pairs(without_keys(pairs, "hmac"))),
        "cleaned_url": with_query(path, write_pairs(without_keys(pairs, "hmac", "t"))),
    }


def filter_query_params(url: Column) -> Column:
    """P10: keep only a non-blank ``token`` and ``name``, in that order."""
    pieces = F.split(url, r"\?")
    pairs = query_pairs(F.coalesce(F.get(pieces, F.lit(1)), F.lit("")))
    kept = [
        F.struct(F.lit(key).alias("key"), first_value(pairs, key).alias("value"))
        for key in ("token", "name")
    ]
    shown = F.filter(F.array(*kept), lambda p: p["value"].isNotNull() & has_ink(p["value"]))
    return with_query(F.get(pieces, F.lit(0)), write_pairs(shown))


def rewrite_forward_query(pairs: Column, drop_token: bool, wait: bool) -> Column:
    """Query text for the sink. Repeated keys become one, values comma-joined.

    ``drop_token`` is set when the sink has a token of its own; ``wait`` asks the
    sink to confirm writes.
    """
    groups = grouped(pairs)
    if drop_token:
        groups = without_keys(groups, "token")

    def merged(group: Column) -> Column:
        value = F.array_join(group["values"], ",")
        if wait:
            value = F.when(group["key"] == "wait", "true").otherwise(value)
        return F.struct(group["key"].alias("key"), value.alias("value"))

    kept = F.transform(groups, merged)
    if wait:
        asked = F.struct(F.lit("wait").alias("key"), F.lit("true").alias("value"))
        missing = F.array_position(pairs["key"], "wait") == 0
        kept = F.concat(kept, F.when(missing, F.array(asked)).otherwise(F.array().cast(
            "array<struct<key: string, value: string>>"
        )))
    return write_pairs(kept)
