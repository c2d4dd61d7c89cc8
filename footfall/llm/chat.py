"""Chat formatting with typed content parts.

A turn becomes ``<|turn|>role<|says|>content<|end|>``. Its content is a list of parts,
visited in order: an image, audio or document part leaves a placeholder ``<|image|>`` and
is recorded with its reference, its place and the tokens that a model expands it to; the
text parts between two of them are one text, which is escaped as a whole. A turn without
parts is its ``text`` as one text part.

Texts cannot forge control strings: between the first character and the rest of a
control string a backslash is added (also where backslashes stand there already), which
``unescaped`` takes out again; all other text stays as it is.

Null texts and roles are empty, null parts leave nothing, empty parts stand for the text.
Turns are ordered by ``turn`` (null first), then role, then content; repeated rows stay.
Every turn is formatted alone, so a conversation of any length never meets in one row; a
very long text costs a few times its length in memory. Other columns are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import partitions

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
#: Control strings of this template and of the common ones, without their first character.
_REST = r"(\|[A-Za-z_]+\|>|/?s>|/?INST\])"
ESCAPE = r"([<\[])(\\*)" + _REST
UNESCAPE = r"([<\[])\\(\\*)" + _REST

#: Tokens that parts expand to: image tiles, seconds of audio, pages of a document.
TILE, TILE_TOKENS, AUDIO_TOKENS, PAGE_TOKENS = 336, 144, 25, 512

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
ATTACHED = ("image", "audio", "document")


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ESCAPE, r"$1\\$2$3")


def unescaped(text: str) -> str:
    return re.sub(UNESCAPE, r"\1\2\3", text)


def part_tokens(part: Column) -> Column:
    """Tokens that an attached part expands to; missing sizes count as one unit."""
    unit = lambda value, size: F.greatest(F.ceil(F.coalesce(value, F.lit(1)) / size), F.lit(1))
    return (
        F.when(part["kind"] == "image", unit(part["width"], TILE) * unit(part["height"], TILE) * TILE_TOKENS)
        .when(part["kind"] == "audio", unit(part["seconds"], 1) * AUDIO_TOKENS)
        .when(part["kind"] == "document", unit(part["pages"], 1) * PAGE_TOKENS)
        .otherwise(0)
        .cast("long")
    )


def visited(parts: Column) -> Column:
    """What the parts leave in the formatted text; a part of unknown kind counts as text."""
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("text"))

    def visit(held: Column, part: Column) -> Column:
        attached = F.coalesce(part["kind"].isin(*ATTACHED), F.lit(False))
        mark = F.concat(held["done"], escaped(held["text"]), F.lit("<|"), part["kind"], F.lit("|>"))
        return F.struct(
            F.when(attached, mark).otherwise(held["done"]).alias("done"),
            F.when(attached, "").otherwise(F.concat(held["text"], F.coalesce(part["text"], F.lit("")))).alias("text"),
        )

    return F.aggregate(parts, start, visit, lambda held: F.concat(held["done"], escaped(held["text"])))


def format_turns(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, to be read in the order of ``conv_id``, ``turn``, ``formatted``.

    ``loss_start`` and ``loss_length`` span the code points of ``formatted`` that are
    trained on (length 0: none); ``attachments`` holds kind, ref, number within the turn
    and tokens; ``attached_tokens`` is their sum. ``turns`` has ``conv_id``, ``turn``,
    ``role``, ``text`` and may have ``parts`` (an array of ``PART``).
    """
    given = F.col("parts").cast(f"array<{PART}>") if "parts" in turns.columns else F.lit(None).cast(f"array<{PART}>")
    given = F.filter(given, lambda p: p.isNotNull())
    missing = [("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")]
    whole = F.array(F.struct(
        F.lit("text").alias("kind"), F.col("text").cast("string").alias("text"),
        *(F.lit(None).cast(kind).alias(name) for name, kind in missing),
    ))
    own = turns.select(
        "conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.when(F.size(given) > 0, given).otherwise(whole).alias("parts"),
    )
    content = visited(F.col("parts"))
    attached = F.filter("parts", lambda p: p["kind"].isin(*ATTACHED))
    records = F.transform(
        attached,
        lambda p, i: F.struct(
            p["kind"].alias("kind"), p["ref"].alias("ref"), i.alias("number"), part_tokens(p).alias("tokens")
        ),
    )
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS))
    formatted = own.withColumns({"_head": head, "_content": content, "attachments": records})
    trained = F.col("role").isin(*loss_roles)
    return formatted.select(
        "conv_id", "turn", F.concat("_head", "_content", F.lit(CLOSE)).alias("formatted"),
        F.length("_head").cast("long").alias("loss_start"),
        F.when(trained, F.length("_content")).otherwise(0).cast("long").alias("loss_length"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda sum_, a: sum_ + a["tokens"]).alias("attached_tokens"),
    )


_TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(SAYS) + "(.*)" + re.escape(CLOSE), re.DOTALL)


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and content of a formatted turn, placeholders left in."""
    found = _TURN.fullmatch(formatted)
    return unescaped(found[1]), unescaped(found[2])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads conversations back, turn by turn; holds no more than one turn and two hashes."""
    conv, state = None, None

    def done():
        return [conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    for batch in batches:
        rows = []
        columns = [batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_length")]
        for conv_id, formatted, start, length in zip(*columns, strict=True):
            if state is None or conv_id != conv:
                if state is not None:
                    rows.append(done())
                conv, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = read_turn(formatted)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            trained = unescaped(formatted[start : start + length])
            state[2] += len(trained)
            state[3].update(trained.encode())
            state[4] += len(formatted)
        yield _digest_rows(rows, kind := batch.schema.field("conv_id").type)
    if state is not None:
        yield _digest_rows([done()], kind)


def _digest_rows(rows: list[list], kind: pa.DataType) -> pa.RecordBatch:
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    kinds = (kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from its formatted turns."""
    schema = T.StructType([
        formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType()),
    ])
    own = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_length")
    return (
        own.repartition(partitions(formatted.sparkSession), "conv_id")
        .sortWithinPartitions("conv_id", "turn", "formatted")
        .mapInArrow(_digests, schema)
    )
