"""URL rules as a sort-merge range join.

A host's labels are reversed and each is followed by a separator below every other
character, so a host and its subdomains are one interval of keys. Urls are dealt to
ranges of keys, rules to every range that their interval meets. One sweep over a sorted
range keeps the stack of rules whose interval is open; of those whose path also fits,
the longest rule wins (the longer host among equally long ones).

Null urls and urls without ``://`` have an empty host and path and get the default.
Repeated rows are judged each; a url that fills many rows is dealt to all ranges that
its key spans. An empty table gives an empty result. A rule without a slash fits any path.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import partitions, per_batch

SEPARATOR = "\x01"
AFTER = "\x02"
#: Keys that place the bounds of the ranges; they decide how even the ranges are, no result.
SPLIT_KEYS = 4096
DEFAULT = "allow"


def rules_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """``rule`` (host, then path from the first slash) and ``verdict`` rows."""
    return spark.createDataFrame(rules, "rule string, verdict string")


def lowered(text: Column) -> Column:
    """A-Z in lower case and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = lowered(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels from the last to the first, each closed by the separator."""
    labels = F.reverse(F.split(host, r"\."))
    return F.when(host == "", "").otherwise(F.concat(F.array_join(labels, SEPARATOR), F.lit(SEPARATOR)))


def _bounds(urls: DataFrame, ranges: int) -> list[str]:
    """Keys between the ranges, from the keys whose hashes are smallest."""
    drawn = urls.select("_key", F.xxhash64("_key", "page_id", "_url").alias("_draw"))
    keys = sorted(row["_key"] for row in drawn.orderBy("_draw").limit(SPLIT_KEYS).collect())
    return [keys[len(keys) * i // ranges] for i in range(1, ranges)] if keys else []


def _dealing(bounds: list[str]):
    """Adds to each url the range that it belongs to; equal bounds share their key's rows."""

    def make():
        def work(batch: pa.RecordBatch):
            keys, salts = batch.column("_key").to_pylist(), batch.column("_salt").to_pylist()
            low = [bisect_left(bounds, k) for k in keys]
            high = [bisect_right(bounds, k) for k in keys]
            part = [a + s % (b - a + 1) for a, b, s in zip(low, high, salts, strict=True)]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "_salt"]
            names = [name for name in batch.schema.names if name != "_salt"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(part, pa.int32())], [*names, "_part"])

        return work

    return make


def _wins(rule: tuple[str, str, str], best: tuple[str, str, str] | None) -> bool:
    return best is None or (len(rule[0]), len(rule[0].split("/", 1)[0])) >= (
        len(best[0]), len(best[0].split("/", 1)[0]),
    )


def sweep(batches: Iterator[pa.RecordBatch], default: str = DEFAULT) -> Iterator[pa.RecordBatch]:
    """Judges rows sorted by range and key, a key's rules before its urls."""
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []  # (key, rules of that host)
    part = None
    for batch in batches:
        columns = {name: batch.column(name).to_pylist() for name in ("_part", "_key", "_path", "_rule", "_verdict")}
        is_url, rules, verdicts = [], [], []
        for p, key, path, rule, verdict in zip(*columns.values(), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                if not stack or stack[-1][0] != key:
                    stack.append((key, []))
                stack[-1][1].append((rule, path, verdict))
                is_url.append(False)
                continue
            best = None
            if key:
                for _, own in stack:
                    for one in own:
                        if path.startswith(one[1]) and _wins(one, best):
                            best = one
            is_url.append(True)
            rules.append(best[0] if best else None)
            verdicts.append(best[2] if best else default)
        mask = pa.array(is_url)
        own = [batch.column(name).filter(mask) for name in ("page_id", "_host", "_path")]
        yield pa.RecordBatch.from_arrays(
            [*own, pa.array(rules, pa.string()), pa.array(verdicts, pa.string())],
            ["page_id", "host", "path", "rule", "verdict"],
        )


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``page_id``, ``host``, ``path``, the winning ``rule`` and the ``verdict`` of every url.

    Among rules with the same text the one with the greatest verdict counts.
    """
    spark = pages.sparkSession
    ranges = partitions(spark)
    host, path = url_parts(F.col("_url"))
    urls = pages.select("page_id", F.col("url").alias("_url")).select(
        "page_id", "_url", host.alias("_host"), path.alias("_path")
    ).withColumn("_key", host_key(F.col("_host")))
    bounds = _bounds(urls, ranges)
    id_type = urls.schema["page_id"].dataType

    text = T.StringType()
    columns = [("page_id", id_type), ("_host", text), ("_path", text), ("_key", text)]
    dealt = urls.select(
        *[name for name, _ in columns],
        F.pmod(F.xxhash64("page_id", "_url"), F.lit(1 << 30)).cast("int").alias("_salt"),
    ).mapInArrow(
        per_batch(_dealing(bounds)),
        T.StructType([T.StructField(*c) for c in columns] + [T.StructField("_part", T.IntegerType())]),
    ).withColumns({"_rule": F.lit(None).cast("string"), "_verdict": F.lit(None).cast("string")})

    # A rule's interval: from its host's key up to the same key with the last separator raised.
    clean = rules.filter(F.col("rule").isNotNull() & F.col("verdict").isNotNull())
    rule_host = lowered(F.substring_index("rule", "/", 1))
    own = clean.groupBy("rule").agg(F.max("verdict").alias("_verdict")).select(
        F.lit(None).cast(id_type).alias("page_id"), rule_host.alias("_host"),
        F.col("rule").substr(F.length(rule_host) + 1, F.length("rule")).alias("_path"),
        host_key(rule_host).alias("_key"), F.col("rule").alias("_rule"), "_verdict",
    ).filter("_key != ''")
    parts = _parts_of(own, bounds)
    both = dealt.unionByName(parts)
    swept = both.repartitionByRange(ranges, "_part").sortWithinPartitions(
        "_part", "_key", F.col("_rule").isNull(), "_rule"
    )
    schema = T.StructType(
        [T.StructField("page_id", id_type)]
        + [T.StructField(name, text) for name in ("host", "path", "rule", "verdict")]
    )
    return swept.mapInArrow(lambda batches: sweep(batches, default), schema)


def _parts_of(rules: DataFrame, bounds: list[str]) -> DataFrame:
    """Each rule once for every range that its interval meets."""

    def make():
        def work(batch: pa.RecordBatch):
            keys = batch.column("_key").to_pylist()
            low = np.array([bisect_left(bounds, k) for k in keys], dtype=np.int64)
            high = np.array([bisect_right(bounds, k[:-1] + AFTER) for k in keys], dtype=np.int64)
            rows = np.repeat(np.arange(len(keys)), high - low + 1)
            ends = np.cumsum(high - low + 1)
            part = np.arange(len(rows)) - np.repeat(ends - (high - low + 1), high - low + 1) + low[rows]
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(part.astype(np.int32))], [*taken.schema.names, "_part"]
            )

        return work

    schema = T.StructType([*rules.schema.fields, T.StructField("_part", T.IntegerType())])
    return rules.mapInArrow(per_batch(make), schema)
