"""The salt table on shared storage (S5) and the operations that change it (K2, K5-K8).

A log of numbered entries says which folders are the table: the last entry counts, and
what no entry names was never stored. Data is written first, then the next entry is
created, whole and only if no other caller has created it; whoever comes second reads the
table again and decides anew. So of callers that miss the same key one stores its salt
and all others get that one, an insert that was refused has added nothing, and nothing is
lost to a deletion that ran beside it. The store needs a file system whose rename refuses
a target that exists (HDFS does; local ones are linked instead).

New salts are added to the table's folders; deletions write the survivors as a new version.
Older versions are removed at once, as outdated salts must not stay readable; beside jobs
that still read, ``cleanup`` can leave the version before to a later ``purge``.
"""

from __future__ import annotations

import json
import os
import secrets
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import saltkeys
from ..operators import salts as ops
from ..schemas import SALTS
from ..session import workspace

LOG = "_log"


@dataclass(frozen=True)
class Entry:
    """An entry of the log: its number, the table's version and the folders that hold it."""

    number: int = 0
    version: int = 0
    folders: tuple[str, ...] = ()


class SaltStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    # --- log --------------------------------------------------------------------

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _names(self, folder: str) -> list[str]:
        fs, root = self._hadoop(folder)
        return [status.getPath().getName() for status in fs.listStatus(root)] if fs.exists(root) else []

    def _all_versions(self) -> list[int]:
        return sorted(int(name[2:]) for name in self._names(self.path) if name.startswith("v="))

    def current(self) -> Entry:
        """The last entry; number 0 for a store that was never written."""
        numbers = [name for name in self._names(f"{self.path}/{LOG}") if name.isdigit()]
        if not numbers:
            return Entry()
        fs, target = self._hadoop(f"{self.path}/{LOG}/{max(numbers)}")
        stream = fs.open(target)
        try:
            said = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()
        return Entry(int(max(numbers)), said["version"], tuple(said["folders"]))

    def current_version(self) -> int | None:
        """The table's version, None for a store that was never written."""
        return self.current().version or None

    def _commit(self, entry: Entry) -> bool:
        """Create the entry, whole; False if another caller has created that number."""
        text = json.dumps({"version": entry.version, "folders": entry.folders}).encode()
        draft = f"{self.path}/{LOG}/.{uuid.uuid4().hex}"
        fs, target = self._hadoop(f"{self.path}/{LOG}/{entry.number:012d}")
        _, source = self._hadoop(draft)
        stream = fs.create(source, False)
        stream.write(bytearray(text))
        stream.close()
        try:
            if fs.getUri().getScheme() != "file":
                return fs.rename(source, target)
            # A local rename would replace the target; a link does not.
            os.link(source.toUri().getPath(), target.toUri().getPath())
            return True
        except FileExistsError:
            return False
        finally:
            fs.delete(source, False)

    def _change(self, make: Callable[[Entry], tuple[DataFrame, bool] | None]) -> Entry:
        """Store what ``make`` derives from the table; again, from the new table, if another came first.

        ``make`` returns salts and whether they are the whole table, or None to change nothing.
        """
        while True:
            before = self.current()
            made = make(before)
            if made is None:
                return before
            salts, whole = made
            number = before.number + 1
            version = before.version + 1 if whole or not before.version else before.version
            folder = f"v={version}/c={number:012d}-{uuid.uuid4().hex}"
            # One file per day where days are small, several where they are not.
            salts.select(*ops.COLUMNS).hint("rebalance", F.col("salt_date")).write.partitionBy("salt_date").parquet(
                f"{self.path}/{folder}"
            )
            after = Entry(number, version, (folder,) if whole else (*before.folders, folder))
            if self._commit(after):
                return after
            self._remove_folder(f"{self.path}/{folder}")

    # --- table ------------------------------------------------------------------

    def load(self, days: list[date] | None = None) -> DataFrame:
        """The stored salts, one for each key; a store that does not exist yet is empty.

        With ``days`` only salts of those days (and of keys without a day) are read.
        Unreadable files fail the job: reading them as empty would give every visitor
        of the day a second identity.
        """
        return self._read(self.current(), days)

    def _read(self, entry: Entry, days: list[date] | None = None) -> DataFrame:
        if not entry.folders:
            return self.spark.createDataFrame([], SALTS)
        paths = [f"{self.path}/{folder}" for folder in entry.folders]
        stored = self.spark.read.schema(SALTS).option("basePath", self.path).parquet(*paths)
        if "c" not in stored.columns:  # no folder holds a row
            return self.spark.createDataFrame([], SALTS)
        if days is not None:
            stored = stored.filter(F.col("salt_date").isin(days) | F.col("salt_date").isNull())
        # Folders are named by their entry's number: what was stored first counts.
        return ops.one_per_key(stored, first=["c"])

    def append(self, salts: DataFrame) -> None:
        """Add salts; those of keys that are there already do not count."""
        self._change(lambda _: (salts, False))

    def replace(self, salts: DataFrame, keep_previous: bool = False) -> None:
        """Make ``salts`` the table; with ``keep_previous`` the old one stays until ``purge``."""
        self._replace(lambda _: salts, keep_previous)

    def _replace(self, make: Callable[[Entry], DataFrame | None], keep_previous: bool = False) -> None:
        seen: list[Entry] = []

        def whole(before: Entry) -> tuple[DataFrame, bool] | None:
            seen.append(before)
            made = make(before)
            return None if made is None else (made, True)

        after = self._change(whole)
        if after != seen[-1]:
            kept = seen[-1].version if keep_previous else after.version
            self._remove([v for v in self._all_versions() if v < after.version and v != kept])

    def purge(self) -> None:
        """Remove all versions but the table: outdated salts must not stay readable."""
        current = self.current().version
        self._remove([v for v in self._all_versions() if v < current])

    def _remove(self, versions: list[int]) -> None:
        for version in versions:
            self._remove_folder(f"{self.path}/v={version}")

    # --- keyed operations -------------------------------------------------------

    def get_or_create(self, wanted: DataFrame, created_at: Column | None = None) -> DataFrame:
        """K2: the table after giving every wanted key a salt; existing salts stay.

        New salts are written before anyone joins with them, so a recomputed task
        cannot see a different one. The wanted keys are written once: what they derive
        from is neither planned nor run again. Only salts of wanted days are returned.
        """
        if created_at is None:
            created_at = F.current_timestamp()
        path = workspace(self.spark, "wanted-keys")
        wanted.select("key").distinct().write.parquet(path)
        keys = self.spark.read.schema("key string").parquet(path)
        dated = keys.select(saltkeys.key_date(F.col("key")).alias("day")).distinct()
        days = [row["day"] for row in dated.collect() if row["day"] is not None]
        secret = self.spark.createDataFrame([(secrets.token_hex(32),)], "secret string")

        def created(before: Entry) -> tuple[DataFrame, bool] | None:
            missing = ops.missing_salts(keys, self._read(before, days))
            return None if missing.isEmpty() else (ops.create_salts(missing, secret, created_at), False)

        stored = self._read(self._change(created), days)
        self._remove_folder(path)
        return stored

    def _remove_folder(self, path: str) -> None:
        fs, folder = self._hadoop(path)
        fs.delete(folder, True)

    def insert(self, new: DataFrame) -> None:
        """K5: add records, or fail with ``SaltExists`` and add none."""
        self._change(lambda before: (ops.checked_insert(new, self._read(before)), False))

    def delete(self, keys: DataFrame) -> None:
        """K6: remove the salts of the given keys."""
        self._replace(lambda before: ops.without_keys(self._read(before), keys))

    def clear(self) -> None:
        """K7: remove all salts."""
        self.replace(self.spark.createDataFrame([], SALTS))

    def cleanup(self, now: Column | None = None, keep_previous: bool = False) -> int:
        """K8: remove salts created before today (UTC) and return how many."""
        moment = F.current_timestamp() if now is None else now
        deleted = 0

        def surviving(before: Entry) -> DataFrame | None:
            nonlocal deleted
            salts = self._read(before)
            deleted = ops.count_outdated(salts, moment).first()["deleted_count"]
            return ops.surviving(salts, moment) if deleted else None

        self._replace(surviving, keep_previous)
        return deleted
