"""The stored ledger: versions of it as snapshots, and the import of a batch as a merge that can be repeated.

A version is a manifest, a small file that names a snapshot: two Parquet tables, ledger and imports. A writer writes the snapshot first and
names it last, in one step that fails if another writer was faster; one that dies before leaves the last version as it was, and an
orphan that `vacuum` removes. Readers take the newest manifest, so no reader sees half a version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import drop_stored, stored
from ..operators import app_legs as A
from ..operators import classifiers as C
from ..operators import duplicates as D
from ..operators import ledger_ops as L
from ..operators import pairing as P
from ..operators import receipts as R
from ..operators import registry as G
from ..operators import venue_repairs as V
from ..operators import views as W
from ..operators.identity import deduplicated, novel_rows
from ..sources.testdata import LEDGER, conform

IMPORTS = "import_id string, kind string, label string, chain string, address string, imported_at timestamp, data_start timestamp, data_end timestamp, n_rows long"
Rewrite = Callable[[DataFrame], DataFrame]


class Overtaken(RuntimeError):
    """Another writer committed a version since this one read the ledger."""


class LedgerStore:
    """A ledger under a path that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(conf)
        self._files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    def _text(self, path) -> str:
        f = self._fs.open(path)
        try:
            return bytes(f.readAllBytes()).decode()
        finally:
            f.close()

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("manifests") if n.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version holds; the newest if none is given, null for an empty store."""
        have = self.versions()
        if version is None and not have:
            return None
        if version is not None and version not in have:
            raise KeyError(f"no version {version}")
        return json.loads(self._text(self._at("manifests", f"{version or have[-1]:012d}.json")))

    def _table(self, name: str, schema: str, version: int | None) -> DataFrame:
        m = self.manifest(version)
        return self.spark.createDataFrame([], schema) if m is None else self.spark.read.schema(schema).parquet(f"{self.path}/snapshots/{m['snapshot']}/{name}")

    def read(self, version: int | None = None) -> DataFrame:
        return self._table("ledger", LEDGER, version)

    def imports(self, version: int | None = None) -> DataFrame:
        return self._table("imports", IMPORTS, version)

    def load(self) -> DataFrame:
        """The newest ledger as it is worked with: copies and dust are left out, however they got in."""
        return deduplicated(self.read()).where(~L.is_dust())

    def commit(self, ledger: DataFrame, imports: DataFrame, base: int | None, note: str = "") -> int:
        """Writes a version on top of `base` (null: an empty store) and returns its number."""
        return self._commit(self._draft(ledger)[0], imports, base, note)

    def _draft(self, ledger: DataFrame) -> tuple[str, DataFrame]:
        """Writes a ledger as a snapshot that no version names yet; its name, and its rows."""
        snapshot = uuid.uuid4().hex
        conform(ledger).write.parquet(f"{self.path}/snapshots/{snapshot}/ledger")
        return snapshot, self.spark.read.schema(LEDGER).parquet(f"{self.path}/snapshots/{snapshot}/ledger")

    def _discard(self, snapshot: str) -> None:
        self._fs.delete(self._at("snapshots", snapshot), True)

    def _commit(self, snapshot: str, imports: DataFrame, base: int | None, note: str) -> int:
        imports.write.parquet(f"{self.path}/snapshots/{snapshot}/imports")
        return self._name(snapshot, base, note)

    def _name(self, snapshot: str, base: int | None, note: str) -> int:
        if (self.versions() or [None])[-1] != base:
            raise Overtaken(f"version {base} is not the newest any more")
        n = (base or 0) + 1
        draft = self._at("drafts", f"{snapshot}-{n}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps({"version": n, "snapshot": snapshot, "note": note}).encode()))
        out.close()
        self._fs.mkdirs(self._at("manifests"))
        never = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(draft, self._at("manifests", f"{n:012d}.json"), never)  # fails if the name is taken
        except Exception as e:
            if n in self.versions():
                raise Overtaken(f"version {n} was written by another writer") from e
            raise
        return n

    def restore(self, version: int) -> int:
        """An earlier version as the newest; its snapshot is named again, not copied."""
        return self._name(self.manifest(version)["snapshot"], self.versions()[-1], f"version {version} again")

    def vacuum(self, keep: int = 5, older_than_ms: int = 24 * 3600 * 1000) -> int:
        """Forgets all but the last `keep` versions and deletes snapshots that no version names, unless they are so young that a writer may
        still be at them; returns how many."""
        for v in self.versions()[:-keep]:
            self._fs.delete(self._at("manifests", f"{v:012d}.json"), False)
        named = {self.manifest(v)["snapshot"] for v in self.versions()}
        now, gone = self._jvm.java.lang.System.currentTimeMillis(), 0
        for name in self._names("snapshots"):
            at = self._at("snapshots", name)
            if name not in named and now - self._fs.getFileStatus(at).getModificationTime() >= older_than_ms:
                gone += self._fs.delete(at, True)
        return gone

    def keep_upload(self, import_id: str, path: str) -> str:
        """Copies an uploaded file beside the ledger, under its import; returns where it lies."""
        source = self._jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        to = self._at("uploads", import_id, source.getName())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(source.getFileSystem(conf), source, self._fs, to, False, True, conf)
        return to.toString()


def standard_rewrites(tokens: DataFrame | None = None) -> list[Rewrite]:
    """What an import runs over the merged ledger, in order; each leaves a ledger as it is that it has already been over."""
    every: list[Rewrite] = [
        W.with_on_chain_ids, W.repaired_groups, C.income, V.venue_repairs, V.stable_quotes, lambda x: D.without(x, D.swap_legs(x)), R.liquid_staking, C.vaults, C.lending, C.disguised_swaps, C.margin_collateral, A.missing_legs,
        D.collapse_exchange_noise, C.timezone_copies, lambda x: P.annotate(x, P.internal_transfers(x)), lambda x: x.where(~L.is_spam(F.col("asset"))), lambda x: x.where(~L.is_dust()),
    ]
    if tokens is not None:
        every.append(lambda x: G.renamed_fragments(x, tokens).drop("renamed"))
    return every


def fingerprint(ledger: DataFrame) -> tuple[int, int]:
    """Number of rows and a sum of their hashes: equal for equal rows in any order."""
    n, h = ledger.agg(F.count("*"), F.sum(F.xxhash64(*[c for c in ledger.columns if c != "seq"]).cast("decimal(38,0)"))).first()
    return n, int(h or 0)


def settled(ledger: DataFrame, rewrites: Sequence[Rewrite], passes: int = 6) -> DataFrame:
    """The ledger after the rewrites, passed over it until a pass changes nothing; two passes are the least, for a rewrite may open what an
    earlier one closes. Raises if it doesn't settle. A table that `stored` gave; `ledger` is read several times: cut it if it is dear."""
    now, before = conform(ledger), None
    for n in range(passes):
        x = now
        for r in rewrites:
            x = r(x)
        x = conform(x)
        # A pass that changes nothing isn't written.
        if n and fingerprint(x) == before:
            return now
        old, now = now, stored(x)
        before = fingerprint(now)
        if n:
            drop_stored(old)
    raise RuntimeError(f"not settled after {passes} passes")


@dataclass
class Imported:
    version: int | None
    added: int
    skipped: int
    total: int


def import_batch(
    store: LedgerStore, batch: DataFrame, import_id: str, rewrites: Sequence[Rewrite], kind: str = "csv", label: str = "", chain: str | None = None, address: str | None = None, replace: bool = False, demo: DataFrame | None = None
) -> Imported:
    """Merges parsed rows into the stored ledger and settles it.

    The ledger is taken as `load` gives it. Rows that it knows by id, content or on-chain leg are skipped; so the same file twice changes nothing, and writes no version. `demo`: rows
    that go as soon as real ones come. `replace` starts from an empty ledger. If another writer commits meanwhile, `Overtaken` is raised, and
    nothing is changed: import again.
    """
    base = (store.versions() or [None])[-1]
    present = store.read().limit(0) if replace else store.load()
    real = present if demo is None else W.without_demo(present, demo)
    sent = stored(W.tagged(conform(batch), import_id, label or None))
    rows = stored(deduplicated(sent))
    drop_stored(sent)
    novel = stored(novel_rows(rows, real))
    n, added = rows.count(), novel.count()
    drop_stored(rows)
    if not added and not replace:
        drop_stored(novel)
        return Imported(base, 0, n, present.count())
    whole = settled(real.unionByName(novel), rewrites)
    snapshot, merged = store._draft(deduplicated(whole))
    drop_stored(whole)
    if not replace and fingerprint(merged) == fingerprint(present):
        store._discard(snapshot)
        drop_stored(novel)
        return Imported(base, 0, n, present.count())
    span = novel.agg(F.min("timestamp").alias("data_start"), F.max("timestamp").alias("data_end"), F.count("*").alias("n_rows"))
    entry = span.select(F.lit(import_id).alias("import_id"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), F.lit(chain).cast("string").alias("chain"), F.lit(address).cast("string").alias("address"), F.current_timestamp().alias("imported_at"), "data_start", "data_end", "n_rows")
    earlier = store.imports().limit(0) if replace else store.imports().where(F.col("import_id") != import_id)
    # Imports of which no row is left are forgotten.
    imports = earlier.unionByName(entry).join(merged.select("import_id").distinct(), "import_id", "left_semi").coalesce(1)
    version, total = store._commit(snapshot, imports, base, f"import {import_id}"), merged.count()
    drop_stored(novel)
    return Imported(version, added, n - added, total)


def disconnect(store: LedgerStore, import_id: str) -> Imported:
    """A version without the rows of one import, and without its entry."""
    base = (store.versions() or [None])[-1]
    present = store.read()
    kept = present.where(F.col("import_id").isNull() | (F.col("import_id") != import_id))
    total, n = present.count(), kept.count()
    return Imported(store.commit(kept, store.imports().where(F.col("import_id") != import_id).coalesce(1), base, f"disconnect {import_id}"), 0, total - n, n)


def recovered_imports(ledger: DataFrame, imports: DataFrame) -> DataFrame:
    """Entries for imports that rows name and the list lacks: a wallet if any source is a chain, with the chain that most rows have."""
    lost = ledger.where("import_id is not null").join(imports.select("import_id"), "import_id", "left_anti")
    by_source = lost.groupBy("import_id", F.lower("source").alias("source")).agg(F.count("*").alias("n"), F.min("timestamp").alias("a"), F.max("timestamp").alias("b"))
    chain = F.when(F.col("source").isin("solana", "ethereum", "bitcoin", "cardano", "celestia"), F.struct("n", "source"))
    g = by_source.groupBy("import_id").agg(F.max(chain).alias("c"), F.max(F.struct("n", "source")).alias("m"), F.min("a").alias("data_start"), F.max("b").alias("data_end"), F.sum("n").alias("n_rows"))
    wallet = F.col("c").isNotNull()
    name = F.initcap(F.translate(F.coalesce("c.source", "m.source", F.lit("")), "_", " "))
    return g.select("import_id", F.when(wallet, "wallet").otherwise("csv").alias("kind"), F.concat(name, F.when(wallet, " wallet (recovered)").otherwise(" import (recovered)")).alias("label"), F.col("c.source").alias("chain"), F.lit(None).cast("string").alias("address"), F.col("data_end").alias("imported_at"), "data_start", "data_end", "n_rows")
