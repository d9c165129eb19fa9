"""Product codes of vectors by Lloyd's rounds that maintain their sums from changes only.

Vectors are cut into equal parts, and each part position has a codebook of at most `entries` integer entries, which is broadcast:
its size is set by parameters and the vectors' length. The rounds keep a table of the parts with their last assignments and, on the driver,
the running integer sum and count of each entry. A round assigns the parts anew where they lie; a part whose entry changed adds
itself to the new entry and takes itself from the old one. These contributions are summed in each task, so a shuffle carries at
most one row for each entry from a task, and none once assignments settle. The table of the round is written with the
contributions in one commit: a task that runs twice counts once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, drop_stored, stored, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Components beyond this are held to it, so that distances fit 64 bits.
LARGEST = 1 << 26
#: Below this, products of integers are exact in doubles.
EXACT = float(1 << 52)
BLOCK = 4096


@dataclass
class Codebooks:
    """Entries (part, entry, width), and the running sums and counts of what is assigned to them."""

    entries: np.ndarray
    sums: np.ndarray
    counts: np.ndarray

    def moved(self) -> Codebooks:
        """Every entry at the floor of its parts' mean; unused entries stay."""
        used = self.counts > 0
        mean = self.sums // np.maximum(self.counts, 1)[:, :, None]
        return Codebooks(np.where(used[:, :, None], mean, self.entries), self.sums, self.counts)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of each row (ties to the lower one) and its squared distance, in exact integers."""
    largest = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    small = 4.0 * x.shape[1] * float(largest) ** 2 < EXACT
    kind = np.float64 if small else np.int64
    e = entries.astype(kind)
    norms = (e * e).sum(1)
    code, error = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for at in range(0, len(x), BLOCK):
        b = x[at : at + BLOCK].astype(kind)
        d = norms - 2 * (b @ e.T)
        i = d.argmin(1)
        code[at : at + BLOCK] = i
        error[at : at + BLOCK] = ((b - e[i]) ** 2).sum(1).astype(np.int64)
    return code, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _ints(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32), pa.array(rows.ravel(), kind.value_type))


STATE = "vec_id long, label string, parts array<int>, codes array<int>"
DELTA = "part int, entry int, n long, total array<long>"
_DELTA_KIND = pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])
_LIST = pa.list_(pa.int32())


def _round(entries: np.ndarray):
    """Rows of the state with new assignments, then the task's contributions; columns of the other kind are null."""
    n_parts, size, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
        touched = np.zeros(entries.shape[:2], bool)
        names = ["vec_id", "label", "parts", "codes", "delta"]
        for x in batches:
            if not x.num_rows:
                continue
            v = _matrix(x.column("parts"), n_parts * width).astype(np.int64).reshape(-1, n_parts, width)
            old = _matrix(x.column("codes"), n_parts).astype(np.int64)
            new = np.empty_like(old)
            for p in range(n_parts):
                new[:, p], _ = nearest(v[:, p], entries[p])
                at = np.flatnonzero(new[:, p] != old[:, p])
                gone = at[old[at, p] >= 0]
                for rows, code, sign in ((at, new, 1), (gone, old, -1)):
                    np.add.at(sums[p], code[rows, p], sign * v[rows, p])
                    np.add.at(counts[p], code[rows, p], sign)
                    touched[p, code[rows, p]] = True
            yield pa.RecordBatch.from_arrays([x.column("vec_id"), x.column("label"), _ints(v.reshape(len(v), -1), _LIST), _ints(new, _LIST), pa.nulls(x.num_rows, _DELTA_KIND)], names)
        part, entry = np.nonzero(touched)
        if len(part):
            rows = [{"part": int(p), "entry": int(c), "n": int(counts[p, c]), "total": sums[p, c].tolist()} for p, c in zip(part, entry, strict=True)]
            none = [pa.nulls(len(rows), t) for t in (pa.int64(), pa.string(), _LIST, _LIST)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(rows, _DELTA_KIND)], names)

    return run


def _contributions(step: DataFrame, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Summed contributions of all tasks: at most one row for each entry of a codebook reaches the driver."""
    d = step.where("delta is not null").select("delta.*")
    total = F.array(*[F.sum(F.col("total")[i]) for i in range(shape[2])]).alias("total")
    sums, counts = np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64)
    for r in d.groupBy("part", "entry").agg(F.sum("n").alias("n"), total).toArrow().to_pylist():
        sums[r["part"], r["entry"]], counts[r["part"], r["entry"]] = r["total"], r["n"]
    return sums, counts


def _final(entries: np.ndarray):
    n_parts, _, width = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            v = _matrix(x.column("parts"), n_parts * width).astype(np.int64).reshape(-1, n_parts, width)
            found = [nearest(v[:, p], entries[p]) for p in range(n_parts)]
            code = np.stack([c for c, _ in found], 1).astype(np.uint8 if entries.shape[1] <= 256 else ">u2")
            text = [row.tobytes().hex() for row in code]
            error = np.sum([e for _, e in found], 0)
            yield pa.RecordBatch.from_arrays([x.column("vec_id"), x.column("label"), pa.array(text, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return run


def integer_vectors(rows: DataFrame, n_parts: int = PARTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of each component of the rows whose vector has components, all of them finite, in a
    number that `n_parts` divides; components beyond 2^26 are held to it."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    lost = F.lit(float("inf"))
    sound = v.isNotNull() & (F.size(v) > 0) & (F.size(v) % n_parts == 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < lost))
    whole = F.transform(v, lambda x: F.least(F.greatest(F.floor(F.least(F.greatest(x, F.lit(-1e9)), F.lit(1e9)) * scale), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    return rows.where(sound).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("string").alias("label"), whole.alias("v"))


def compress(
    rows: DataFrame, n_parts: int = PARTS, n_entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> tuple[DataFrame, Codebooks]:
    """(vec_id, label, code, error) of each kept row, and the codebooks.

    Left out are rows whose vector is null, empty, holds null or non-finite components, or has another length than the kept row of
    least id (then least vector), which has to be a multiple of `n_parts`. Codebooks start at the rows of least ids, null ids last, ties by
    vector, repeated rows each; fewer rows than entries give as many entries. Repeated and null ids are rows of their own. Without
    a row the result is empty. Labels are returned as strings. Other columns are ignored whatever their names.
    """
    if not 0 < n_entries <= 1 << 16:
        raise ValueError("from 1 to 65536 entries")
    x = integer_vectors(rows, n_parts, scale, id_col, vector_col, label_col)
    order = [F.col("vec_id").asc_nulls_last(), "v"]
    least = x.orderBy(*order).limit(1).collect()
    schema = "vec_id long, label string, code string, error long"
    if not least:
        return rows.sparkSession.createDataFrame([], schema), Codebooks(*[np.zeros((n_parts, 0, 0), np.int64)] * 2, np.zeros((n_parts, 0), np.int64))
    size = len(least[0].v)
    x = x.where(F.size("v") == size)
    start = np.array([r.v for r in x.orderBy(*order).limit(n_entries).select("v").collect()], np.int64)  # n_entries rows
    entries = start.reshape(len(start), n_parts, size // n_parts).transpose(1, 0, 2).copy()
    books = Codebooks(entries, np.zeros_like(entries), np.zeros(entries.shape[:2], np.int64))
    now = x.select("vec_id", "label", F.col("v").alias("parts"), F.array_repeat(F.lit(-1), n_parts).alias("codes"))
    before = None
    for _ in range(rounds):
        step = stored(now.select("vec_id", "label", "parts", "codes").mapInArrow(_round(books.entries), f"{STATE}, delta struct<{DELTA}>"))
        sums, counts = _contributions(step, entries.shape)
        books = Codebooks(books.entries, books.sums + sums, books.counts + counts).moved()
        if before is not None:
            drop_stored(before)
        before = step
        now = step.where("delta is null")
        if not counts.any() and not sums.any():
            break  # nothing changed: nor will it in a further round
    return now.select("vec_id", "label", "parts").mapInArrow(_final(books.entries), schema), books


def op11_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings"))
    # One key for each label, nulls together; sums of hot labels come back by a bounded broadcast.
    keyed = stored(coded.withColumn("group", F.struct(F.col("label").isNull().alias("none"), F.coalesce("label", F.lit("")).alias("label"))))
    summed = attach(keyed, ["group"], label_error=F.sum("error"))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The rounds one after another, each with all parts summed anew."""
    near = "SELECT p.vec_id, p.part, p.x, arg_min(c.entry, (list_inner_product(c.x, c.x) - 2 * list_inner_product(p.x, c.x), c.entry)) AS entry FROM p JOIN {c} c USING (part) GROUP BY ALL"
    steps = []
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED ({near.format(c=f'c{i}')})")
        steps.append(f"u{i} AS (SELECT part, entry, i, floor(sum(v) / count(*)) AS v FROM (SELECT part, entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{i}) GROUP BY part, entry, i)")
        steps.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(u.x, c.x) AS x FROM c{i} c LEFT JOIN (SELECT part, entry, list(v ORDER BY i) AS x FROM u{i} GROUP BY part, entry) u USING (part, entry))")
    return f"""
WITH k AS (SELECT vec_id, label, [floor(1024 * z::double) FOR z IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, v[1 + part * len(v) // 4 : (part + 1) * len(v) // 4] AS x FROM k, (SELECT unnest([0, 1, 2, 3]) AS part)),
c0 AS MATERIALIZED (SELECT part, r AS entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM k ORDER BY vec_id LIMIT 256) USING (vec_id)),
{", ".join(steps)},
f AS MATERIALIZED ({near.format(c=f"c{rounds}")}),
e AS (SELECT f.vec_id, string_agg(printf('%02x', f.entry), '' ORDER BY f.part) AS code, sum(list_sum([(f.x[i] - c.x[i]) ** 2 FOR i IN range(1, len(f.x) + 1)]))::bigint AS error
  FROM f JOIN c{rounds} c USING (part, entry) GROUP BY f.vec_id),
s AS (SELECT sha256(string_agg(array_to_string([z::bigint FOR z IN x], ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::bigint AS label_error, codebooks_sha256 FROM e JOIN k USING (vec_id), s
"""


SQL = _sql()
