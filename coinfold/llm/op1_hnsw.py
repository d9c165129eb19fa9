"""Embedding near-dedup with hierarchical navigable small-world graphs, one per shard.

Vectors that are equal component for component collapse to one representative first, with a key of its own. Representatives of a
label are dealt to shards of bounded size; each shard builds its graph once, and every representative of the label queries
every shard of it, in query blocks of bounded size, each of which fetches the shard's graph. A block's beam is doubled until an exact audit
of a fixed number of its queries finds (almost) all links of others; the audit's own links are kept. Queries whose beam is full of
links, and blocks that the widest beam can't settle, are answered by exact block products instead, so no cap on
partners loses a link. Cosines are confirmed in double precision. A block sends counts and a spanning forest of its
links, never all pairs.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, connected_components, cut, give, table

SHARD = 16384
QUERY_BLOCK = 16384
AUDIT = 256
M = 12
BATCH = 512


def _top(sims: np.ndarray, ids: np.ndarray, flags: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    o = np.argsort(-sims, axis=1, kind="stable")[:, :ef]
    return np.take_along_axis(sims, o, 1), np.take_along_axis(ids, o, 1), np.take_along_axis(flags, o, 1)


class Hnsw:
    """A batched graph: nodes are inserted in growing batches, and a batch's beams advance together."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, layers: list[np.ndarray], entry: int):
        self.x, self.levels, self.layers, self.entry = x, levels, layers, entry

    @classmethod
    def build(cls, x: np.ndarray, seed: int = 1, ef: int = 48) -> Hnsw:
        n = len(x)
        levels = np.minimum((-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(np.int64), 6)
        order = np.argsort(-levels, kind="stable")
        x, levels = x[order], levels[order]  # nodes of upper layers come first; ids are positions in this order
        top = int(levels[0]) if n else 0
        layers = [np.full((int((levels >= l).sum()), 2 * M if l == 0 else M), -1, np.int32) for l in range(top + 1)]
        g = cls(x, levels, layers, 0)
        g.order = order
        at = 0
        while at < n:
            to = min(n, at + max(32, min(BATCH, at)))
            q = np.arange(at, to)
            near = None if at == 0 else np.zeros((to - at, 1), np.int64)
            for l in range(top, -1, -1):
                members = q[levels[q] >= l]
                if at and near is not None and min(at, len(layers[l])) > 0:
                    sims, ids = g.beam(x[q], near, ef if l <= 1 else 8, l, limit=min(at, len(layers[l])))
                    near = ids
                    own, own_sims = ids[levels[q] >= l], sims[levels[q] >= l]
                else:
                    own, own_sims = np.full((len(members), 0), -1), np.zeros((len(members), 0), np.float32)
                if len(members):
                    g._connect(l, members, own, own_sims)
            at = to
        return g

    def _connect(self, l: int, q: np.ndarray, ids: np.ndarray, sims: np.ndarray) -> None:
        x, table = self.x, self.layers[l]
        s = x[q] @ x[q].T  # the batch's own nodes are candidates too
        np.fill_diagonal(s, -2)
        k = min(16, len(q))
        mates = np.argsort(-s, axis=1)[:, :k]
        ids = np.concatenate([ids, q[mates]], 1)
        sims = np.concatenate([sims, np.take_along_axis(s, mates, 1)], 1)
        ids = np.where((sims > -1.5) & (ids >= 0), ids, -1)
        sims, ids, _ = _top(np.where(ids >= 0, sims, -2), ids, np.zeros_like(ids, bool), 40)
        c = x[np.maximum(ids, 0)]
        between = np.einsum("bid,bjd->bij", c, c, optimize=True)
        chosen = np.zeros(ids.shape, bool)
        worst = np.full(ids.shape, -2.0, np.float32)
        count = np.zeros(len(q), np.int64)
        for j in range(ids.shape[1]):  # a candidate nearer to a chosen one than to the node is passed over
            ok = (ids[:, j] >= 0) & (count < M) & (sims[:, j] > worst[:, j])
            chosen[:, j] = ok
            count += ok
            worst = np.where(ok[:, None], np.maximum(worst, between[:, j]), worst)
        spare = np.cumsum(~chosen & (ids >= 0), 1) <= (M - count)[:, None]
        chosen |= spare & ~chosen & (ids >= 0)
        b, j = np.nonzero(chosen)
        a, t, w = q[b], ids[b, j].astype(np.int64), sims[b, j]
        a, t, w = np.concatenate([a, t]), np.concatenate([t, a]), np.concatenate([w, w])
        touched = np.unique(a)
        old = table[touched]
        p, r = np.nonzero(old >= 0)
        oa, ot = touched[p], old[p, r].astype(np.int64)
        a, t, w = np.concatenate([a, oa]), np.concatenate([t, ot]), np.concatenate([w, np.einsum("nd,nd->n", x[oa], x[ot])])
        _, first = np.unique(a * len(x) + t, return_index=True)
        a, t, w = a[first], t[first], w[first]
        o = np.lexsort((-w, a))
        a, t = a[o], t[o]
        begin = np.concatenate([[0], np.flatnonzero(np.diff(a)) + 1])
        rank = np.arange(len(a)) - np.repeat(begin, np.diff(np.append(begin, len(a))))
        keep = rank < table.shape[1]
        table[touched] = -1
        table[a[keep], rank[keep]] = t[keep]

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, l: int, limit: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Best `ef` found for each query on one layer, from its start nodes (-1: none); sims below -1.5 mean none."""
        table, x = self.layers[l], self.x
        n = limit or len(table)
        start = np.where(start < n, start, -1)
        b = len(q)
        ids = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -2.0, np.float32)
        k = min(ef, start.shape[1])
        ids[:, :k] = start[:, :k]
        sims[:, :k] = np.where(ids[:, :k] >= 0, np.einsum("bd,bkd->bk", q, x[np.maximum(ids[:, :k], 0)]), -2)
        done = ids < 0
        seen = np.zeros((b, n), bool)
        rows, cols = np.nonzero(ids >= 0)
        seen[rows, ids[rows, cols]] = True
        act = np.arange(b)
        while len(act):
            best = np.where(done[act], -3, sims[act])
            j = best.argmax(1)
            go = best[np.arange(len(act)), j] > -1.5
            act, j = act[go], j[go]
            if not len(act):
                break
            done[act, j] = True
            nb = table[ids[act, j]].astype(np.int64)
            new = (nb >= 0) & (nb < n)
            new &= ~seen[act[:, None], np.maximum(np.minimum(nb, n - 1), 0)]
            r, c = np.nonzero(new)
            seen[act[r], nb[r, c]] = True
            s = np.full(nb.shape, -2.0, np.float32)
            s[r, c] = np.einsum("nd,nd->n", q[act[r]], x[nb[r, c]])
            nb[~new] = -1
            some = new.any(1) & (s.max(1) > sims[act, -1])
            if some.any():
                w = act[some]
                sims[w], ids[w], done[w] = _top(np.concatenate([sims[w], s[some]], 1), np.concatenate([ids[w], nb[some]], 1), np.concatenate([done[w], ~new[some]], 1), ef)
        return sims, ids

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        near = np.zeros((len(q), 1), np.int64)
        for l in range(len(self.layers) - 1, 0, -1):
            near = self.beam(q, near, 4, l)[1]
        return self.beam(q, near, ef, 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(v.as_buffer(), np.float64) for v in column]) if len(column) else np.zeros((0, 1))


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in batches:
        lists = x.column("vec")
        raw: list[bytes | None] = []
        dims = []
        for v, label in zip(lists, x.column("label"), strict=True):
            a = None
            if v.is_valid and label.is_valid and len(v) and not v.values.null_count:
                a = v.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                if not np.isfinite(a).all() or not a.any():
                    a = None
            raw.append(None if a is None else a.tobytes())
            dims.append(0 if a is None else len(a))
        yield pa.RecordBatch.from_arrays([x.column("id"), x.column("label"), pa.array(dims, pa.int32()), pa.array(raw, pa.binary())], ["id", "label", "dim", "raw"])


def _graph(t: pa.Table) -> pa.Table:
    raw = t.column("raw").combine_chunks()
    o = np.array(sorted(range(len(raw)), key=lambda i: raw[i].as_py()))  # the same graph whatever order the rows come in
    unit = _unit(_matrix(raw)[o])
    g = Hnsw.build(unit.astype(np.float32))
    out = io.BytesIO()
    np.savez(out, unit=unit[g.order], key=t.column("key").to_numpy()[o][g.order], mult=t.column("mult").to_numpy()[o][g.order], levels=g.levels, n=len(g.layers), **{f"l{i}": a for i, a in enumerate(g.layers)})
    first = t.slice(0, 1)
    return pa.table({"label": first.column("label"), "dim": first.column("dim"), "shard": first.column("shard"), "graph": pa.array([out.getvalue()], pa.binary())})


def links(g: Hnsw, unit: np.ndarray, q: np.ndarray, own: np.ndarray, cosine: float, goal: float = 0.999, ef: int = 32, widest: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) of all found links of cosine at least `cosine` to other nodes, with beams widened until the audit passes.

    own: each query's own node, or -1. The audit takes `AUDIT` queries, evenly spaced, or all if there are fewer.
    """
    near = np.float32(cosine - 1e-4)
    q32 = q.astype(np.float32)
    audit = np.unique(np.linspace(0, len(q) - 1, min(len(q), AUDIT)).astype(np.int64))
    truth = (q32[audit] @ g.x.T) >= near
    mine = np.flatnonzero(own[audit] >= 0)
    truth[mine, own[audit[mine]]] = False
    got = [np.stack(np.nonzero(truth))]
    got[0][0] = audit[got[0][0]]
    place = np.full(len(q), -1)
    place[audit] = np.arange(len(audit))
    open_ = np.arange(len(q))
    while len(open_) and ef <= widest:
        found, full, seen = [], np.zeros(len(open_), bool), np.zeros(truth.shape, bool)
        for at in range(0, len(open_), 2048):
            rows = open_[at : at + 2048]
            sims, ids = g.search(q32[rows], ef)
            hit = (sims >= near) & (ids >= 0)
            full[at : at + 2048] = hit.all(1)
            r, c = np.nonzero(hit)
            pair = np.stack([rows[r], ids[r, c]])
            found.append(pair[:, pair[1] != own[pair[0]]])
        pairs = np.concatenate(found, 1)
        done = np.zeros(len(q), bool)
        done[open_[~full]] = True
        pairs = pairs[:, done[pairs[0]]]
        checked = pairs[:, place[pairs[0]] >= 0]
        seen[place[checked[0]], checked[1]] = True
        due = truth & done[audit][:, None]
        if (seen & due).sum() < goal * due.sum():
            ef *= 2
            continue
        got.append(pairs)
        open_ = open_[full]
        ef *= 2
    for at in range(0, len(open_), 512):  # beams full of links, or an audit that didn't pass: exact
        rows = open_[at : at + 512]
        r, c = np.nonzero((q32[rows] @ g.x.T) >= near)
        pair = np.stack([rows[r], c])
        got.append(pair[:, pair[1] != own[pair[0]]])
    code = np.unique(np.concatenate([p[0] * len(unit) + p[1] for p in got]))
    a, b = code // len(unit), code % len(unit)
    keep = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 18):
        p = slice(at, at + (1 << 18))
        keep[p] = np.einsum("nd,nd->n", q[a[p]], unit[b[p]]) >= cosine
    return a[keep], b[keep]


def _search(cosine: float):
    def run(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        empty = pa.table({k: pa.array([], pa.int64()) for k in ("key", "root", "hits")})
        if not queries.num_rows or not graphs.num_rows:
            return empty
        z = np.load(io.BytesIO(graphs.column("graph")[0].as_py()))
        unit, key, mult = z["unit"], z["key"], z["mult"]
        g = Hnsw(unit.astype(np.float32), z["levels"], [z[f"l{i}"] for i in range(int(z["n"]))], 0)
        o = np.argsort(queries.column("key").to_numpy(), kind="stable")
        mine = queries.column("key").to_numpy()[o]
        by_key = np.argsort(key)
        own = by_key[np.minimum(np.searchsorted(key[by_key], mine), len(key) - 1)]
        own = np.where(key[own] == mine, own, -1)
        a, b = links(g, unit, _unit(_matrix(queries.column("raw").combine_chunks())[o]), own, cosine)
        hits = np.bincount(a, weights=mult[b], minlength=len(mine)).astype(np.int64)
        # A spanning forest: the least key reached inside this block, passed on until nothing changes.
        nodes, inv = np.unique(np.concatenate([mine[a], key[b]]), return_inverse=True)
        p, q = inv[: len(a)], inv[len(a) :]
        root = np.arange(len(nodes))
        while len(p):
            low = np.minimum(root[p], root[q])
            new = root.copy()
            np.minimum.at(new, p, low)
            np.minimum.at(new, q, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"key": np.concatenate([mine, nodes]), "root": np.concatenate([mine, nodes[root]]), "hits": np.concatenate([hits, np.zeros(len(nodes), np.int64)])})

    return run


def embedding_dedup(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", shard: int = SHARD, block: int = QUERY_BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept): one row per row of `vectors`.

    Only vectors of equal, non-null label and equal length are compared. Null, empty and zero vectors and those with null
    or non-finite components are alone: n_links 0, component_id their id, kept. Rows that repeat an id are vectors of their own, each with its own
    links, and kept if the id is their component's; component_id is the least id in a component. A null id comes back with component_id null
    and kept true, and links with nothing. An empty table gives no rows; other columns are ignored whatever their names.
    """
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vec_col}`").alias("vec"))
    every = cut(src.mapInArrow(_valid, "id long, label string, dim int, raw binary"))
    good = every.where("raw is not null and id is not null")
    kind = ["label", "dim", "raw"]
    reps = cut(good.groupBy(*kind).agg(F.min("id").alias("rep"), F.count("*").alias("mult")).withColumn("key", F.monotonically_increasing_id()))
    sizes = reps.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sizes = cut(sizes.select("label", "dim", F.ceil(F.col("n") / shard).cast("int").alias("shards"), F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    dealt = cut(
        reps.join(sizes, ["label", "dim"])
        .withColumn("shard", F.pmod(F.xxhash64("raw"), F.col("shards")).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("raw", F.lit(1)), F.col("blocks")).cast("int"))
    )
    graphs = cut(dealt.select("label", "dim", "shard", "key", "mult", "raw").groupBy("label", "dim", "shard").applyInArrow(_graph, "label string, dim int, shard int, graph binary"))
    graphs = graphs.join(sizes, ["label", "dim"]).select("label", "dim", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "graph")
    queries = dealt.select("label", "dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), "block", "key", "raw")
    where = ["label", "dim", "shard", "block"]
    found = cut(queries.groupBy(where).cogroup(graphs.groupBy(where)).applyInArrow(_search(cosine), "key long, root long, hits long"))
    counts = found.groupBy("key").agg(F.sum("hits").alias("hits"))
    comp = connected_components(found.select(F.col("key").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "key")
    node = reps.select("key", "rep", "mult").join(counts, "key", "left").join(comp, "key", "left")
    node = cut(node.select("key", "rep", (F.coalesce("hits", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "key").alias("group")))
    # A component's name is the least id in it.
    node = attach(node, ["group"], component=F.min("rep")).select("key", "n_links", "component")
    told = cut(reps.select(*kind, "key", "mult").join(node, "key").drop("key"))
    of = give(good, told, kind, "mult", every.count()).select("id", "n_links", "component")
    rest = every.where("raw is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    return of.unionByName(rest).select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::double[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(x, y) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT x AS vec_id, (SELECT count(*) FROM l WHERE l.x = r.x) AS n_links, min(y) AS component_id, min(y) = x AS kept FROM r GROUP BY x
"""
