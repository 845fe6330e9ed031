"""Near-duplicate embeddings by navigable small-world graphs (operator 8).

Equal vectors are one class. Classes are dealt into shards by hash; each shard gets a hierarchical
graph, built from the top layer down and written as one file to the shared folder. Every class
queries every shard: a task takes a block of queries and opens one shard's file after the other, so
neither vectors nor graphs are shuffled. The beam descends the layers and is doubled for each query
until its worst member lies below the threshold, so that no count of partners is capped; queries
whose beam would pass `widest` are answered by a matrix product, which is exact. Candidates' cosines
are verified in double precision.

A sample of the queries (`audit` of them at least, by hash) is also answered by brute force over all
shards. The share of its true links that the graphs found is the recall; while it is under `recall`,
all is asked again with beams twice as wide. The last figure comes as the column audit_recall (null
where the sample has no links). Blocks send on a count for each query and, for each shard, the
groups that its links make, not the links; their union gives the components.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
nothing; vectors of different lengths don't link; each row is a vector, also one with a repeated or
null id; a component's id is the smallest id in it; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import io
import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, forget, open_file, shared_dir, store, table

LINKS, SPREAD = 16, 16


def beam(x: np.ndarray, q: np.ndarray, adj: np.ndarray, entry: np.ndarray, ef: int, grab: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """ids and cosines (falling) of the ef best that each query finds from its entries; -1 and -inf fill up.

    All queries step together: each opens its best `grab` unopened members and merges their neighbours.
    Of equal cosines the smaller id is nearer, so a member that fell out of the beam can't come back, as the
    beam's worst only rises; without an order of equals, vectors that lie close together would go in circles.
    """
    n = len(q)
    ids = np.full((n, ef), -1, np.int64)
    sims = np.full((n, ef), -np.inf)
    opened = np.zeros((n, ef), bool)
    e = entry[:, :ef]
    ids[:, : e.shape[1]] = e
    sims[:, : e.shape[1]] = np.where(e >= 0, np.einsum("qd,qkd->qk", q, x[np.maximum(e, 0)]) - e * 1e-14, -np.inf)
    live = np.arange(n)
    while len(live):
        s = np.where(opened[live] | (ids[live] < 0), -np.inf, sims[live])
        k = min(grab, ef)
        pick = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < ef else np.tile(np.arange(ef), (len(live), 1))
        good = np.take_along_axis(s, pick, 1) > -np.inf
        more = good.any(axis=1)
        live, pick, good = live[more], pick[more], good[more]
        if not len(live):
            break
        opened[live[:, None], pick] |= good
        from_ = np.where(good, ids[live[:, None], pick], -1)
        new = np.where(from_[:, :, None] >= 0, adj[np.maximum(from_, 0)], -1).reshape(len(live), -1)
        sim = np.where(new >= 0, np.einsum("qd,qkd->qk", q[live], x[np.maximum(new, 0)]) - new * 1e-14, -np.inf)
        all_ids = np.concatenate([ids[live], new], axis=1)
        all_sims = np.concatenate([sims[live], sim], axis=1)
        all_open = np.concatenate([opened[live], np.zeros(new.shape, bool)], axis=1)
        order = np.argsort(all_ids * 2 + ~all_open, axis=1, kind="stable")  # of equal ids the opened one first
        all_ids, all_sims, all_open = (np.take_along_axis(v, order, 1) for v in (all_ids, all_sims, all_open))
        twin = np.zeros(all_ids.shape, bool)
        twin[:, 1:] = all_ids[:, 1:] == all_ids[:, :-1]
        all_sims[twin | (all_ids < 0)] = -np.inf
        top = np.argpartition(-all_sims, ef - 1, axis=1)[:, :ef]
        ids[live], sims[live], opened[live] = (np.take_along_axis(v, top, 1) for v in (all_ids, all_sims, all_open))
        ids[live] = np.where(np.isfinite(sims[live]), ids[live], -1)
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def choose(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (by falling cosine, -1 fills up) those nearer to the row than to any chosen before; then the nearest others, up to most."""
    n, c = cand.shape
    v = x[np.maximum(cand, 0)]
    among = np.einsum("qad,qbd->qab", v, v)
    closest = np.full((n, c), -np.inf, np.float32)
    taken, count = np.zeros((n, c), bool), np.zeros(n, int)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (count < most)
        taken[:, j] = ok
        count += ok
        closest = np.where(ok[:, None], np.maximum(closest, among[:, j]), closest)
    rank = np.where(taken, 0, np.where(cand >= 0, 1, 2)) * c + np.arange(c)
    return np.take_along_axis(np.where(cand >= 0, cand, -1), np.argsort(rank, axis=1)[:, :most], 1)


class Graph:
    """x: unit vectors; layer l holds the first sizes[l] of them."""

    def __init__(self, x: np.ndarray, layers: list[np.ndarray] | None = None):
        self.x, self.layers = x, layers if layers is not None else []  # the top layer first
        if layers is None:
            sizes = [len(x)]
            while sizes[-1] > 64:
                sizes.append(max(1, sizes[-1] // SPREAD))
            for n in reversed(sizes):
                self.layers.append(self._layer(n))

    def entries(self, q: np.ndarray, width: int = 8) -> np.ndarray:
        e = np.zeros((len(q), 1), np.int64)
        for adj in self.layers:
            e = beam(self.x, q, adj, e, width)[0]
        return e

    def _layer(self, n: int, wide: int = 40) -> np.ndarray:
        x, adj, at = self.x, np.full((n, 2 * LINKS), -1, np.int64), 0
        while at < n:
            step = min(max(256, min(at, 2048)), n - at)
            own = np.arange(at, at + step)
            q = x[own]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            k = min(LINKS, step - 1)
            cand, sims = np.full((step, 0), -1, np.int64), np.zeros((step, 0), np.float32)
            if k:
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                cand, sims = own[top], np.take_along_axis(near, top, 1)
            if at:
                start = self.entries(q) if self.layers else np.zeros((step, 1), np.int64)
                start = np.where(start < at, start, -1)
                start[:, 0] = np.where(start[:, 0] < 0, 0, start[:, 0])
                a, b = beam(x, q, adj, start, wide)
                cand, sims = np.concatenate([cand, a], axis=1), np.concatenate([sims, b], axis=1)
            if cand.shape[1]:
                order = np.argsort(-sims, axis=1, kind="stable")
                cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
                pick = choose(x, cand, sims, LINKS)
                adj[own, : pick.shape[1]] = pick
                self._back(adj, np.repeat(own, pick.shape[1]), pick.ravel())
            at += step
        return adj

    def _back(self, adj: np.ndarray, src: np.ndarray, dst: np.ndarray) -> None:
        """Adds src to the neighbours of dst; who would get too many chooses again."""
        ok = dst >= 0
        src, dst = src[ok], dst[ok]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        width = int(min(count.max(initial=0), 64))
        new = np.full((len(node), width), -1, np.int64)
        for j in range(width):
            has = count > j
            new[has, j] = src[first[has] + j]
        for i in range(0, len(node), 2048):
            at = node[i : i + 2048]
            cand = np.concatenate([adj[at], new[i : i + 2048]], axis=1)
            sims = np.where(cand >= 0, np.einsum("qd,qkd->qk", self.x[at], self.x[np.maximum(cand, 0)]), -np.inf)
            by = np.argsort(cand, axis=1, kind="stable")
            s = np.take_along_axis(cand, by, 1)
            twin = np.zeros(s.shape, bool)
            twin[:, 1:] = s[:, 1:] == s[:, :-1]
            np.put_along_axis(sims, by, np.where(twin, -np.inf, np.take_along_axis(sims, by, 1)), 1)
            order = np.argsort(-sims, axis=1, kind="stable")
            cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
            cand = np.where(np.isfinite(sims), cand, -1)
            full = (cand >= 0).sum(axis=1) > 2 * LINKS
            out = cand[:, : 2 * LINKS].copy()
            if full.any():
                out[full] = choose(self.x, cand[full], sims[full], 2 * LINKS)
            adj[at] = out

    def above(self, q: np.ndarray, least: float, ef: int, widest: int = 400) -> list[np.ndarray]:
        """For each query, candidates of cosine about `least` or more; the beam doubles until it reaches below, past `widest` all are compared."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo, n = np.arange(len(q)), len(self.x)
        while len(todo) and ef <= widest and ef < n:
            again, step = [], max(1, (1 << 17) // (ef + 128))
            for i in range(0, len(todo), step):
                part = todo[i : i + step]
                ids, sims = beam(self.x, q[part], self.layers[-1], self.entries(q[part]), ef)
                for r, a, s in zip(part, ids, sims):
                    if s[-1] >= least:
                        again.append(r)
                    else:
                        out[r] = a[s >= least]
            todo, ef = np.array(again, np.int64), ef * 2
        step = max(1, (1 << 22) // max(n, 1))
        for i in range(0, len(todo), step):
            part = todo[i : i + step]
            hit, at = np.nonzero(q[part] @ self.x.T >= least)
            for r, a in zip(part, np.split(at, np.searchsorted(hit, np.arange(1, len(part))))):
                out[r] = a
        return out


def _unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / top
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def groups(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The smallest node that links reach, for each of n nodes, by hooking and pointer jumping; label: groups so far."""
    label = np.arange(n) if label is None else label
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


SHARD = "dim int, shard int, path string, rows long"


def _build(folder: str):
    """Writes a shard's unit vectors, ids, copies and graph; the name carries the attempt."""
    def run(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("h")
        raw = _unit(np.stack(df.embedding.to_numpy()).astype(np.float64))
        g, path = Graph(raw.astype(np.float32)), f"{folder}/{uuid.uuid4().hex}.npy"
        with open_file(path, "w") as f:
            for x in (raw, df.rep.to_numpy(np.int64), df.copies.to_numpy(np.int64), *(layer.astype(np.int32) for layer in g.layers)):
                buf = io.BytesIO()
                np.save(buf, x)
                f.write(buf.getvalue())
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "path": [path], "rows": [len(df)]})

    return run


def _load(path: str):
    with open_file(path, "r") as f:
        buf = io.BytesIO(f.read())
    size, parts = buf.getbuffer().nbytes, []
    while buf.tell() < size:
        parts.append(np.load(buf))
    raw, ids, copies, *layers = parts
    return Graph(raw.astype(np.float32), [x.astype(np.int64) for x in layers]), raw, ids, copies


TOLD = "kind int, node long, n long, root long"


def _ask(shards: list[tuple[int, str]], least: float, ef: int, one_in: int, block: int, asked: int = 1 << 14):
    """Of each block of queries: (0, node, links, node) for each, (1, node, 0, root) for groups, (2, 0, found, there) for the audit."""
    def answer(rep: np.ndarray, vectors: np.ndarray, h: np.ndarray):
        exact = _unit(vectors)
        q, slack, total = exact.astype(np.float32), least - 1e-3, np.zeros(len(rep), np.int64)
        sample = np.flatnonzero(h % np.uint64(one_in) == 0)
        found = there = 0
        for dim, path in shards:
            if dim != vectors.shape[1]:
                continue
            g, raw, ids, copies = _load(path)
            label = np.arange(len(rep) + len(ids))
            seen = np.zeros(len(rep), np.int64)
            for i in range(0, len(rep), asked):
                hits = g.above(q[i : i + asked], slack, ef)
                size = np.array([len(x) for x in hits])
                ends, k = np.cumsum(size), 0
                while k < len(hits):  # links are taken up in stretches, then dropped
                    z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + (1 << 18), "right")))
                    a, b = np.repeat(np.arange(i + k, i + z), size[k:z]), np.concatenate(hits[k:z])
                    ok = np.einsum("pd,pd->p", exact[a], raw[b]) >= least
                    ok &= rep[a] != ids[b]
                    a, b = a[ok], b[ok]
                    total += np.bincount(a, copies[b], len(rep)).astype(np.int64)
                    seen += np.bincount(a, minlength=len(rep))
                    label = groups(len(label), a, len(rep) + b, label)
                    k = z
            for i in range(0, len(sample), 256):
                z = sample[i : i + 256]
                true = (exact[z] @ raw.T >= least) & (rep[z][:, None] != ids[None, :])
                there, found = there + int(true.sum()), found + int(np.minimum(seen[z], true.sum(axis=1)).sum())
            names = np.concatenate([rep, ids])
            joined = np.flatnonzero(label != np.arange(len(label)))
            yield 1, names[joined], np.zeros(len(joined), np.int64), names[label[joined]]
        yield 0, rep, total, rep
        yield 2, np.zeros(1, np.int64), np.array([found]), np.array([there])

    def run(it):
        held: dict[int, list] = {}

        def flush(dim):
            rows = held.pop(dim)
            for kind, *columns in answer(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), np.concatenate([r[2] for r in rows])):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind), pa.int32()), *map(pa.array, columns)], names=["kind", "node", "n", "root"])

        for b in it:
            dims, flat = b.column(2).to_numpy(), b.column(1)
            for dim in np.unique(dims).tolist():
                z = np.flatnonzero(dims == dim)
                vectors = flat.take(pa.array(z)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                held.setdefault(dim, []).append((b.column(0).to_numpy()[z], vectors, b.column(3).to_numpy()[z].view(np.uint64)))
                if sum(len(r[0]) for r in held[dim]) >= max(1, block // dim):
                    yield from flush(dim)
        for dim in list(held):
            yield from flush(dim)

    return run


def link(vectors: DataFrame, least: float = 0.95, recall: float = 0.99, shard_bytes: int = 1 << 26, block: int = 1 << 23, audit: int = 4096, ef: int = 24, tasks: int = 24) -> DataFrame:
    """vectors (vec_id, embedding) -> (vec_id, n_links, component_id, audit_recall) for every row. shard_bytes bounds a shard's vectors, block the numbers of a block of queries."""
    spark = vectors.sparkSession
    good = F.expr("coalesce(size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(embedding, x -> x <> 0), false)")
    v = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), good.alias("good"))
    v = v.withColumn("cls", F.when(F.col("good"), F.sha2(F.to_binary(F.array_join(F.transform("embedding", lambda x: F.lower(F.hex(F.xxhash64(x)))), ""), F.lit("hex")), 256)))
    classes = v.filter("good").groupBy("cls").agg(F.min("vec_id").alias("low"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    # a class's number is its place in this table, so no two have the same
    classes = store(classes.select("cls", "low", "copies", "embedding", F.size("embedding").alias("dim"), F.xxhash64("cls").alias("h"), F.monotonically_increasing_id().alias("rep")))
    sizes = {r.dim: r.n for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}  # a row for each length of vectors
    n = sum(sizes.values())
    each = F.create_map(*(F.lit(x) for d, k in sizes.items() for x in (d, max(4, math.ceil(k * d * 8 / shard_bytes))))) if sizes else F.lit(None).cast("map<int,int>")
    dealt = classes.select("dim", F.pmod("h", F.element_at(each, F.col("dim"))).cast("int").alias("shard"), "h", "rep", "copies", "embedding")
    index = store(dealt.groupBy("dim", "shard").applyInPandas(_build(shared_dir(spark)), SHARD))
    shards = [(r.dim, r.path) for r in index.orderBy("dim", "shard").collect()]
    queries = classes.select("rep", "embedding", "dim", "h").repartition(max(tasks, math.ceil(sum(d * k for d, k in sizes.items()) / block)), "rep")
    while True:
        told = store(queries.mapInArrow(_ask(shards, least, ef, max(1, n // audit), block), TOLD))
        found, there = told.filter("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("root"), F.lit(0))).first()
        if found >= recall * there or ef > n:
            break
        forget(told)
        ef *= 2
    counts = told.filter("kind = 0").select("node", "n")
    comp = components(told.filter("kind = 1").select(F.col("node").alias("a"), F.col("root").alias("b")))
    c = classes.select("cls", "low", "copies", "rep").join(counts.withColumnRenamed("node", "rep").hint("merge"), "rep")
    c = c.join(comp.withColumnsRenamed({"node": "rep", "root": "top"}).hint("merge"), "rep", "left")
    c = store(c.select("cls", "low", (F.col("n") + F.col("copies") - 1).alias("n_links"), F.coalesce("top", "rep").alias("top")))
    lows = store(c.groupBy("top").agg(F.min("low").alias("component_id")))
    c = c.join(lows.hint("merge"), "top").select("cls", "n_links", "component_id")
    out = v.select("vec_id", "cls").join(c.hint("merge"), "cls", "left")
    audited = F.lit(found / there if there else None).cast("double")
    links = F.coalesce("n_links", F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), audited.alias("audit_recall"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = link(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"), "audit_recall")


#: All pairs; the audit must have found every link.
SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS k, vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT k, vec_id, e FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM good AS a JOIN good AS b ON len(a.e) = len(b.e) WHERE a.k <> b.k AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(vec_id) AS low FROM reach JOIN v ON v.k = reach.b GROUP BY a),
n AS (SELECT a, count(*) AS n FROM link GROUP BY a),
o AS (SELECT vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(vec_id, low.low), vec_id) AS component_id FROM v LEFT JOIN low ON low.a = v.k LEFT JOIN n ON n.a = v.k)
SELECT vec_id, n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept, CASE WHEN (SELECT count(*) FROM link) > 0 THEN 1.0::DOUBLE END AS audit_recall FROM o
"""
