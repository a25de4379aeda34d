"""Operator 4, embedding near-dedup: robust-pruned flat graph, range-expanding greedy search, verified links.

1. Equal vectors of a label form one class; classes go on with their number of rows.
2. Overlapping shards: every class joins the shards of its ``overlap`` nearest
   of K cluster centres (k-means on a bounded sample).  Shards are split into
   blocks of bounded size by a hash.
3. Build: each block links every member, both ways, to a robustly pruned set
   of near members.  The lists of a class from all its blocks are united.
4. Search: for each pair of blocks of a shard, whose lists are joined by a
   build over both, all members of the first are searched at once: greedily from
   the medoid and from the member itself, then on through every node within
   twice the link radius.
5. Links are verified by the cosine in double precision and counted in one
   shard only (the smallest one that both ends share).  Blocks return counts
   and a spanning forest of all links they found, those that another shard
   counts included, never the pairs of a group.

:func:`audit_recall` compares the links found with brute force.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach_by_key, components, scratch_table

SAMPLE_ROWS = 10_000  # rows on which the centres are fitted
MAX_CENTRES = 4096
SHARD_ROWS = 2000  # classes of the largest label per centre
BLOCK_ROWS = 1024
OVERLAP = 3
DEGREE, CANDIDATES, ALPHA = 24, 64, 1.2
PATIENCE = 12  # greedy steps without a better node before a search ends


def unit_rows(vectors) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    scale = np.abs(x).max(axis=1, keepdims=True)  # keeps very large and very small components finite
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, k: int, steps: int = 8) -> np.ndarray:
    """Spherical k-means from evenly spaced rows."""
    centres = sample[np.linspace(0, len(sample) - 1, k).astype(int)]
    for _ in range(steps):
        near = (sample @ centres.T).argmax(axis=1)
        for c in range(k):
            if (near == c).any():
                m = sample[near == c].sum(axis=0)
                centres[c] = m / max(np.linalg.norm(m), 1e-12)
    return centres


def robust_prune(x: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n, degree), padded with -1: nearest first, dropping those much nearer to a chosen neighbour."""
    n = len(x)
    sims = x @ x.T
    np.fill_diagonal(sims, -np.inf)
    width = min(candidates, n - 1)
    if width < 1:
        return np.full((n, 1), -1)
    near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
    order = np.take_along_axis(sims, near, axis=1).argsort(axis=1)[:, ::-1]
    near = np.take_along_axis(near, order, axis=1)
    dist = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, near, axis=1), 0))
    alive = np.ones((n, width), dtype=bool)
    adj = np.full((n, degree), -1)
    rows = np.arange(n)
    for r in range(degree):
        first = alive.argmax(axis=1)
        ok = alive[rows, first]
        if not ok.any():
            break
        pick = near[rows, first]
        adj[ok, r] = pick[ok]
        alive[rows, first] = False
        between = np.sqrt(np.maximum(2 - 2 * sims[pick[:, None], near], 0))
        alive &= ~((alpha * between <= dist) & ok[:, None])
    return adj


def neighbour_lists(x: np.ndarray) -> list[np.ndarray]:
    """Pruned neighbours of each row, in both directions: a member that nobody chose must still be found."""
    adj = robust_prune(x)
    src, at = np.nonzero(adj >= 0)
    dst = adj[src, at]
    pair = np.unique(np.concatenate((src * len(x) + dst, dst * len(x) + src)))
    return np.split(pair % len(x), np.searchsorted(pair // len(x), np.arange(1, len(x))))


def range_search(queries: np.ndarray, own: np.ndarray, x: np.ndarray, adj: np.ndarray, reach: float) -> np.ndarray:
    """(queries, nodes) cosines of the nodes visited, -inf elsewhere.

    Greedy from the medoid and the query's ``own`` node; every node with cosine
    >= ``reach`` is expanded too.
    """
    nq, n = len(queries), len(x)
    score = np.full((nq, n), -np.inf)
    expanded = np.zeros((nq, n), dtype=bool)
    medoid = int((x @ x.sum(axis=0)).argmax())
    score[:, medoid] = queries @ x[medoid]
    score[np.arange(nq), own] = (queries * x[own]).sum(axis=1)
    best, stale = np.full(nq, -np.inf), np.zeros(nq, dtype=int)
    while True:
        open_score = np.where(expanded, -np.inf, score)
        top = open_score.argmax(axis=1)
        value = open_score[np.arange(nq), top]
        q, node = np.nonzero(open_score >= reach)
        greedy = np.nonzero((value > -np.inf) & (value < reach) & (stale < PATIENCE))[0]
        q, node = np.concatenate((q, greedy)), np.concatenate((node, top[greedy]))
        if not len(q):
            return score
        expanded[q, node] = True
        if len(greedy):
            better = value[greedy] > best[greedy]
            best[greedy] = np.maximum(best[greedy], value[greedy])
            stale[greedy] = np.where(better, 0, stale[greedy] + 1)
        for at in range(0, len(q), 50_000):  # bounds the memory of one expansion
            qq = np.repeat(q[at:at + 50_000], adj.shape[1])
            to = adj[node[at:at + 50_000]].ravel()
            ok = to >= 0
            qq, to = qq[ok], to[ok]
            ok = score[qq, to] == -np.inf
            key = np.unique(qq[ok] * n + to[ok])
            qq, to = key // n, key % n
            score[qq, to] = np.einsum("ij,ij->i", queries[qq], x[to])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node connected with each node."""
    root = np.arange(n)
    while len(a):
        before = root.copy()
        np.minimum.at(root, a, root[b])
        np.minimum.at(root, b, root[a])
        root = root[root]
        if (root == before).all():
            break
    return root


def link_rows(a: np.ndarray, c: np.ndarray, mult: np.ndarray, pivots: list, pivot: int) -> tuple[np.ndarray, np.ndarray]:
    """Per node: linked rows over the links (a, c) that shard ``pivot`` counts, and the smallest node connected over all of them.

    A pair is counted in the smallest shard that both ends share; another shard
    that finds it connects its ends all the same.
    """
    mine = np.array([min(set(pivots[s]) & set(pivots[t])) == pivot for s, t in zip(a, c, strict=True)], dtype=bool)
    n = np.bincount(a[mine], mult[c[mine]], len(mult)) + np.bincount(c[mine], mult[a[mine]], len(mult))
    return n, forest(len(mult), a, c)


def _local(cids: np.ndarray, lists) -> np.ndarray:
    """Neighbour lists by class number as an index matrix into ``cids`` (sorted), -1 where absent."""
    width = max((len(v) for v in lists), default=1) or 1
    flat = np.full((len(cids), width), -1, dtype=np.int64)
    for i, v in enumerate(lists):
        v = np.asarray(v, dtype=np.int64)
        v = np.unique(v)
        at = np.searchsorted(cids, v)
        hit = (at < len(cids)) & (cids[np.minimum(at, len(cids) - 1)] == v)
        flat[i, :hit.sum()] = at[hit]
    return flat


def assign_shards(classes: DataFrame, centres: np.ndarray | None, overlap: int) -> DataFrame:
    """label, dim, pivot, cid, mult, vec, pivots: one row per shard of a class."""
    sc = classes.sparkSession.sparkContext
    bc = sc.broadcast(centres)  # at most MAX_CENTRES rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = bc.value
        for b in batches:
            pivots = [[0]] * len(b)
            if c is not None:
                fits = np.nonzero((b["dim"] == c.shape[1]).to_numpy())[0]
                if len(fits):
                    sims = unit_rows(b["vec"].iloc[fits]) @ c.T
                    near = np.sort(np.argsort(-sims, axis=1, kind="stable")[:, :overlap], axis=1)
                    for i, p in zip(fits, near, strict=True):
                        pivots[i] = p.tolist()
            yield b.assign(pivots=pivots)[["label", "dim", "cid", "mult", "vec", "pivots"]]

    kind = classes.schema["label"].dataType.simpleString()
    out = classes.select("label", "dim", "cid", "mult", "vec").mapInPandas(
        run, f"label {kind}, dim int, cid long, mult long, vec array<double>, pivots array<int>")
    return out.withColumn("pivot", F.explode("pivots"))


def embedding_links(classes: DataFrame, cosine: float, shard_rows: int, block_rows: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """(cid, n) numbers of linked rows of other classes, and spanning (a, b) links, of ``classes(label, dim, cid, mult, vec)``."""
    largest = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    k = min(MAX_CENTRES, math.ceil(largest / shard_rows))
    centres = None
    if k > overlap:
        dim = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()["dim"]
        rows = classes.filter(F.col("dim") == dim).orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE_ROWS).select("vec").collect()
        centres = fit_centres(unit_rows([r["vec"] for r in rows]), min(k, len(rows)))
    shards = scratch_table(assign_shards(classes, centres, overlap), "shards")
    shard = ["label", "dim", "pivot"]
    sizes = shards.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    members = shards.join(sizes, shard).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    members = scratch_table(members, "blocks")
    kind = classes.schema["label"].dataType.simpleString()

    def build(b: pd.DataFrame) -> pd.DataFrame:
        cids = b["cid"].to_numpy()
        return pd.DataFrame({"cid": cids, "near": [cids[near] for near in neighbour_lists(unit_rows(b["vec"]))]})

    lists = members.groupBy(*shard, "block").applyInPandas(build, "cid long, near array<long>")
    united = scratch_table(lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "graph")
    reach = 2 * cosine * cosine - 1  # cosine of twice the link angle

    def search(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("cid")
        i, j = int(b["first"].iloc[0]), int(b["second"].iloc[0])
        x, cids, mult = unit_rows(b["vec"]), b["cid"].to_numpy(), b["mult"].to_numpy()
        block, pivot = b["block"].to_numpy(), int(b["pivot"].iloc[0])
        near = b["near"].tolist()
        if i != j:  # the lists of the two blocks know nothing of each other yet
            near = [np.concatenate((v, cids[m])) for v, m in zip(near, neighbour_lists(x), strict=True)]
        src = np.nonzero(block == i)[0]
        score = range_search(x[src], src, x, _local(cids, near), reach)
        q, c = np.nonzero(score >= cosine)
        a = src[q]
        across = (block[a] == i) & (block[c] == j)
        a, c = a[across], c[across]
        a, c = np.minimum(a, c), np.maximum(a, c)
        pair = np.unique((a * len(b) + c)[a != c])
        a, c = pair // len(b), pair % len(b)
        n, root = link_rows(a, c, mult, b["pivots"].tolist(), pivot)
        out = np.nonzero((n > 0) | (root != np.arange(len(b))))[0]
        return pd.DataFrame({"cid": cids[out], "n": n[out].astype("int64"), "other": cids[root[out]]})

    first = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1),
                                  lambda o: F.struct(F.least("block", o).alias("first"), F.greatest("block", o).alias("second"))))
    tasks = members.join(united, "cid").withColumn("task", first).select(*shard, "task.first", "task.second", "block", "cid", "mult", "vec", "pivots", "near")
    found = scratch_table(tasks.groupBy(*shard, "first", "second").applyInPandas(search, "cid long, n long, other long"), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("n"))
    return counts, found.select(F.col("cid").alias("a"), F.col("other").alias("b")).filter("a <> b")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = 0.98,
                 shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, overlap: int = OVERLAP) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept.

    Rows link when their labels are equal and not null and their cosine in
    double precision is at least ``cosine``.  Vectors that are null, empty, zero
    or hold null or non-finite components, rows with a null label, and vectors
    of different lengths link with nothing.  ``component_id`` is the smallest id
    reachable; rows that repeat an id are linked like others and share it.  A
    null id never names a component unless it has no other.  An empty table
    gives an empty result; other columns are not read.
    """
    v = F.col(vec_col).cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.exists(v, lambda c: c != 0) & ~bad
    leaf = vectors.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"), F.spark_partition_id().alias("run"),
                          F.col(label_col).alias("label"), F.coalesce(usable, F.lit(False)).alias("usable"), v.alias("vec")) \
        .withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec"))
    leaf = scratch_table(leaf, "vectors")
    same = ["label", "h1", "h2"]
    classes = leaf.filter("usable").groupBy(*same).agg(F.min("row_no").alias("cid"), F.count(F.lit(1)).alias("mult"),
                                                       F.min("id").alias("low_id"), F.first("vec").alias("vec"))
    classes = scratch_table(classes.withColumn("dim", F.size("vec")), "classes")
    counts, edges = embedding_links(classes, cosine, shard_rows, block_rows, overlap)
    comp = components(edges).withColumnRenamed("id", "cid")
    group = classes.select("cid", "low_id", "mult", *same).join(comp, "cid", "left").join(counts, "cid", "left") \
        .withColumn("comp", F.coalesce("comp", "cid"))
    low = group.groupBy("comp").agg(F.min("low_id").alias("component_id"))
    table = scratch_table(group.join(low, "comp").select(*same, "component_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links")), "table")
    rows = attach_by_key(leaf.select("id", "run", "usable", *same).filter("usable"), table, same)
    alone = leaf.filter("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = rows.select("id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))


def audit_recall(vectors: DataFrame, found: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                 cosine: float = 0.98, every: int = 20) -> float:
    """Share of the true links of every ``every``-th id that ``found(id, n_links)`` counts; brute force in blocks."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")) \
        .filter("id is not null and label is not null and vec is not null and exists(vec, c -> c <> 0) and not exists(vec, c -> c is null or isnan(c))")
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("asked", F.lit(True))
    every_row = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(16)).cast("int")).withColumn("asked", F.lit(False))

    def count(b: pd.DataFrame) -> pd.DataFrame:
        q, d = b[b["asked"]], b[~b["asked"]]
        if not len(q) or not len(d):
            return pd.DataFrame({"id": [], "n": []}).astype("int64")
        n = (unit_rows(q["vec"]) @ unit_rows(d["vec"]).T >= cosine).sum(axis=1) - np.isin(q["id"], d["id"]).astype(int)
        return pd.DataFrame({"id": q["id"].to_numpy(), "n": n})

    true = asked.unionByName(every_row).groupBy("label", F.size("vec").alias("dim"), "part").applyInPandas(count, "id long, n long") \
        .groupBy("id").agg(F.sum("n").alias("n"))
    r = true.join(found.select("id", "n_links"), "id").agg(F.sum(F.least("n", "n_links")), F.sum("n")).first()
    return r[0] / r[1] if r[1] else 1.0


def op4_embedding_dedup(vectors: DataFrame) -> DataFrame:
    return near_vectors(vectors).withColumnRenamed("id", "vec_id")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT vec_id, (SELECT count(*) FROM links l WHERE l.a = vec_id) AS n_links, min(other) AS component_id, vec_id = min(other) AS kept
FROM reach GROUP BY vec_id
"""
