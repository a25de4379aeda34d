"""Helpers shared by the operators: shared scratch tables, skew-free attach, connected components."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.session import checkpoint_dir, table_path

# Largest dimension table that is broadcast by hint; its row count is measured first.
DIMENSION_ROWS = 100_000

# Words of the text contracts: runs without these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def scratch_table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but columnar: later steps read only
    the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(table: DataFrame) -> None:
    """Delete a scratch table that no later step reads."""
    spark = table.sparkSession
    for file in table.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes a write's shuffle files when it ends; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def crc_fold(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 3; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3


def attach_by_key(leaf: DataFrame, table: DataFrame, keys: list[str], run: str = "run", how: str = "left") -> DataFrame:
    """Join ``table`` (one row per key) to ``leaf`` rows, spread over the rows' input runs.

    A key that holds a third of all rows would put them into one join task.
    The keys are first reduced to one row per (run, key), joined there, and
    carried to the rows by (run, key): a task then holds at most one run's
    share of a hot key.  ``leaf`` must be a scratch table, so that ``run`` is
    a stored column.
    """
    spread = leaf.select(run, *keys).distinct().join(table, keys, "inner")
    return leaf.join(spread, [run, *keys], how)


def same_row(left: DataFrame, right: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Join on null-safe equality of ``cols``; the right side's key columns are renamed and dropped."""
    r = right.select(*[F.col(c).alias(f"__{c}") for c in cols], *[c for c in right.columns if c not in cols])
    cond = None
    for c in cols:
        e = left[c].eqNullSafe(r[f"__{c}"])
        cond = e if cond is None else cond & e
    return left.join(r, cond, how).drop(*[f"__{c}" for c in cols])


def keep_rows(docs: DataFrame, survivors: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text) is in ``survivors(id, thash)``, each survivor once.

    Texts are shuffled once on (id, text hash), which no hot group shares.
    Rows that repeat both id and text survive as many times as ``survivors``
    lists them: once.  All columns of ``docs`` are returned unchanged, whatever
    their names.
    """
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                         docs[f"`{id_col}`"].alias("id"), F.xxhash64(F.coalesce(docs[f"`{text_col}`"], F.lit(""))).alias("thash"))
    wanted = survivors.select("id", "thash").groupBy("id", "thash").agg(F.count(F.lit(1)).alias("n_wanted"))
    joined = same_row(packed, wanted.hint("shuffle_hash"), ["id", "thash"], "inner")
    repeated = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("thash")) \
        .groupBy("id", "thash").count().filter("count > 1").limit(1).count()
    if repeated:
        from pyspark.sql import Window
        w = Window.partitionBy("id", "thash").orderBy(F.hash("row"))
        joined = joined.withColumn("nth", F.row_number().over(w)).filter("nth <= n_wanted")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


# ------------------------------------------------------------------ connected components
def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(id, comp): smallest id reachable over undirected ``edges(a, b)``; ids without an edge are absent.

    Large-star / small-star rounds: every node hooks its larger neighbours, then
    itself, to its smallest neighbour.  Each star is one grouped minimum and one
    join; hubs are reduced map-side in the minimum, and split by the adaptive
    skew join.  Each round is written to the shared folder.  Stops when a round
    leaves the edge set unchanged.
    """
    e = scratch_table(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = [F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.expr("pmod(xxhash64(v, u), 1000003)"))]
    before = tuple(e.agg(*state).first())
    for _ in range(max_rounds):
        # large star: neighbours larger than u go to the smallest of u and its neighbours
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: smaller neighbours and u itself go to the smallest neighbour
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = scratch_table(small, "cc")
        after = tuple(e.agg(*state).first())
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components: not converged")
    return e.select(F.col("u").alias("id"), F.col("v").alias("comp")) \
        .unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct())


def bucket_edges(members: DataFrame, payload: list[str], prefilter: Callable[[str, str], Column],
                 verify: Callable[[DataFrame], DataFrame],
                 refine: Callable[[DataFrame], tuple[DataFrame, DataFrame, list[str], Callable[[str, str], Column]]] | None = None) -> DataFrame:
    """Verified links that connect the members of every bucket as all pairs of it would.

    ``members(key, id, *payload)``: bucket memberships.  ``prefilter(a, b)`` is a
    condition on the payload columns ``a_*`` / ``b_*`` that every true pair
    meets; ``verify(pairs(a, b))`` returns the true pairs.

    1. Star: each member is paired with its bucket's centre, and the verified
       pairs give components.  The centre is the member that shares most
       buckets with most others: in a family of copies that is its source.
    2. Rest: where a bucket of three or more still holds several components,
       each member outside the bucket's most common component is paired with
       the members of other components.  Members that are already connected
       need no further pair, so a group of copies is never expanded.
       ``refine(rest(id, comp, *payload))`` may give a sharper condition: it
       returns the members with more payload columns, further pairs (a, b) to
       test, those columns' names and the condition for all other pairs.
    Together these test every pair that could join two components; the
    result's components equal those of all pairs.
    """
    cols = ["id", *payload]
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    score = members.join(sizes, "key").groupBy("id").agg(F.sum("size").alias("score"))
    ranked = scratch_table(members.join(score, "id").select("key", "score", *cols), "ranked")
    heads = ranked.groupBy("key").agg(F.min(F.struct((-F.col("score")).alias("o"), *cols)).alias("c"), F.count(F.lit(1)).alias("size")) \
        .filter("size > 1").select("key", *[F.col(f"c.{c}").alias(f"b_{c}") for c in cols])
    mine = ranked.select("key", *[F.col(c).alias(f"a_{c}") for c in cols])
    star = mine.join(heads, "key").filter((F.col("a_id") != F.col("b_id")) & prefilter("a", "b")) \
        .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b")).distinct()
    first = scratch_table(verify(star), "edges")
    comp = components(first)
    crowd = ranked.select("key", *cols).join(sizes.filter("size > 2").select("key"), "key") \
        .join(comp, "id", "left").select("key", F.coalesce("comp", "id").alias("comp"), *cols)
    crowd = scratch_table(crowd, "crowd")
    split = crowd.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n_comp")) \
        .groupBy("key").agg(F.max(F.struct("n_comp", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")) \
        .filter("comps > 1").select("key", F.col("top.comp").alias("major"))
    rest = scratch_table(crowd.join(split, "key"), "rest")
    more, late, condition = None, [], prefilter
    if refine is not None:
        known, more, late, condition = refine(rest.select("comp", *cols).distinct())
        rest = rest.join(known.select("id", *late), "id")
    # a pair that shares several buckets is tested in the first of them
    rest = rest.join(rest.groupBy("id").agg(F.collect_set("key").alias("keys")), "id")
    both = ["comp", *cols, *late, "keys"]
    a = rest.filter("comp <> major").select("key", *[F.col(c).alias(f"a_{c}") for c in both])
    b = rest.select("key", "major", *[F.col(c).alias(f"b_{c}") for c in both])
    pairs = a.join(b, "key").filter((F.col("a_comp") != F.col("b_comp")) & condition("a", "b")
                                    & ((F.col("b_comp") == F.col("major")) | (F.col("a_id") < F.col("b_id")))
                                    & (F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key"))) \
        .select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"))
    pairs = scratch_table((pairs if more is None else pairs.unionByName(more)).distinct(), "pairs")
    if pairs.isEmpty():
        return first
    return first.unionByName(scratch_table(verify(pairs), "edges"))
