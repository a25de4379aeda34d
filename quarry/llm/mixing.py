"""Operator 8, mixing sources to target weights: multivariate-hypergeometric splitting tree.  DataFrame operations only.

1. Documents of a source are dealt into blocks by a hash of their id (about
   ``block_docs`` each), so a block is a random subset and the order of the
   blocks a random permutation.
2. Targets: each source takes whole passes over its blocks and then the first
   blocks of the permutation until the target is reached; inside the last
   block whole documents are taken up to the target, and one more if it closes
   the gap better.
3. Splitting tree: the block draws of all sources are split among the output
   shards.  Each node gives its left half a multivariate-hypergeometric share
   of its per-source quotas (one exact univariate draw per source, given what
   is left), and the right half the remainder: quotas add up exactly at every
   level.  A shard owns consecutive draws of each source's permutation.  There
   are about as many shards as blocks a shard, so the tables of quotas grow
   with the square root of the corpus.
4. Local shuffle: every copy gets a random ``order_key``, and ``write_shards``
   writes each shard in that order.

The tables per source and per shard have one row per source and shard; the
tables of documents are only grouped by (source, block), so a source with a
third of all rows is spread over its blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import DIMENSION_ROWS, WORD, same_row, scratch_table, text_or_empty

SUPER = 1024  # blocks per superblock of the running sums


def word_count(col: str) -> Column:
    return F.regexp_count(text_or_empty(col), F.lit(WORD)).cast("long")


def _ln_factorial(x: Column) -> Column:
    """ln x! for a non-negative whole double: exact product to 20, Stirling's series beyond."""
    big = F.greatest(x, F.lit(21.0))
    series = (big + 0.5) * F.log(big) - big + 0.5 * math.log(2 * math.pi) + 1 / (12 * big) - 1 / (360 * big * big * big)
    return F.when(x <= 20, F.log(F.factorial(F.least(x, F.lit(20.0)).cast("int")).cast("double"))).otherwise(series)


def _ln_choose(n: Column, k: Column) -> Column:
    return _ln_factorial(n) - _ln_factorial(k) - _ln_factorial(n - k)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """Quantile ``u`` of the number of good ones among ``draws`` of ``total``, by summing the probabilities.

    The sum runs over mean +- 12 standard deviations (outside lies less than 1e-30).
    """
    n_, k_, d_ = total.cast("double"), good.cast("double"), draws.cast("double")
    safe = F.greatest(n_, F.lit(1.0))
    mean = d_ * k_ / safe
    sd = F.sqrt(F.greatest(mean * (n_ - k_) / safe * (n_ - d_) / F.greatest(n_ - 1, F.lit(1.0)), F.lit(0.0)))
    lo = F.greatest(F.lit(0.0), d_ + k_ - n_, F.floor(mean - 12 * sd - 12).cast("double")).cast("long")
    hi = F.least(d_, k_, F.ceil(mean + 12 * sd + 12).cast("double")).cast("long")
    lo_d = lo.cast("double")
    p_lo = F.exp(_ln_choose(k_, lo_d) + _ln_choose(n_ - k_, d_ - lo_d) - _ln_choose(n_, d_))

    def step(acc: Column, x: Column) -> Column:
        c = acc["c"] + acc["p"]
        xd = x.cast("double")
        ratio = F.try_divide((k_ - xd) * (d_ - xd), (xd + 1) * (n_ - k_ - d_ + xd + 1))
        return F.struct((acc["p"] * F.coalesce(ratio, F.lit(0.0))).alias("p"), c.alias("c"),
                        F.when((acc["got"] < 0) & (c >= u), x).otherwise(acc["got"]).alias("got"))

    start = F.struct(p_lo.alias("p"), F.lit(0.0).alias("c"), F.lit(-1).cast("long").alias("got"))
    return F.aggregate(F.sequence(lo, F.greatest(lo, hi)), start, step, lambda acc: F.when(acc["got"] < 0, hi).otherwise(acc["got"]))


def split_quotas(quotas: Column, node: Column, seed: int) -> Column:
    """Left child's quotas: a multivariate-hypergeometric draw of half the node's block draws."""
    total = F.aggregate(quotas, F.lit(0).cast("long"), lambda a, q: a + q)
    empty = F.array().cast("array<bigint>")
    start = F.struct(F.floor(total / 2).cast("long").alias("draws"), total.alias("total"), empty.alias("out"))

    def step(acc: Column, q: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), node, F.size(acc["out"])), 11).cast("double") * 2.0 ** -53
        drawn = F.array(hypergeometric(acc["total"], q, acc["draws"], u))
        return F.transform(drawn, lambda x: F.struct((acc["draws"] - x).alias("draws"), (acc["total"] - q).alias("total"),
                                                     F.concat(acc["out"], F.array(x)).alias("out")))[0]

    return F.aggregate(quotas, start, step, lambda acc: acc["out"])


def shard_quotas(quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """(idx, ends): per source the running shard quotas, from one row per source ``quotas(idx, draws)``."""
    nodes = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "draws"))), lambda s: s["draws"]).alias("q")) \
        .select(F.lit(0).cast("long").alias("node"), F.coalesce("q", F.array().cast("array<bigint>")).alias("q"))
    for level in range(levels):
        left = nodes.withColumn("left", split_quotas(F.col("q"), F.col("node") * (levels + 1) + level, seed))
        nodes = left.select(F.explode(F.array(
            F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("q")),
            F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("q", "left", lambda a, b: a - b).alias("q")))).alias("n")) \
            .select("n.node", "n.q")
    flat = nodes.select("node", F.posexplode("q").alias("idx", "n"))
    per = flat.groupBy("idx").agg(F.array_sort(F.collect_list(F.struct("node", "n"))).alias("s"))
    ends = F.aggregate("s", F.array().cast("array<bigint>"),
                       lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long")) + x["n"])))
    return per.select(F.col("idx").cast("long").alias("idx"), ends.alias("ends"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, repeats: float) -> DataFrame:
    """Per source: rank, weight and target words.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words; a target stops at ``repeats`` times its source's
    words and the excess is shared again by weight.  In order of
    repeats * words / weight the stopped sources come first, so running sums
    give the final level without iteration.  One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    s = sizes.withColumn("idx", (F.row_number().over(order) - 1).cast("long")) \
        .withColumn("weight", F.element_at(w, (F.col("idx") % len(weights) + 1).cast("int"))) \
        .withColumn("cap", F.col("source_size") * F.lit(repeats))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "idx")
    upto, beyond = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("pos", F.row_number().over(by_cap)) \
        .withColumn("stopped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0))) \
        .withColumn("open_weight", F.sum("weight").over(beyond)) \
        .withColumn("all_words", F.sum("source_size").over(everything).cast("double"))
    s = s.withColumn("level", (F.col("all_words") * share - F.col("stopped")) / F.col("open_weight"))
    first_open = F.min(F.when(F.col("level") < F.col("cap") / F.col("weight"), F.struct("pos", "level"))).over(everything)
    s = s.withColumn("open", first_open)
    target = F.when(F.col("open").isNull() | (F.col("pos") < F.col("open.pos")), F.col("cap")) \
        .otherwise(F.col("open.level") * F.col("weight"))
    return s.withColumn("target", target).select("source", "idx", "weight", "n_docs", "source_size", "target")


def _with_source(rows: DataFrame, sources: DataFrame, n_sources: int, cols: list[str], salts: int = 64) -> DataFrame:
    """Attach source columns: broadcast while the counted sources fit, else joined on (source, salt)."""
    right = sources.select(F.col("source").alias("s_source"), *cols)
    if n_sources <= DIMENSION_ROWS:
        return rows.join(F.broadcast(right), rows["source"].eqNullSafe(F.col("s_source"))).drop("s_source")
    salted = right.withColumn("s_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    left = rows.withColumn("salt", F.pmod(F.hash("key"), F.lit(salts)))
    return left.join(salted, left["source"].eqNullSafe(salted["s_source"]) & (left["salt"] == salted["s_salt"])).drop("s_source", "s_salt", "salt")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, repeats: int = 2, block_docs: int = 256,
                levels: int | None = None, seed: int = 20) -> DataFrame:
    """The mix, one row per input row: id, thash, source, size, source_size, target, copies, taken, shards, order_keys.

    ``copies`` is how often the mix takes the document, ``taken`` its words
    times that, ``shards`` the output shard (of ``2 ** levels``; None: about the
    square root of the block draws) of each copy, and ``order_keys`` each
    copy's place in the shard's random order.
    Size is the number of white-space separated words; null and empty texts
    have size 0 and follow their block's draws.  A null source is a source.
    Rows that repeat id and text are separate documents.  The result depends on
    ids, texts and ``seed`` only, not on partitions.  An empty table gives an
    empty result; other columns are not read.
    """
    leaf = scratch_table(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        F.xxhash64(text_or_empty(text_col)).alias("thash"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"),
        F.monotonically_increasing_id().alias("row_no")), "sizes")
    sizes = leaf.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"))
    words = F.col("source_size").cast("double")
    passes = F.when(words <= 0, 0).otherwise(F.least(F.lit(repeats), F.floor(F.col("target") / words))).cast("long")
    sources = source_targets(sizes, weights, share, float(repeats)).withColumn("passes", passes) \
        .withColumn("rest", F.col("target") - F.col("passes") * words) \
        .withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / block_docs)).cast("long"))
    sources = scratch_table(sources, "sources")
    n_sources = sources.count()

    dealt = _with_source(leaf, sources, n_sources, ["idx", "blocks"]) \
        .withColumn("block", F.pmod(F.shiftrightunsigned("key", 7), F.col("blocks")))
    block = scratch_table(dealt.groupBy("idx", "block").agg(F.sum("size").alias("words")), "blocks") \
        .withColumn("sup", F.floor(F.col("block") / SUPER))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    sups = block.groupBy("idx", "sup").agg(F.sum("words").alias("w"))
    sups = sups.select("idx", "sup", F.coalesce(F.sum("w").over(before("idx").orderBy("sup")), F.lit(0)).alias("sup_start"))
    block = block.withColumn("in_sup", F.coalesce(F.sum("words").over(before("idx", "sup").orderBy("block")), F.lit(0))) \
        .join(sups, ["idx", "sup"]).withColumn("start", F.col("sup_start") + F.col("in_sup"))
    numbers = sources.select("idx", "source_size", "target", "passes", "rest", "blocks")
    numbers = F.broadcast(numbers) if n_sources <= DIMENSION_ROWS else numbers
    block = block.join(numbers, "idx")
    block = scratch_table(block.select(
        "idx", "block", "source_size", "target", "passes", "blocks",
        # words of the last pass that this block may give: all, some or none
        F.greatest(F.lit(0.0), F.least(F.col("rest") - F.col("start"), F.col("words"))).alias("room"),
        (F.col("rest") - F.col("start") >= F.col("words")).alias("full"),
        ((F.col("rest") > F.col("start")) & (F.col("rest") - F.col("start") < F.col("words"))).alias("edge")), "drawn")

    draws = scratch_table(block.groupBy("idx").agg((F.max(F.col("passes") * F.col("blocks")) + F.sum((F.col("full") | F.col("edge")).cast("long"))).alias("draws")), "draws")
    if levels is None:
        levels = round(math.log2(max(1, draws.agg(F.sum("draws")).first()[0] or 0)) / 2)
    ends = scratch_table(shard_quotas(draws, levels, seed), "quotas")
    ends = F.broadcast(ends) if n_sources << levels <= DIMENSION_ROWS else ends
    # pass c of block b is draw c * blocks + b of its source; its shard is the one whose quota range holds it
    last = F.greatest(F.col("passes") + (F.col("full") | F.col("edge")).cast("long"), F.lit(1)) - 1
    shard = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda c: F.size(F.filter("ends", lambda e: e <= c * F.col("blocks") + F.col("block"))))
    block = block.join(ends, "idx").withColumn("block_shards", shard).drop("ends")

    rows = dealt.select("id", "source", "size", "thash", "key", "row_no", "idx", "block").join(block, ["idx", "block"])
    edge = rows.filter("edge")
    edge_order = Window.partitionBy("idx", "block").orderBy(F.xxhash64("key", "thash"), "key", "thash", "row_no")
    edge = edge.withColumn("upto", F.sum("size").over(edge_order.rowsBetween(Window.unboundedPreceding, 0))) \
        .withColumn("nth", F.row_number().over(edge_order)).withColumn("taken_in", F.col("upto") <= F.col("room"))
    whole = Window.partitionBy("idx", "block")
    edge = edge.withColumn("gap", F.col("room") - F.max(F.when(F.col("taken_in"), F.col("upto")).otherwise(0)).over(whole)) \
        .withColumn("miss", F.abs(F.col("gap") - F.col("size")))
    closer = F.min(F.when(~F.col("taken_in") & (F.col("miss") < F.col("gap")), F.struct("miss", "nth"))).over(whole)
    edge = edge.withColumn("extra", (F.col("taken_in") | F.coalesce(closer["nth"] == F.col("nth"), F.lit(False))).cast("int"))
    out_cols = ["id", "source", "size", "thash", "key", "idx", "block", "source_size", "target", "passes", "block_shards", "extra"]
    rows = rows.filter("not edge").withColumn("extra", F.col("full").cast("int")).select(*out_cols).unionByName(edge.select(*out_cols))

    copies = (F.col("passes") + F.col("extra")).cast("long")
    rows = rows.withColumn("copies", copies).withColumn("shards", F.slice("block_shards", F.lit(1), F.col("copies").cast("int")))
    order = F.transform("shards", lambda k, c: F.xxhash64(F.lit(seed + 1), "key", "thash", k, c))
    return rows.select("id", "thash", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
                       "shards", order.alias("order_keys"))


def mixed_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """One row per copy that the mix takes: row (all columns of ``docs``), shard, order_key.

    Rows of ``docs`` are joined to their copies on (id, text hash); rows that
    repeat both are numbered on either side, so each takes its own copies.
    """
    plan = scratch_table(mix_sources(docs, id_col, text_col, source_col, **params)
                         .select("id", "thash", F.arrays_zip("shards", "order_keys").alias("taken_as")), "mix")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                         F.xxhash64(text_or_empty(text_col)).alias("thash"))
    if plan.groupBy("id", "thash").count().filter("count > 1").isEmpty():
        packed, plan = packed.withColumn("nth", F.lit(1)), plan.withColumn("nth", F.lit(1))
    else:
        same = Window.partitionBy("id", "thash")
        packed = packed.withColumn("nth", F.row_number().over(same.orderBy(F.hash("row"))))
        plan = plan.withColumn("nth", F.row_number().over(same.orderBy("taken_as")))
    taken = plan.filter(F.size("taken_as") > 0)
    rows = same_row(packed, taken.hint("shuffle_hash"), ["id", "thash", "nth"], "inner")
    return rows.select("row", F.inline("taken_as")).select("row", F.col("shards").alias("shard"), F.col("order_keys").alias("order_key"))


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> None:
    """Write the mix as Parquet, one folder ``shard=k`` per output shard, its rows in random order.

    Rows are ranged by (shard, order_key), so a large shard is several files,
    one after the other in its order, and no task holds more than its range.
    The columns are those of ``docs`` but for one named shard, which gives way.
    """
    rows = mixed_shards(docs, id_col, text_col, source_col, **params)
    rows = rows.repartitionByRange("shard", "order_key").sortWithinPartitions("shard", "order_key")
    rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns if c.lower() != "shard"], "shard") \
        .write.partitionBy("shard").parquet(path)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **params) -> DataFrame:
    """The mixed corpus: ``docs`` columns, each document as often as the mix takes it; none with zero copies.

    Copies keep all columns.  Rows are joined to their copies on (id, text
    hash); rows that repeat both are interchangeable and share their copies'
    total evenly, the first ones taking the remainder.
    """
    plan = mix_sources(docs, id_col, text_col, source_col, **params)
    plan = plan.groupBy("id", "thash").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n"))
    plan = scratch_table(plan, "mix")
    packed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"),
                         F.xxhash64(text_or_empty(text_col)).alias("thash"))
    p = plan.select(F.col("id").alias("p_id"), F.col("thash").alias("p_thash"), "copies", "n").filter("copies > 0").hint("shuffle_hash")
    rows = packed.join(p, packed["id"].eqNullSafe(F.col("p_id")) & (F.col("thash") == F.col("p_thash")))
    if plan.filter("n > 1").limit(1).count():
        nth = F.row_number().over(Window.partitionBy("id", "thash").orderBy(F.hash("row"))) - 1
        share = F.floor(F.col("copies") / F.col("n")) + (nth < F.col("copies") % F.col("n")).cast("int")
    else:
        share = F.col("copies")
    rows = rows.withColumn("times", share.cast("int")).filter("times > 0")
    return rows.select("row", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("copy")) \
        .select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op8_mixing(docs: DataFrame) -> DataFrame:
    m = mix_sources(docs)
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "shards", "order_keys")
