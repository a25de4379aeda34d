"""Operator 9, exact dedup: tree-merge of sorted digest runs.  DataFrame operations only.

Every input partition yields one run: its distinct digests with the
identifier to keep and the number of rows.  Runs are merged in rounds: round r
brings the runs whose number agrees beyond ``fan_in ** r`` together, split into
digest shards so that no round, the last one included, meets in one task.  A
digest has at most one row per run, so a text that fills a third of the table
costs each round at most ``fan_in`` rows per merged run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach_by_key, keep_rows, scratch_table, text_or_empty

DIGEST = ["digest", "n_bytes", "check"]  # SHA-256, and size and a second hash that verify it


def digest_leaf(docs: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """One row per document: id, row number, run (input partition), digest shard, digest and its verifiers."""
    text = text_or_empty(text_col)
    return docs.select(
        F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"),
        F.spark_partition_id().alias("run"), F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).alias("n_bytes"), F.xxhash64(text).alias("check"),
    ).withColumn("shard", F.pmod(F.hash("digest"), F.lit(shards)))


def merge_runs(leaf: DataFrame, keep: str = "max", fan_in: int = 16) -> DataFrame:
    """(digest key, keep, group_size): the binomial rounds over the runs of ``leaf``."""
    pick = F.max if keep == "max" else F.min
    key = ["shard", "run", *DIGEST]
    # null ids sort below every id under "max" and are only kept where a group has no other
    mark = F.struct(F.col("id").isNotNull().alias("has_id") if keep == "max" else F.col("id").isNull().alias("has_id"), "id", "row_no")
    runs = leaf.groupBy(*key).agg(pick(mark).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    last = leaf.agg(F.max("run")).first()[0]
    n_runs = (last or 0) + 1
    while n_runs > 1:
        merged = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        runs = merged.repartition("shard", "run").sortWithinPartitions(*key) \
            .groupBy(*key).agg(pick("keep").alias("keep"), F.sum("group_size").alias("group_size"))
        n_runs = -(-n_runs // fan_in)
    return runs.select(*DIGEST, "keep", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max",
                fan_in: int = 16, shards: int = 4096) -> DataFrame:
    """One row per input row: id, row_no, thash, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty.  Of equal
    texts the row with the largest id stays (``keep="min"``: the smallest); rows
    that repeat the id as well tie, and the one read last (first) stays.  A null
    id stays only in a group without another id, and ``keep_id`` is then null.
    An empty table gives an empty result.  Other columns of ``docs`` are not
    read, whatever their names.
    """
    leaf = scratch_table(digest_leaf(docs, id_col, text_col, shards), "digests")
    merged = merge_runs(leaf, keep, fan_in)
    rows = attach_by_key(leaf, merged, DIGEST, how="inner")
    return rows.select("id", "row_no", F.col("check").alias("thash"), F.col("keep.id").alias("keep_id"), "group_size",
                       (F.col("keep.row_no") == F.col("row_no")).alias("kept"),
                       F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns unchanged."""
    survivors = exact_dedup(docs, id_col, text_col, keep).filter("kept").select("id", "thash")
    return keep_rows(docs, survivors, id_col, text_col)


def op9_exact_dedup(docs: DataFrame) -> DataFrame:
    out = exact_dedup(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
