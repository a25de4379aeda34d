"""Operator 7, MinHash near-dedup: SuperMinHash signatures, banding, verification, grouping.

1. Signatures.  Each element draws a random permutation of the signature's
   positions; its rank-j position receives j plus a uniform fraction, and every
   position keeps its minimum.  The ranks of one element are distinct, which
   lowers the variance.  A document stops as soon as every position holds a
   value below the next rank: long texts after one to three ranks.
2. Documents with the same set form one class; only classes go on.
3. Banding: 32 bands of 4 positions; at a similarity of 0.8 all bands miss a
   pair with a probability of 5e-8.
4. Candidates are verified on the full sets (:func:`verified_pairs`), and
   :func:`~quarry.llm.common.bucket_edges` picks the candidates that can
   still join two groups, so large groups of copies are not expanded;
   :func:`split_by_rarity` leaves those out that cannot reach the threshold.
5. Groups: connected components of the verified links, by rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bucket_edges, components, keep_rows, same_row, scratch_table, text_or_empty

MASK = np.uint64(0xFFFFFFFF)
STEP = np.uint64(0x9E3779B97F4A7C15)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
CHUNK_WORDS = 100_000  # words worked on at once: bounds the memory of a task
CACHE_WORDS = 300_000
RARE_DF = 32  # a shingle that so many of the documents in question hold is rare


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of the splitmix64 generator."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHE_WORDS:
            self[word] = h
        return h


_WORDS = WordHashes()


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, split at the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_sets(docs: list[list[bytes]], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingles of each document; shorter ones are one shingle of their whole sequence."""
    lens = np.array([len(d) for d in docs], dtype=np.int64)
    total = int(lens.sum())
    flat = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(docs)), dtype=np.uint64, count=total)
    first = np.zeros(len(docs), dtype=np.int64)
    np.cumsum(lens[:-1], out=first[1:])
    n = max(total - k + 1, 0)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        h = mix64(h * STEP + flat[j:j + n])
    out = []
    for i, m in zip(first.tolist(), lens.tolist(), strict=True):
        if m >= k:
            out.append(np.unique(h[i:i + m - k + 1]))
        elif m:
            x = np.array([m], dtype=np.uint64)
            for j in range(m):
                x = mix64(x * STEP + flat[i + j:i + j + 1])
            out.append(x)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], size: int) -> np.ndarray:
    """(documents, size) signatures; a value is rank * 2^32 + fraction, all ones where the set is empty."""
    n = len(sets)
    lens = np.array([len(s) for s in sets])
    sig = np.full(n * size, EMPTY, dtype=np.uint64)
    elem = np.concatenate(sets) if n else np.empty(0, dtype=np.uint64)
    doc = np.repeat(np.arange(n), lens)
    ranks = None
    for j in range(size):
        if not len(elem):
            break
        x = mix64(elem + np.uint64((j + 1) * int(STEP) & (2**64 - 1)))
        pick = j + (((x & MASK) * np.uint64(size - j)) >> np.uint64(32)).astype(np.int64)
        rows = np.arange(len(elem))
        place = pick if ranks is None else ranks[rows, pick]
        np.minimum.at(sig, doc * size + place, (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32)))
        # stop documents whose positions are all filled: later ranks only bring larger values
        still = (sig.reshape(n, size) == EMPTY).any(axis=1)[doc]
        if ranks is None:
            elem, doc, pick = elem[still], doc[still], pick[still]
            ranks = np.tile(np.arange(size, dtype=np.uint8), (len(elem), 1))
            ranks[np.arange(len(elem)), pick] = 0
        else:
            ranks[rows, pick] = ranks[rows, j]
            if not still.all():
                elem, doc, ranks = elem[still], doc[still], ranks[still]
    return sig.reshape(n, size)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(documents, bands) 64-bit keys; the band's number is part of the key."""
    part = sig.reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * STEP, part.shape[:2]).copy()
    for j in range(part.shape[2]):
        key = mix64(key * STEP + part[:, :, j])
    return key.view(np.int64)


def _chunks(texts: pd.Series) -> Iterator[tuple[int, list[list[bytes]]]]:
    start, docs, total = 0, [], 0
    for i, t in enumerate(texts):
        docs.append(words_of(t))
        total += len(docs[-1])
        if total >= CHUNK_WORDS:
            yield start, docs
            start, docs, total = i + 1, [], 0
    if docs:
        yield start, docs


def signatures(texts: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """``texts(id, row_no, thash, text)`` -> id, row_no, thash, n_shingles, set_key, keys."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, docs in _chunks(b["text"]):
                sets = shingle_sets(docs, k)
                keys = band_keys(super_minhash(sets, bands * rows), bands)
                part = b.iloc[at:at + len(docs)]
                yield pd.DataFrame({
                    "id": part["id"].to_numpy(), "row_no": part["row_no"].to_numpy(), "thash": part["thash"].to_numpy(),
                    "n_shingles": [len(s) for s in sets],
                    "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                    "keys": list(keys)})
    id_type = texts.schema["id"].dataType.simpleString()
    return texts.mapInPandas(run, f"id {id_type}, row_no long, thash long, n_shingles long, set_key binary, keys array<long>")


def shingle_table(texts: DataFrame, k: int) -> DataFrame:
    """``texts(cid, text)`` -> cid, shingles: the full sets, for verification."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, docs in _chunks(b["text"]):
                yield pd.DataFrame({"cid": b["cid"].iloc[at:at + len(docs)].to_numpy(),
                                    "shingles": [s.view(np.int64) for s in shingle_sets(docs, k)]})
    return texts.mapInPandas(run, "cid long, shingles array<long>")


def verified_pairs(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on the full sets."""
    left = pairs.join(sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), "a")
    both = left.join(sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb")), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * inter >= percent * (F.size("sa") + F.size("sb") - inter)).select("a", "b")


def split_by_rarity(rest: DataFrame, sets: DataFrame, percent: int, rare_df: int = RARE_DF):
    """Exact split of the pairs still to test among ``rest(id, comp, n)`` by the shingles that few of them hold.

    Ordered by frequency, two linked documents share one of their first
    n - ceil(percent * n / 100) + 1 shingles.  (i) If a rare one is shared there,
    the pair is found by a join on it, at most ``rare_df`` documents a shingle.
    (ii) Otherwise the pair shares no rare shingle at all: only a document whose
    rare ones all stand in that prefix can have such a partner, and the
    shingles that are not rare bound the intersection.
    """
    held = rest.join(sets.select(F.col("cid").alias("id"), "shingles"), "id").select("id", "comp", "n", F.explode("shingles").alias("shingle"))
    df = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") <= rare_df)
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = held.join(df, "shingle").groupBy("id", "comp", "n").agg(
        F.count(F.lit(1)).alias("rare"), F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("list")) \
        .select("id", "comp", "n", "rare", F.slice("list", F.lit(1), first.cast("int")).alias("list"), (F.col("rare") < first).alias("open"))
    rare = scratch_table(rare, "rare")
    near = rare.select("id", "comp", "n", F.explode("list").alias("x")).filter("x.df > 1").select("id", "comp", "n", "x.shingle")
    a, b = (near.select("shingle", *[F.col(c).alias(f"{side}_{c}") for c in ("id", "comp", "n")]) for side in "ab")
    pairs = a.join(b, "shingle").filter((F.col("a_comp") != F.col("b_comp")) & (F.col("a_id") < F.col("b_id"))
                                        & (100 * F.col("b_n") >= percent * F.col("a_n")) & (100 * F.col("a_n") >= percent * F.col("b_n"))) \
        .select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    known = rest.select("id").distinct().join(rare.select("id", "rare", "open"), "id", "left") \
        .select("id", F.coalesce("rare", F.lit(0)).alias("rare"), F.coalesce("open", F.lit(True)).alias("open")).filter("open")

    def condition(x: str, y: str):
        most = F.least(F.col(f"{x}_n") - F.col(f"{x}_rare"), F.col(f"{y}_n") - F.col(f"{y}_rare"))
        return 100 * most >= percent * (F.col(f"{x}_n") + F.col(f"{y}_n") - most)

    return known, pairs, ["rare"], condition


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
                    bands: int = 32, rows: int = 4) -> DataFrame:
    """One row per input row: id, row_no, thash, n_shingles, component_id, kept.

    Sets are distinct ``k``-word shingles of the whole text; two texts are
    linked when 100 * intersection >= ``percent`` * union.  ``component_id`` is
    the smallest id reachable by links.  Null, empty and word-free texts have
    no shingles, link with nothing and stay.  Rows of a group tie on their id:
    of those the first one read stays; a null id only stays in a group without
    another id, whose ``component_id`` is null.  An empty table gives an empty
    result; other columns are not read.
    """
    base = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"),
                       F.xxhash64(text_or_empty(text_col)).alias("thash"), text_or_empty(text_col).alias("text"))
    sig = scratch_table(signatures(base, k, bands, rows), "signatures")
    # one class per set: its number is its first row's; a hot class is reduced map-side
    classes = sig.filter("n_shingles > 0").groupBy("set_key").agg(F.min("row_no").alias("cid"))
    named = sig.select("row_no", "id", "thash", "n_shingles", "keys").join(classes.select(F.col("cid").alias("row_no"), "cid"), "row_no")
    named = scratch_table(named, "classes")
    members = named.select(F.explode("keys").alias("key"), F.col("cid").alias("id"), F.col("n_shingles").alias("n"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("key")
    members = scratch_table(members.join(shared, "key"), "members")

    wanted = named.join(members.select(F.col("id").alias("cid")).distinct(), "cid", "left_semi").select("id", "thash", "cid")
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("thash"), text_or_empty(text_col).alias("text"))
    found = same_row(texts, wanted.hint("shuffle_hash"), ["id", "thash"], "inner").select("cid", "text")
    sets = scratch_table(shingle_table(found, k).dropDuplicates(["cid"]) if _repeats(sig) else shingle_table(found, k), "sets")

    def sizes_allow(a: str, b: str):
        return 100 * F.least(f"{a}_n", f"{b}_n") >= percent * F.greatest(f"{a}_n", f"{b}_n")

    edges = bucket_edges(members, ["n"], sizes_allow, lambda pairs: verified_pairs(pairs, sets, percent),
                         lambda rest: split_by_rarity(rest, sets, percent))
    comp = components(edges).withColumnRenamed("id", "cid")
    group = classes.join(comp, "cid", "left").select("set_key", F.coalesce("comp", "cid").alias("comp"))
    # the row of each group that stays: spread over the classes first, then over the groups
    best = sig.filter("n_shingles > 0").groupBy("set_key").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row_no")).alias("best"))
    per_class = best.join(group, "set_key")
    per_group = per_class.groupBy("comp").agg(F.min("best").alias("best"))
    keep = scratch_table(group.join(per_group, "comp").select("set_key", "best"), "keep")
    run = sig.withColumn("run", F.shiftright("row_no", 33))  # input partition of the row
    spread = run.filter("n_shingles > 0").select("run", "set_key").distinct().join(keep, "set_key")
    out = run.join(spread, ["run", "set_key"], "left")
    alone = F.col("n_shingles") == 0
    return out.select("id", "row_no", "thash", "n_shingles", F.when(alone, F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
                      (alone | (F.col("best.row_no") == F.col("row_no"))).alias("kept"))


def _repeats(sig: DataFrame) -> bool:
    return sig.groupBy("id", "thash").count().filter("count > 1").limit(1).count() > 0


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """``docs`` with one row of each group of near duplicates; all columns unchanged."""
    survivors = near_duplicates(docs, id_col, text_col, **params).filter("kept").select("id", "thash")
    return keep_rows(docs, survivors, id_col, text_col)


def op7_minhash(docs: DataFrame) -> DataFrame:
    d = near_duplicates(docs, k=4, percent=80)
    return d.select(F.col("id").alias("doc_id"), "n_shingles", "component_id",
                    F.coalesce(F.col("id") == F.col("component_id"), F.col("kept")).alias("kept"))


OP7_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n_words, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
grams AS (SELECT doc_id, n_words, i, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x FROM words),
distinct_grams AS (SELECT DISTINCT doc_id, x FROM grams WHERE i <= greatest(n_words - 3, 1)),
one AS (SELECT doc_id, x, count(*) OVER (PARTITION BY doc_id) AS n FROM distinct_grams),
links AS (
  SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS i
                    FROM one a JOIN one b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL) p
  WHERE 100 * i >= 80 * (na + nb - i)),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT r.doc_id, coalesce(any_value(o.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, r.doc_id = min(other) AS kept
FROM reach r LEFT JOIN (SELECT doc_id, any_value(n) AS n FROM one GROUP BY doc_id) o USING (doc_id) GROUP BY r.doc_id
"""
