"""Operator 11, language identification: nearest centroid over TF-IDF vectors of character n-grams.

A text's letters, lower-cased and with one blank between runs, give n-grams of
one to three characters, hashed into ``DIMS`` buckets.  Words that hold a digit
or an @ (addresses, keys, numbers with units) say nothing about the language and
are left out while other letters remain.  Vectors are log term
counts times inverse document frequencies, normalised.  Document frequencies
come from all training documents.  Each language gets several centroids:
spherical k-means over a bounded sample of its distinct training texts
(``SAMPLE`` per language, the smallest text hashes).  A text goes to the language
of the centroid of highest cosine; it is *rejected* when that cosine is farther
from 1 than nearly all training texts of its length were.

The model is handed to the tasks in blocks of ``BLOCK`` languages
(``BLOCK * CENTROIDS * DIMS`` floats, 16 MB, whatever the number of languages);
a text's best language is carried from block to block.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import scratch_table

DIMS, CENTROIDS, SAMPLE, BLOCK = 1 << 13, 4, 1000, 128
ROUNDS = 8            # of k-means
TEMPERATURE = 0.05    # of the score, in cosine
CROPS = (16, 64, 256)  # sampled texts are also cut to so many characters, for the distances of short texts
BINS, TAIL, SLACK = 16, 0.995, 0.05  # length classes (powers of two), share of training distances inside, margin
UNKNOWN = "und"

_classes: np.ndarray | None = None


def _letter_table() -> np.ndarray:
    """Per code point: 2 letter, 1 mark inside a word, 3 white space, 4 digit or @, 0 other."""
    global _classes
    if _classes is None:
        import unicodedata
        _classes = np.zeros(0x110000, dtype=np.uint8)
        for i in range(0x34000):  # letters end below; the planes above hold none
            kind = unicodedata.category(chr(i))
            _classes[i] = 2 if kind[0] == "L" else 1 if kind[0] == "M" else 3 if chr(i).isspace() else 4 if kind == "Nd" or i == 64 else 0
    return _classes


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(bucket ids, counts) of the whole text's n-grams; empty without letters."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = _letter_table()[codes]
    if not (kind == 2).any():
        return np.empty(0, dtype=np.int64), np.empty(0)
    word = np.cumsum(kind == 3)
    named = np.bincount(word, weights=kind == 4)[word] > 0
    if ((kind == 2) & ~named).any():
        kind = np.where(named, 0, kind)
    codes = np.where((kind == 1) | (kind == 2), codes, 32).astype(np.uint64)
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint64)
    codes = codes[(codes != 32) | np.concatenate([[True], codes[:-1] != 32])]
    one, two, three = codes[1:-1], codes[:-1] * np.uint64(0x9E3779B97F4A7C15) + codes[1:], None
    three = two[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + codes[2:]
    mixed = np.concatenate([one[one != 32] * np.uint64(0x165667B19E3779F9), two * np.uint64(0xD6E8FEB86659FD93), three * np.uint64(0xA0761D6478BD642F)])
    found = np.bincount((mixed >> np.uint64(64 - 13)).astype(np.int64), minlength=DIMS)
    ids = np.flatnonzero(found)
    return ids, found[ids].astype(float)


def vector(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ids, counts = gram_counts(text)
    values = (1.0 + np.log(counts)) * idf[ids]
    norm = np.sqrt((values * values).sum())
    return ids, (values / norm if norm > 0 else values).astype(np.float32)


def length_bin(grams: int) -> int:
    return min(int(np.log2(max(grams, 1))), BINS - 1)


@dataclass
class Model:
    """``blocks``: (languages of each centroid, centroids as rows); ``limits``: largest accepted distance per length class."""
    idf: np.ndarray
    blocks: list[tuple[list[str], np.ndarray]] = field(default_factory=list)
    limits: np.ndarray = field(default_factory=lambda: np.full(BINS, 2.0))


def cluster(vectors: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means from far-apart rows; the order of rows does not matter beyond ties."""
    seeds = [vectors.mean(axis=0)]
    near = vectors @ seeds[0]
    seeds = [vectors[int(near.argmax())]]
    near = vectors @ seeds[0]
    while len(seeds) < min(k, len(vectors)) and near.min() < 0.999:
        seeds.append(vectors[int(near.argmin())])
        near = np.maximum(near, vectors @ seeds[-1])
    centres = np.array(seeds)
    for _ in range(rounds):
        mine = (vectors @ centres.T).argmax(axis=1)
        sums = np.array([vectors[mine == c].sum(axis=0) for c in range(len(centres)) if (mine == c).any()])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres.astype(np.float32)


def document_frequencies(train: DataFrame) -> tuple[int, np.ndarray]:
    """Number of training texts with letters and, per bucket, how many hold it; one row per bucket and task is summed."""
    def count(batches):
        total, found = 0, np.zeros(DIMS, dtype=np.int64)
        for b in batches:
            for text in b["text"]:
                ids, _ = gram_counts(text)
                found[ids] += 1
                total += len(ids) > 0
        yield pd.DataFrame({"bucket": np.arange(-1, DIMS), "n": np.concatenate([[total], found])})

    rows = train.select("text").mapInPandas(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(DIMS + 1, dtype=np.int64)
    for r in rows:
        df[r["bucket"] + 1] = r["n"]
    return int(df[0]), df[1:]


def sampled_texts(train: DataFrame, per_language: int = SAMPLE) -> DataFrame:
    """(lang, text): the ``per_language`` distinct texts of smallest hash per language; a language's rows are thinned before they are ranked."""
    from pyspark.sql import Window
    hashed = train.withColumn("h", F.xxhash64("text"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * per_language) / F.col("n"))
    thin = hashed.join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, "lang") \
        .filter(F.pmod("h", F.lit(1 << 20)) < share * F.lit(1 << 20)).dropDuplicates(["lang", "h"])
    return thin.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).filter(F.col("nth") <= per_language).select("lang", "text")


def fit(train: DataFrame, per_language: int = SAMPLE) -> Model:
    """Model of ``train(lang, text)``: non-null languages; texts without a letter teach nothing."""
    total, df = document_frequencies(train)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    model = Model(idf)
    if not total:
        return model
    sample = scratch_table(sampled_texts(train.filter(F.col("text").rlike(r"\p{L}")), per_language), "language-sample")

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        dense = np.zeros((len(group), DIMS), dtype=np.float32)
        for i, text in enumerate(group["text"]):
            ids, values = vector(text, idf)
            dense[i, ids] = values
        dense = dense[np.abs(dense).sum(axis=1) > 0]
        found = cluster(dense) if len(dense) else dense
        return pd.DataFrame({"lang": [group["lang"].iloc[0]] * len(found), "centre": [c.tolist() for c in found]})

    rows = scratch_table(sample.groupBy("lang").applyInPandas(centroids, "lang string, centre array<float>"), "language-centres")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    for at in range(0, len(langs), BLOCK):
        part = rows.filter(F.col("lang").between(langs[at], langs[min(at + BLOCK, len(langs)) - 1])).orderBy("lang", "centre").collect()
        model.blocks.append(([r["lang"] for r in part], np.array([r["centre"] for r in part], dtype=np.float32)))
    model.limits = distance_limits(sample, model)
    return model


def distance_limits(sample: DataFrame, model: Model) -> np.ndarray:
    """Largest accepted distance per length class: the TAIL quantile of the sampled texts and their crops, plus a margin."""
    crops = sample.select(F.explode(F.array(F.col("text"), *[F.substring("text", 1, n) for n in CROPS])).alias("text"))
    far = nearest(crops, model).filter("grams > 0").select(F.least(F.floor(F.log2("grams")), F.lit(BINS - 1)).alias("bin"), (1 - F.col("cosine")).alias("d"))
    limits = np.full(BINS, np.nan)
    for r in far.groupBy("bin").agg(F.percentile_approx("d", TAIL, 1000).alias("d")).collect():
        limits[r["bin"]] = r["d"] + SLACK
    known = np.flatnonzero(~np.isnan(limits))
    return np.interp(np.arange(BINS), known, limits[known]) if len(known) else np.full(BINS, 2.0)


def best_column(text: Column, prior: Column, idf: np.ndarray, langs: list[str], centres: np.ndarray):
    """struct(lang, cosine, mass, grams): the nearest centroid's language so far, summed exp of the languages' best cosines."""
    order = sorted(set(langs))
    first = np.array([langs.index(x) for x in order])

    @F.pandas_udf("lang string, cosine double, mass double, grams long")
    def best(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        out_lang, cosine, mass, grams = list(before["lang"]), before["cosine"].to_numpy(float).copy(), before["mass"].to_numpy(float).copy(), np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            ids, values = vector(text, idf)
            grams[i] = len(ids)
            if not len(ids):
                continue
            near = np.maximum.reduceat(centres[:, ids].astype(float) @ values.astype(float), first)
            top = int(near.argmax())
            mass[i] += np.exp((near - 1.0) / TEMPERATURE).sum()
            if near[top] > cosine[i]:
                out_lang[i], cosine[i] = order[top], near[top]
        return pd.DataFrame({"lang": out_lang, "cosine": cosine, "mass": mass, "grams": grams})
    return best(text, prior)


def nearest(texts: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns, lang, cosine, score, grams per row of ``texts``; lang is null without letters or model."""
    best = F.struct(F.lit(None).cast("string").alias("lang"), F.lit(-1.0).alias("cosine"), F.lit(0.0).alias("mass"), F.lit(0).cast("long").alias("grams"))
    out = texts.select(*[F.col(c) for c in keep or []], F.coalesce(F.col(text_col), F.lit("")).alias("__text"), best.alias("__best"))
    for langs, centres in model.blocks:
        out = out.withColumn("__best", best_column(F.col("__text"), F.col("__best"), model.idf, langs, centres))
    b = F.col("__best")
    score = F.when(b["mass"] > 0, F.least(F.exp((b["cosine"] - 1.0) / TEMPERATURE) / b["mass"], F.lit(1.0))).otherwise(0.0)
    return out.select(*(keep or []), b["lang"].alias("lang"), b["cosine"].alias("cosine"), score.alias("score"), b["grams"].alias("grams"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held_fold: int = 2,
             per_language: int = SAMPLE) -> tuple[DataFrame, Model]:
    """(id, held_out, lang, score, cosine, rejected) per row, and the model.

    Learns from rows whose crc32 fold is not ``held_fold`` and whose language is
    not null.  Null texts and texts without a letter are ``und`` with score 0, and
    so is every text when nothing can be learned.  A rejected text keeps its
    nearest language, with half the score.  Repeated rows are scored each, null ids
    are the empty text in the fold, an empty table gives no rows, other columns
    are not read.
    """
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held_fold
    rows = docs.select(F.col(id_col).alias("id"), fold.alias("held_out"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(rows.filter("not held_out and lang is not null and text is not null").select("lang", "text"), per_language)
    found = nearest(rows.select("id", "held_out", "text"), model, keep=["id", "held_out"])
    limit = F.element_at(F.array(*[F.lit(float(x)) for x in model.limits]), F.least(F.floor(F.log2(F.greatest("grams", F.lit(1)))), F.lit(BINS - 1)).cast("int") + 1)
    rejected = F.col("lang").isNull() | (1 - F.col("cosine") > limit)
    return found.select("id", "held_out", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.when(rejected, F.col("score") / 2).otherwise(F.col("score")).alias("score"),
                        "cosine", rejected.alias("rejected")), model


def op11_language(docs: DataFrame) -> DataFrame:
    found, _ = identify(docs)
    return found.select(F.col("id").alias("doc_id"), "held_out", F.col("lang").alias("lang_pred"), "score", "rejected")
