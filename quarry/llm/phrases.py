"""Operator 13, phrase collocations: top-order windows marginalised to shorter phrases.

Every word opens one window: itself and the next ``max_words - 1`` words of its
piece (lead columns of the word list), padded with nulls at the piece's end.
Only these longest windows are counted, first inside the scanning tasks; a
phrase of k words occurs as often as the windows that begin with it, so ROLLUP
over the window's columns gives the counts of all shorter phrases and, at its
last level, of all words.

Counted windows are dealt out by their prefix (without the last word) in
blocks, so that windows and prefixes are summed in one place after one shuffle.  Prefixes that
a sample shows to be very common are dealt out by their last word too; the sample
decides where rows go, never what is counted.  Before the ROLLUP, what stays below
``min_count`` is folded into its prefix.  That loses nothing: a phrase below
``min_count`` is no candidate, and no part of one, while its occurrences still
count in its prefixes.
"""

from __future__ import annotations

import collections
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import scratch_table

# Fixed values of the contract: letters that are lower-cased, characters that end a piece.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE_ENDS = ".,;:!?\x0a\x0b\x0c\x0d"
SCALE = 1_000_000
PAD = "\x0b"
SALTS = 32
ENTRIES = 400_000  # distinct windows a scanning task counts before it hands them on; windows a bucket is to hold at most
PLACES = 64        # buckets of the sample
SAMPLE_DOCS, COMMON = 4000, 0.001  # a prefix with this share of the sample's windows is dealt out by last word: 1000 prefixes at most


def windows(docs: DataFrame, max_words: int, buckets: int, common: frozenset[str] = frozenset(), text_col: str = "text",
            lang_col: str = "lang") -> DataFrame:
    """(bucket, lang, once, more): padded longest windows counted per task, one a line; ``more`` adds a tab and the count.

    Pads are vertical tabs, which no word holds.  The bucket comes from the
    window's prefix, for ``common`` prefixes from the whole window.  Blocks take
    half the space of single rows.
    """
    table = str.maketrans(UPPER + "\t" + PIECE_ENDS, LOWER + " " + PAD * len(PIECE_ENDS))
    pads = f" {PAD}" * (max_words - 1) + " "
    widespread = collections.defaultdict(set)
    for entry in common:
        lang, _, prefix = entry.partition("\n")
        widespread[lang].add(prefix)

    def blocks(found):
        rows = []
        for lang, counter in found.items():
            once, more = [[] for _ in range(buckets)], [[] for _ in range(buckets)]
            spread = widespread.get(lang, ())
            for phrase, n in counter.items():
                if phrase[0] == PAD:  # opened by no word
                    continue
                key = phrase[:phrase.rindex(" ")]
                if key in spread:
                    key = phrase
                b = zlib.crc32(key.encode("utf-8", "surrogatepass")) % buckets
                if n == 1:
                    once[b].append(phrase)
                else:
                    more[b].append(f"{phrase}\t{n}")
            rows += [(b, lang, "\n".join(x), "\n".join(y)) for b, (x, y) in enumerate(zip(once, more)) if x or y]
        columns = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.string()))],
                                          names=["bucket", "lang", "once", "more"])

    def count(batches):
        found, size = collections.defaultdict(collections.Counter), 0
        for b in batches:
            for lang, text in zip(b.column(0), b.column(1)):
                lang = lang.as_py()
                words = [w for w in f"{text.as_py().translate(table)}{PAD}".replace(PAD, pads).split(" ") if w]
                for at in range(0, len(words), ENTRIES):
                    part = words[at:at + ENTRIES + max_words - 1]
                    c = found[lang]
                    size -= len(c)
                    c.update(map(" ".join, zip(*[part[k:] for k in range(max_words)])))
                    size += len(c)
                    if size > ENTRIES:
                        yield blocks(found)
                        found.clear()
                        size = 0
        if any(found.values()):
            yield blocks(found)

    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(count, "bucket int, lang string, once string, more string")


def summed(blocks: pd.DataFrame) -> dict[str, collections.Counter]:
    """Counts of the windows in blocks, per language."""
    found = collections.defaultdict(collections.Counter)
    for lang, once, more in zip(blocks["lang"], blocks["once"], blocks["more"]):
        c = found[lang]
        if once:
            c.update(once.split("\n"))
        for line in more.split("\n") if more else ():
            phrase, _, n = line.rpartition("\t")
            c[phrase] += int(n)
    return found


def common_prefixes(docs: DataFrame, max_words: int, text_col: str, lang_col: str) -> tuple[list[str], int]:
    """Prefixes, after their language and a line feed, that hold at least COMMON of a sample's windows; windows to be expected in all rows."""
    rows = docs.count()
    if not rows:
        return [], 0
    part = min(1.0, SAMPLE_DOCS / rows)
    blocks = windows(docs.select(text_col, lang_col).sample(part, seed=13), max_words, PLACES, text_col=text_col, lang_col=lang_col)

    def prefixes(pdf: pd.DataFrame) -> pd.DataFrame:
        out = collections.Counter()
        for lang, c in summed(pdf).items():
            for phrase, n in c.items():
                out[f"{lang}\n{phrase[:phrase.rindex(' ')]}"] += n
        return pd.DataFrame({"prefix": list(out), "n": list(out.values())})

    counted = scratch_table(blocks.groupBy("bucket").applyInPandas(prefixes, "prefix string, n long"), "prefixes")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = counted.filter(F.col("n") >= max(COMMON * total, 2)).select("prefix").collect()
    return [r["prefix"] for r in often], int(total / part)


def phrase_counts(docs: DataFrame, max_words: int = 3, min_count: int = 10, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, phrase, k, f): phrases of k words with f >= min_count; k = 0 and phrase '' hold all words of the language."""
    common, expected = common_prefixes(docs, max_words, text_col, lang_col)
    spread = frozenset(common)
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), expected // ENTRIES)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        """A bucket's windows and prefixes that reach min_count; what stays below is added to the next shorter prefix."""
        out = []
        for lang, c in summed(pdf).items():
            prefixes, rest = collections.Counter(), collections.Counter()
            for phrase, n in c.items():
                prefixes[phrase[:phrase.rindex(" ")]] += n
            for phrase, n in c.items():
                if n >= min_count and phrase[-1] != PAD:
                    out.append((lang, phrase, n))
                    rest[phrase[:phrase.rindex(" ")]] -= n
            shorter = collections.Counter()
            for prefix, n in prefixes.items():
                left = n + rest[prefix]
                if n >= min_count or f"{lang}\n{prefix}" in spread:
                    out.append((lang, prefix, left))
                else:
                    shorter[prefix.rpartition(" ")[0] or prefix] += left
            out += [(lang, phrase, n) for phrase, n in shorter.items()]
        return pd.DataFrame(out, columns=["lang", "phrase", "n"])

    folded = windows(docs, max_words, buckets, spread, text_col, lang_col).groupBy("bucket").applyInPandas(fold, "lang string, phrase string, n long")
    columns = [f"w{k + 1}" for k in range(max_words)]
    word = F.split("phrase", " ")
    totals = folded.select("lang", *[F.nullif(F.get(word, F.lit(k)), F.lit(PAD)).alias(c) for k, c in enumerate(columns)], "n") \
        .rollup("lang", *columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("level"))
    rows = []
    for k in range(max_words + 1):  # level of the first k words; padded windows are no phrases of k words
        at = F.col("level") == (1 << (max_words - k)) - 1
        rows.append(F.when(at & (F.col(columns[k - 1]).isNotNull() if k else F.lit(True)), F.lit(k)))
    return totals.select("lang", F.concat_ws(" ", *columns).alias("phrase"), F.coalesce(*rows).alias("k"), "f") \
        .filter("k is not null").filter((F.col("k") == 0) | (F.col("f") >= min_count))


def collocations(docs: DataFrame, max_words: int = 3, min_count: int = 10, share: int = 50, first: int = 2000,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The ``first`` phrases of two to ``max_words`` words per language by their weakest cut.

    Cutting a phrase of count a into parts of counts l and r scores
    floor(10^6 a a / (l r)); the lowest cut counts, ties go to the earliest.
    Phrases inside a longer phrase with at least ``share`` percent of their count
    are left out.  Null texts are empty, null languages are ``und``; an empty table
    gives no rows; repeated rows count each; other columns are not read.
    """
    counts = scratch_table(phrase_counts(docs, max_words, min_count, text_col, lang_col), "phrases")
    phrases = counts.filter("k > 0")
    word = F.split("phrase", " ")
    cand = phrases.filter("k > 1").withColumnRenamed("f", "a")
    cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))) \
        .withColumn("left", F.expr("substring_index(phrase, ' ', cut)")) \
        .withColumn("right", F.expr("substring_index(phrase, ' ', cut - k)"))
    l = phrases.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    r = phrases.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    big = lambda c: F.col(c).cast("decimal(18,0)")
    scored = cuts.join(l, ["lang", "left"]).join(r, ["lang", "right"]) \
        .withColumn("over", F.lit(SCALE).cast("decimal(7,0)") * (big("a") * big("a"))).withColumn("under", big("l") * big("r")) \
        .withColumn("score", F.expr("over div under"))
    best = scored.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("b"))
    inner = cand.filter("k > 2").select("lang", "a", "k", word.alias("words")) \
        .select("lang", "a", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size")) \
        .select("lang", "a", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("at")) \
        .select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "a") \
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))) \
        .select("lang", "phrase", "a", F.col("b.l").alias("l"), F.col("b.r").alias("r"), F.col("b.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    near = kept.withColumn("rank", F.row_number().over(salted)).filter(F.col("rank") <= first)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    total = counts.filter("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def op13_sql() -> str:
    ends = "".join(f"chr({ord(c)})||" for c in PIECE_ENDS)
    return f"""
WITH w AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split(piece, ' '), lambda x: x <> '') AS words
  FROM (SELECT lang, unnest(string_split(translate(coalesce(text, ''), '{UPPER}'||chr(9)||{ends}'', '{LOWER} '||repeat(chr(10), {len(PIECE_ENDS)})), chr(10))) AS piece
        FROM documents)
), p AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM w),
n AS (SELECT lang, count(*) AS n FROM p GROUP BY lang),
f AS (
  SELECT lang, k, phrase, count(*) AS f
  FROM (SELECT lang, 1 AS k, words[i] AS phrase FROM p
        UNION ALL SELECT lang, 2, words[i]||' '||words[i+1] FROM p WHERE i + 1 <= len(words)
        UNION ALL SELECT lang, 3, words[i]||' '||words[i+1]||' '||words[i+2] FROM p WHERE i + 2 <= len(words))
  GROUP BY ALL HAVING count(*) >= 10
), c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE k > 1),
cuts AS (
  SELECT lang, phrase, a, 1 AS cut, s[1] AS lp, array_to_string(s[2:], ' ') AS rp FROM c
  UNION ALL SELECT lang, phrase, a, 2, s[1]||' '||s[2], s[3] FROM c WHERE k = 3
), scored AS (
  SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r,
         CAST((1000000::HUGEINT * a::HUGEINT * a::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, phrase, max(a) AS longer
  FROM (SELECT lang, s[1]||' '||s[2] AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, s[2]||' '||s[3], a FROM c WHERE k = 3)
  GROUP BY ALL
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT best.*, n.n, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank
  FROM best JOIN n USING (lang) LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase
  WHERE longer IS NULL OR 100 * longer < 50 * a)
WHERE rank <= 2000
"""
