"""Operators 11 to 13 against brute force, held-out accuracy and SQL, on given and messy tables."""

import collections
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry.llm import conversations as C
from quarry.llm import language as L
from quarry.llm import phrases as P

SF = "/root/testdata/sf0.001"
CLASH = ["key", "n", "phrase", "bucket", "seq", "chunk", "id", "__text", "score", "h"]


def clash(df):
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


# ------------------------------------------------------------------ 13
TEXTS = [("en", "the Red fox, the red fox! the red fox runs. The red\tfox  runs"), ("en", "red fox; red fox: fox red\nred fox"), (None, "Été chaud Été chaud"),
         ("en", None), ("de", ""), ("en", " , . "), ("en", "red fox " * 300), (None, "a a a a a a a a"), ("en", "the Red fox, the red fox! the red fox runs. The red\tfox  runs")]


def brute_collocations(rows, max_words, min_count, share, first):
    counts = collections.Counter()
    for lang, text in rows:
        lang, text = lang or "und", (text or "").translate(str.maketrans(P.UPPER, P.LOWER))
        for piece in re.split("[.,;:!?\n-\r]", text):
            w = re.findall("[^ \t]+", piece)
            counts.update((lang, tuple(w[i:i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    totals = collections.Counter()
    for (lang, p), f in counts.items():
        totals[lang] += f * (len(p) == 1)
    cand = {x: f for x, f in counts.items() if len(x[1]) > 1 and f >= min_count}
    out = []
    for lang in totals:
        rows_of = []
        for (ln, p), a in cand.items():
            if ln != lang:
                continue
            if any(g == lang and len(q) > len(p) and 100 * f >= share * a and any(q[i:i + len(p)] == p for i in range(len(q))) for (g, q), f in cand.items()):
                continue
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            rows_of.append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]]))
        for rank, (s, a, p, lf, rf) in enumerate(sorted(rows_of)[:first], 1):
            out.append((lang, rank, p.decode(), -a, lf, rf, totals[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("max_words,min_count,share,first", [(3, 2, 50, 2000), (2, 3, 50, 2000), (4, 2, 80, 3), (3, 10, 50, 2000)])
def test_collocations_match_brute_force(spark, max_words, min_count, share, first):
    docs = clash(spark.createDataFrame(TEXTS, "lang string, text string"))
    got = sorted(tuple(r) for r in P.collocations(docs, max_words, min_count, share, first).collect())
    assert got == brute_collocations(TEXTS, max_words, min_count, share, first)


def test_collocations_flush_and_common_prefixes(spark, monkeypatch):
    """Tasks that hand on after every few windows, and prefixes spread by their last word, change nothing."""
    monkeypatch.setattr(P, "ENTRIES", 5)
    monkeypatch.setattr(P, "COMMON", 0.01)
    docs = spark.createDataFrame(TEXTS, "lang string, text string")
    assert P.common_prefixes(docs, 3, "text", "lang")[0]
    got = sorted(tuple(r) for r in P.collocations(docs, 3, 2).collect())
    assert got == brute_collocations(TEXTS, 3, 2, 50, 2000)


def test_collocations_languages_share_a_flushing_task(spark, monkeypatch):
    """A task that holds several languages hands on none of the windows that a piece's end opens."""
    monkeypatch.setattr(P, "ENTRIES", 40)
    rng = random.Random(13)
    rows = [(rng.choice(["en", "de", "fr", None]), " ".join(rng.choice(["red", "fox", "runs,", "home.", "a"]) for _ in range(12))) for _ in range(120)] + [("it", " , . ")] * 3
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    got = sorted(tuple(r) for r in P.collocations(docs, 3, 2).collect())
    assert got == brute_collocations(rows, 3, 2, 50, 2000)


def test_collocations_exact_beyond_64_bits(spark):
    docs = spark.createDataFrame([("en", "x y")] * 3, "lang string, text string")
    row = P.collocations(docs, 2, 1).first()
    assert (row["a"], row["l"], row["r"], row["score"]) == (3, 3, 3, 1_000_000)
    big = spark.sql("select cast(3000000000 as long) a, cast(4000000000 as long) l, cast(5000000000 as long) r")
    over = F.lit(P.SCALE).cast("decimal(7,0)") * (F.col("a").cast("decimal(18,0)") * F.col("a").cast("decimal(18,0)"))
    got = big.select(over.alias("o"), (F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)")).alias("u")).selectExpr("o div u as s").first()["s"]
    assert got == 10**6 * 3000000000**2 // (4000000000 * 5000000000)


def test_collocations_empty(spark):
    assert P.op13_phrases(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert P.op13_phrases(spark.createDataFrame([("en", None), (None, "")], "lang string, text string")).count() == 0


# ------------------------------------------------------------------ 12
def least_repair(kinds):
    """(cost, audit) by relaxation over (turn, state); suffixes compare as (cost, text)."""
    best = {3: (0, ""), 0: (0, "")}

    def insertions(table):
        for _ in range(4):
            for s in range(4):
                new = C.STEP[s, C.NEXT[s]]
                if new in table:
                    cost, audit = table[new]
                    table[s] = min(table.get(s, (10**9, "")), (cost + 3, "I" + audit))
        return table

    best = insertions(best)
    for kind in reversed(kinds):
        letter, fault, here = C.LETTERS[kind // 3], kind % 3, {}
        for s in range(4):
            options = [(best[s][0] + 4, "D" + best[s][1])]
            if fault != C.MUST_GO:
                extra = 3 if fault == C.OPEN else 0
                to = C.STEP[s, C.NEXT[s]]
                options.append((best[to][0] + 3 + extra, "R" + best[to][1]))
                if (s, letter) in C.STEP:
                    to = C.STEP[s, letter]
                    options.append((best[to][0] + extra, "K" + best[to][1]))
            here[s] = min(options)
        best = insertions(here)
    return best[C.START]


def trace_of(kinds):
    state, audit, cost = C.START, "", 0
    for kind, after in zip(kinds, C.vectors(kinds, C.END) if kinds else []):
        x, _, c, state = C.edits(kind, state, after)
        audit, cost = audit + x, cost + c
    x, _, c = C.closing(state)
    return cost + c, audit + x


def test_least_audit_matches_brute_force():
    for n in range(4):
        for kinds in itertools.product(range(12), repeat=n):
            assert trace_of(list(kinds)) == least_repair(kinds), kinds
    rng = random.Random(1)
    for _ in range(2000):
        kinds = [rng.choice([0, 3, 3, 6, 6, 9, 4, 7, 5, 8]) for _ in range(rng.randrange(4, 40))]
        assert trace_of(kinds) == least_repair(kinds), kinds


def test_fix_up_stops_where_vectors_meet():
    rng = random.Random(2)
    for _ in range(300):
        kinds = [rng.randrange(12) for _ in range(30)]
        old, new = (0, 0, 0, 0), C.END
        again = C.backward(kinds, new, old)
        assert (C.backward(kinds, old) if again is None else again) == C.backward(kinds, new)


def talk(conv, n, seed):
    rng = random.Random(seed)
    return [(conv, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool"]), rng.choice(["Yes.", "no", "why?", f"t{t}.", "x\n"])) for t in range(n)]


MESSY = (talk(1, 200, 1) + talk(2, 5, 2) + talk(None, 30, 3) + [(3, None, "user", None), (3, None, "user", "a."), (3, 4, None, "b."), (3, 4, "", "c."), (4, 0, "user", ""), (5, 1, "assistant", "ok.")]
         + [(6, 2, "user", "same.")] * 4 + [(7, 0, "system", "only."), (8, 3, "user", "x" * 200_000), (8, 9, "assistant", "é\U0001F600.")])
SCHEMA = "conv_id long, turn long, role string, text string"


def by_sql(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE conversations(conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    rel = con.sql(C.OP12_SQL)
    names = [d[0] for d in rel.description]
    return {r[0]: dict(zip(names, r)) for r in rel.fetchall()}


@pytest.mark.parametrize("chunk_rows", [50_000, 25])
def test_conversations_match_sql(spark, monkeypatch, chunk_rows):
    """Small chunks spread conversations of 200 and 30 turns over many segments."""
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk_rows)
    got = {r["conv_id"]: r.asDict() for r in C.op12_conversations(clash(spark.createDataFrame(MESSY, SCHEMA))).collect()}
    assert got == by_sql(MESSY)


def test_repaired_turns_keep_the_grammar(spark):
    found, rows, trace = C.repair(spark.createDataFrame(MESSY, SCHEMA))
    audits = {r["key"]: r["audit"] for r in found.collect()}
    seen = collections.defaultdict(list)
    for r in C.repaired_turns(rows, trace).orderBy("key", "position").collect():
        seen[r["key"]].append(r)
        assert audits[r["key"]][r["position"]] == r["edit"]
    for key, parts in seen.items():
        assert re.fullmatch("(s?(ua)+)?", "".join(r["role"][0] for r in parts))
    assert {k for k, a in audits.items() if set(a) <= {"D"}} == set(audits) - set(seen)


def test_conversations_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert C.op12_conversations(none).count() == 0
    assert C.repair(none)[0].count() == 0


# ------------------------------------------------------------------ 11
def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = L.op11_language(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.filter("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_language_messy(spark):
    plain = [("en", "the cat sat on the mat and the dog was with them"), ("fr", "le chat est sur le tapis et le chien avec eux")]
    rows = [(i, f"{t} {'the' if lang == 'en' else 'le'} {i % 7}", lang) for i in range(80) for lang, t in plain]
    rows += [(1000, None, "en"), (1001, "", None), (1002, "12 34 !?", "fr"), (None, "the dog and the cat", None), (1003, "le chien " * 50_000, None), (1003, "le chien", None),
             (1004, "γεια σου κόσμε", None)]
    docs = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = [r.asDict() for r in L.op11_language(docs).collect()]
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    assert all(by_id[i][0]["lang_pred"] == "und" and by_id[i][0]["score"] == 0 for i in (1000, 1001, 1002))
    assert by_id[None][0]["lang_pred"] == "en" and {r["lang_pred"] for r in by_id[1003]} == {"fr"}
    assert by_id[1004][0]["rejected"] and by_id[1004][0]["lang_pred"] in ("en", "fr")
    assert not by_id[3][0]["rejected"]


def test_language_nothing_to_learn(spark):
    assert L.op11_language(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    got = L.op11_language(spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")).collect()
    assert {r["lang_pred"] for r in got} == {"und"}


def test_language_blocks_give_the_same(spark, monkeypatch):
    """Languages handed out in blocks of one."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in L.op11_language(docs).collect()}
    monkeypatch.setattr(L, "BLOCK", 1)
    assert {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in L.op11_language(docs).collect()} == whole


def test_language_learns_outside_the_fold_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    key = lambda df: {r["doc_id"]: (r["lang_pred"], r["score"]) for r in L.op11_language(df).collect()}
    assert key(docs) == key(other)


# ------------------------------------------------------------------ 10, long texts
def test_secrets_of_a_long_text_full_of_keys(spark):
    """Places over several slices of matches, some too short to count, against a plain scan."""
    from quarry.llm import secrets as S
    text = "é\U0001F600 ".join(f"token = {'x' * (3 + i % 9)}{i} " for i in range(3 * S.SLICE + 5)) + "AKIA" + "Z" * 40
    row = S.op10_secrets(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = [(m.start(), m.end()) for m in re.finditer(S.RULES[0].pattern, text) if len(m[2]) >= 6]
    got = [tuple(map(int, x.split(":")[1:])) for x in row["spans"].split(",") if x.startswith("assign:")]
    assert got == want and row["n_assign"] == len(want) > 2 * S.SLICE and row["n_access"] == 1
