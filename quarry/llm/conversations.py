"""Operator 12, conversation structure repair: rank-convergence parallel Viterbi.

Turns are sorted by range partitions; a partition's rows are a *chunk*, so a
conversation of any length is a row of bounded segments.  The cost of the
cheapest repair from each grammar state to the conversation's end is a vector
of four numbers; one turn maps it to the vector before that turn (min-plus).

1. Segments of a conversation that spans chunks run backwards from speculative
   end vectors (all zero; the last from the true end).
2. Fix-up passes hand every segment its successor's start vector.  Vectors are
   kept less their minimum, so vectors that differ by a constant are equal; only
   segments whose end vector changed run again, and stop where the old and the
   new vector meet.  Passes end when none changed.
3. With stitched end vectors each segment maps entry states to exit states; the
   maps are folded along the segments of a conversation.
4. A forward pass traces the ASCII-least of the cheapest edits.

Chunks bound every task's rows; what is gathered per conversation is one row a
segment.  Only the contract's digest, one hash over a whole conversation, reads
a conversation in order; it streams.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach_by_key, scratch_table

# Fixed values of the contract: edit costs, the grammar (s?(ua)+)?, roles of edits.
RETYPE, REMOVE, ADD, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEXT = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}  # the initial that an inserted or retyped turn gets
ROLES = {"u": "user", "a": "assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
LETTERS = "sua?"  # classes of role initials; any other initial fits nowhere
MUST_GO, OPEN = 1, 2  # faults of a kind: blank or duplicate, truncated

CHUNK_ROWS = 50_000
SPACE = r"\x20\x09-\x0D"


# ------------------------------------------------------------------ min-plus steps, on the few vectors that occur
def _insertions(w: list[int]) -> tuple[int, ...]:
    two, three = min(w[USER], ADD + w[ASSISTANT]), min(w[ASSISTANT], ADD + w[USER])
    return min(w[START], ADD + two), min(w[SYSTEM], ADD + two), two, three


END = _insertions([0, 10**6, 10**6, 0])


@functools.lru_cache(maxsize=1 << 16)
def before(kind: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """(vector before a turn of this kind less its minimum, that minimum)."""
    letter, fault = LETTERS[kind // 3], kind % 3
    cost = []
    for s in range(4):
        options = [REMOVE + after[s]]
        if fault != MUST_GO:
            extra = CUT_OFF if fault == OPEN else 0
            options.append(RETYPE + extra + after[STEP[s, NEXT[s]]])
            if (s, letter) in STEP:
                options.append(extra + after[STEP[s, letter]])
        cost.append(min(options))
    full = _insertions(cost)
    low = min(full)
    return tuple(x - low for x in full), low


@functools.lru_cache(maxsize=1 << 16)
def edits(kind: int, state: int, after: tuple[int, ...]) -> tuple[str, str, int, int]:
    """(edits at a turn, initials they give, cost, state after) of the ASCII-least cheapest repair from ``state``."""
    letter, fault = LETTERS[kind // 3], kind % 3
    here, low = before(kind, after)
    extra = CUT_OFF if fault == OPEN else 0
    audit, given, cost = "", "", 0
    while True:
        rest = here[state] + low
        if REMOVE + after[state] == rest:
            return audit + "D", given + "-", cost + REMOVE, state
        new = STEP[state, NEXT[state]]
        if ADD + here[new] + low == rest:
            audit, given, cost, state = audit + "I", given + NEXT[state], cost + ADD, new
        elif fault != MUST_GO and (state, letter) in STEP and extra + after[STEP[state, letter]] == rest:
            return audit + "K", given + letter, cost + extra, STEP[state, letter]
        else:
            return audit + "R", given + NEXT[state], cost + RETYPE + extra, new


def closing(state: int) -> tuple[str, str, int]:
    """Edits after the last turn."""
    audit = given = ""
    while END[state]:
        audit, given, state = audit + "I", given + NEXT[state], STEP[state, NEXT[state]]
    return audit, given, ADD * len(audit)


def backward(kinds, end: tuple[int, ...], known: tuple[int, ...] | None = None) -> tuple[int, ...] | None:
    """Start vector of a segment; None as soon as a run from ``known`` would go the same way."""
    v = end
    for kind in reversed(kinds):
        if v == known:
            return None
        v, _ = before(kind, v)
        if known is not None:
            known, _ = before(kind, known)
    return None if v == known else v


def vectors(kinds, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vector after each turn."""
    out = [end]
    for kind in reversed(kinds[1:]):
        out.append(before(kind, out[-1])[0])
    return out[::-1]


# ------------------------------------------------------------------ turns in order
def conversation_key(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), col.cast("string")))


ORDER = ["key", "turn", "role", "head", "h"]


def turns(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """key, turn, role, text and the order's tie-breakers; null roles and texts are one space."""
    out = rows.select(conversation_key(F.col(conv_col)).alias("key"), F.col(turn_col).cast("long").alias("turn"),
                      F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"))
    return out.select("key", "turn", "role", F.substring("text", 1, 64).alias("head"), F.xxhash64("text").alias("h"), "text")


def in_order(cols: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_first() for c in cols]


def numbered(rows: DataFrame) -> DataFrame:
    """Turns without their texts, sorted into chunks: seq, chunk, the order's columns, kind, fault."""
    text = F.col("text")
    blank = ~text.rlike(f"[^{SPACE}]")
    lean = rows.select(*ORDER, F.xxhash64(F.length("role"), "role", "text").alias("h2"), blank.alias("blank"),
                       (~blank & ~text.rlike(rf"[.!?][{SPACE}]*\z")).alias("open"))
    n = max(1, -(-rows.count() // CHUNK_ROWS))
    ordered = lean.repartitionByRange(n, *in_order(ORDER)).sortWithinPartitions(*in_order(ORDER)) \
        .withColumn("seq", F.monotonically_increasing_id()).withColumn("chunk", F.spark_partition_id())
    leaf = scratch_table(ordered, "turns")
    same = ["key", "role", "h", "h2"]
    first = leaf.groupBy(*same).agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    marked = attach_by_key(leaf, first, same, run="chunk")
    fault = F.when(F.col("blank"), "blank").when(F.col("seq") > F.col("first"), "duplicate").when(F.col("open"), "truncated")
    letter = F.coalesce(F.nullif(F.instr(F.lit(LETTERS[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    letter = F.when(F.col("role") == "", F.lit(3)).otherwise(letter)
    return scratch_table(marked.select("seq", "chunk", *ORDER, fault.alias("fault"))
                         .withColumn("kind", (letter * 3 + F.when(F.col("fault").isNull(), 0).when(F.col("fault") == "truncated", OPEN).otherwise(MUST_GO)).cast("int")), "steps")


# ------------------------------------------------------------------ segments of conversations that span chunks
def stitched(steps: DataFrame) -> DataFrame | None:
    """(key, chunk, end, entry, letter): end vector, entry state and last role class before each such segment; None if there is none."""
    seg = steps.groupBy("key", "chunk").agg(F.max_by("kind", "seq").alias("last"))
    chained = seg.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "last"))).alias("s")).filter("size(s) > 1") \
        .select("key", F.posexplode("s").alias("i", "x"), "s") \
        .select("key", F.col("x.chunk").alias("chunk"), "i", F.get("s", F.col("i") + 1)["chunk"].alias("next"), F.when(F.col("i") > 0, F.get("s", F.col("i") - 1)["last"]).alias("last"))
    chained = scratch_table(chained, "segments")
    if chained.isEmpty():
        return None
    rows = scratch_table(steps.select("key", "chunk", "seq", "kind").join(chained.select("key", "chunk"), ["key", "chunk"]), "spanning")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        old = pdf["old"].iloc[0]
        start = backward(pdf["kind"].tolist(), tuple(pdf["end"].iloc[0]), None if old is None else tuple(old))
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "start": [None if start is None else list(start)]})

    def starts(todo: DataFrame) -> DataFrame:
        return rows.join(todo, ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(run, "key string, chunk int, start array<int>")

    true_end = F.array(*[F.lit(x).cast("int") for x in END])
    zero = F.array(*[F.lit(0)] * 4)
    state = chained.select("key", "chunk", "next", F.when(F.col("next").isNull(), true_end).otherwise(zero).alias("end"))
    state = scratch_table(state.join(starts(state.select("key", "chunk", "end", F.lit(None).cast("array<int>").alias("old"))), ["key", "chunk"]), "vectors")
    while True:
        after = state.select("key", F.col("chunk").alias("next"), F.col("start").alias("given"))
        moved = scratch_table(state.join(after, ["key", "next"]).filter("given <> end").select("key", "chunk", F.col("given").alias("end"), F.col("end").alias("old")), "moved")
        if moved.isEmpty():
            break
        again = starts(moved).join(moved.select("key", "chunk", F.col("end").alias("new_end")), ["key", "chunk"]).withColumnRenamed("start", "new_start")
        state = scratch_table(state.join(again, ["key", "chunk"], "left")
                              .select("key", "chunk", "next", F.coalesce("new_end", "end").alias("end"), F.coalesce("new_start", "start").alias("start")), "vectors")

    def exits(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        kinds = pdf["kind"].tolist()
        after = vectors(kinds, tuple(pdf["end"].iloc[0]))
        out = []
        for s in range(4):
            for kind, v in zip(kinds, after):
                s = edits(kind, s, v)[3]
            out.append(s)
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "exits": [out]})

    maps = rows.join(state.select("key", "chunk", "end"), ["key", "chunk"]).groupBy("key", "chunk").applyInPandas(exits, "key string, chunk int, exits array<int>")
    entries = maps.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("chunk", "exits"))).alias("s")) \
        .select("key", F.expr(f"""aggregate(s, named_struct('at', {START}, 'all', cast(array() as array<struct<chunk:int,entry:int>>)),
                                  (acc, x) -> named_struct('at', get(x.exits, acc.at), 'all', concat(acc.all, array(named_struct('chunk', x.chunk, 'entry', acc.at))))).all""").alias("all")) \
        .select("key", F.inline("all").alias("chunk", "entry"))
    return scratch_table(state.select("key", "chunk", "end").join(entries, ["key", "chunk"])
                         .join(chained.select("key", "chunk", "last"), ["key", "chunk"]), "stitched")


def traced(steps: DataFrame) -> DataFrame:
    """steps with audit (edits at the turn), given (their initials), cost, illegal (bad pair with the turn before)."""
    joints = stitched(steps)
    if joints is None:
        full = steps.select("*", F.lit(None).cast("array<int>").alias("end"), F.lit(START).alias("entry"), F.lit(None).cast("int").alias("last"))
    else:
        full = steps.join(joints, ["key", "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(START)))
    final = F.lit(None) if joints is None else F.col("end")
    full = full.withColumn("end", final.cast("array<int>"))

    def trace(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq", ignore_index=True)
        audit, given, cost, illegal = [], [], [], []
        keys = pdf["key"].to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist() + [len(keys)]
        kinds_of, ends, entry, last = pdf["kind"].tolist(), pdf["end"], pdf["entry"], pdf["last"]
        for a, b in zip(cuts, cuts[1:]):
            kinds = kinds_of[a:b]
            end = END if ends[a] is None else tuple(ends[a])
            state = int(entry[a])
            letter = None if pd.isna(last[a]) else LETTERS[int(last[a]) // 3]
            for kind, v in zip(kinds, vectors(kinds, end)):
                x, g, c, state = edits(kind, state, v)
                audit.append(x)
                given.append(g)
                cost.append(c)
                illegal.append(int(letter is not None and letter + LETTERS[kind // 3] not in LEGAL_PAIRS))
                letter = LETTERS[kind // 3]
            if not pdf["more"][a]:
                x, g, c = closing(state)
                audit[-1], given[-1], cost[-1] = audit[-1] + x, given[-1] + g, cost[-1] + c
        return pdf[["seq", *ORDER, "fault"]].assign(audit=audit, given=given, cost=cost, illegal=illegal)

    if joints is None:
        full = full.withColumn("more", F.lit(False))
    else:
        tail = joints.groupBy("key").agg(F.max("chunk").alias("tail"))
        full = full.join(tail, "key", "left").withColumn("more", F.coalesce(F.col("chunk") < F.col("tail"), F.lit(False))).drop("tail")
    return scratch_table(full.groupBy("chunk").applyInPandas(
        trace, "seq long, key string, turn long, role string, head string, h long, fault string, audit string, given string, cost long, illegal long"), "traced")


# ------------------------------------------------------------------ repaired conversations, streamed in order
def _streamed(rows: DataFrame, trace: DataFrame) -> DataFrame:
    texts = rows.select(*ORDER, F.lit(0).alias("tag"), F.lit(0).cast("long").alias("seq"), "text", F.lit("").alias("audit"), F.lit("").alias("given"))
    marks = trace.select(*ORDER, F.lit(1).alias("tag"), "seq", F.lit("").alias("text"), "audit", "given")
    return texts.unionByName(marks).repartition("key").sortWithinPartitions(*in_order([*ORDER, "tag", "seq"])).select("key", "role", "tag", "text", "audit", "given")


def _lines(batches):
    """(key, edit, role, text) in order; a removed turn has no role."""
    text = None
    for pdf in batches:
        for key, role, tag, new, audit, given in zip(*[pdf[c] for c in ("key", "role", "tag", "text", "audit", "given")]):
            if not tag:
                text = new
                continue
            for edit, letter in zip(audit, given):
                yield key, edit, None if edit == "D" else role if edit == "K" else ROLES[letter], "" if edit == "I" else text


def repaired_turns(rows: DataFrame, trace: DataFrame) -> DataFrame:
    """(key, position, edit, role, text): the repaired conversations."""
    def emit(batches):
        out, at, position = [], None, 0
        for key, edit, role, text in _lines(batches):
            position = position + 1 if key == at else 0
            at = key
            if role is not None:
                out.append((key, position, edit, role, text))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["key", "position", "edit", "role", "text"])
                out = []
        yield pd.DataFrame(out, columns=["key", "position", "edit", "role", "text"])
    return _streamed(rows, trace).mapInPandas(emit, "key string, position long, edit string, role string, text string")


def digests(rows: DataFrame, trace: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256) per conversation with turns; hashed while streaming."""
    def emit(batches):
        out, at, parts, hashed, empty = [], None, [], None, True
        for key, edit, role, text in _lines(batches):
            if key != at:
                if at is not None:
                    out.append((at, "".join(parts), hashed.hexdigest()))
                at, parts, hashed, empty = key, [], hashlib.sha256(), True
            parts.append(edit)
            if role is not None:
                hashed.update((("" if empty else "\n") + role + ":" + text).encode("utf-8", "surrogatepass"))
                empty = False
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
                out = []
        if at is not None:
            out.append((at, "".join(parts), hashed.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "audit", "repaired_sha256"])
    return _streamed(rows, trace).mapInPandas(emit, "key string, audit string, repaired_sha256 string")


def repair(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Summary per conversation with turns, its turns and their edits.

    Turns go by turn (nulls first); equal turns by role, first 64 characters and
    hash of the text.  Null roles and texts are one space, a null conversation id is a
    conversation of its own, rows that repeat are duplicates.  Other columns are not
    read; an empty table gives no rows.  A role whose first letter is not s, u or a
    (an empty role too) fits nowhere: it is retyped or removed.
    """
    rows = turns(conversations, conv_col, turn_col, role_col, text_col)
    trace = traced(numbered(rows))
    fault = [F.sum((F.col("fault") == f).cast("long")).alias(f) for f in ("blank", "duplicate", "truncated")]
    span = (F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.countDistinct("turn"))
    counts = trace.groupBy("key").agg(F.coalesce(F.least(span, F.lit(2**63 - 1).cast("decimal(20,0)")), F.lit(0)).cast("long").alias("gaps"),
                                      *[F.coalesce(f, F.lit(0)).alias(n) for f, n in zip(fault, ("blank", "duplicate", "truncated"))],
                                      F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    return counts.join(digests(rows, trace), "key"), rows, trace


def damage(conversations: DataFrame) -> DataFrame:
    """The contract's faults, by crc32 of ``conv_id:turn``."""
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = (F.crc32(F.concat_ws(":", *part).cast("binary")) % 20).alias("hit")
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    hit = F.col("hit")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind).filter("hit <> 0") \
        .select("conv_id", "turn", F.when(hit == 4, "user").otherwise(F.col("role")).alias("role"),
                F.when(hit == 1, "").when(hit == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
                F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))


def op12_conversations(conversations: DataFrame) -> DataFrame:
    every = conversations.select("conv_id", conversation_key(F.col("conv_id")).alias("key")).distinct()
    found, _, _ = repair(damage(conversations))
    nothing = hashlib.sha256(b"").hexdigest()
    return every.join(found, "key", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE tbl AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ')||':'||coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), hit AS (
  SELECT src.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda x: unicode(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) % 256) + 1])), 4294967295) % 20 AS hit FROM src, tbl
), dmg AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role,
         CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE hit <> 0
), num AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dmg
), seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM num
), r AS (
  SELECT *, left(role, 1) AS ini,
         CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
  FROM seen
), back AS (
  SELECT conv_id, n + 1 AS i, 0 AS b0, 6 AS b1, 3 AS b2, 0 AS b3 FROM (SELECT DISTINCT conv_id, n FROM r)
  UNION ALL
  SELECT conv_id, i, least(w0, 3 + least(w2, 3 + w3)), least(w1, 3 + least(w2, 3 + w3)), least(w2, 3 + w3), least(w3, 3 + w2)
  FROM (SELECT r.conv_id, r.i,
          least(4 + b0, CASE WHEN ok AND ini = 's' THEN pen + b1 WHEN ok AND ini = 'u' THEN pen + b2 END, CASE WHEN ok THEN 3 + pen + b2 END) AS w0,
          least(4 + b1, CASE WHEN ok AND ini = 'u' THEN pen + b2 END, CASE WHEN ok THEN 3 + pen + b2 END) AS w1,
          least(4 + b2, CASE WHEN ok AND ini = 'a' THEN pen + b3 END, CASE WHEN ok THEN 3 + pen + b3 END) AS w2,
          least(4 + b3, CASE WHEN ok AND ini = 'u' THEN pen + b2 END, CASE WHEN ok THEN 3 + pen + b2 END) AS w3
        FROM back JOIN (SELECT *, fault NOT IN ('b', 'd') AS ok, CASE fault WHEN 't' THEN 3 ELSE 0 END AS pen FROM r) r
          ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i - 1)
), m AS (
  SELECT back.conv_id, back.i, [b0, b1, b2, b3] AS v, r.role, r.text, r.ini, coalesce(r.fault, '') AS fault, r.n,
         lead([b0, b1, b2, b3]) OVER (PARTITION BY back.conv_id ORDER BY back.i) AS nx
  FROM back LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM back.conv_id AND r.i = back.i
), walk AS (
  SELECT conv_id, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS lines FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL
  SELECT conv_id, CASE WHEN e = 'I' THEN i ELSE i + 1 END,
         CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE ini WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END ELSE nxt END,
         audit||e,
         CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role||':'||text)
                WHEN 'I' THEN list_append(lines, rl||':') ELSE list_append(lines, rl||':'||text) END
  FROM (SELECT w.*, m.ini, m.role, m.text, CASE w.s WHEN 2 THEN 3 ELSE 2 END AS nxt, CASE w.s WHEN 2 THEN 'assistant' ELSE 'user' END AS rl,
          CASE WHEN m.nx IS NOT NULL AND 4 + m.nx[w.s + 1] = m.v[w.s + 1] THEN 'D'
               WHEN 3 + m.v[(CASE w.s WHEN 2 THEN 3 ELSE 2 END) + 1] = m.v[w.s + 1] THEN 'I'
               WHEN m.nx IS NULL THEN NULL
               WHEN (CASE WHEN m.ini = 's' AND w.s = 0 THEN m.nx[2] WHEN m.ini = 'u' AND w.s <> 2 THEN m.nx[3] WHEN m.ini = 'a' AND w.s = 2 THEN m.nx[4] END)
                    + CASE m.fault WHEN 't' THEN 3 ELSE 0 END = m.v[w.s + 1] THEN 'K'
               ELSE 'R' END AS e
        FROM walk w JOIN m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i)
  WHERE e IS NOT NULL
), done AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY length(audit) DESC) = 1),
pairs AS (SELECT conv_id, ini AS b, lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS a FROM r),
agg AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated FROM r GROUP BY conv_id
), bad AS (SELECT conv_id, count(*) FILTER (a IS NOT NULL AND a||b NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
price AS (SELECT conv_id, v[1]::BIGINT AS cost FROM m WHERE i = 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN agg ON agg.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN bad ON bad.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN price ON price.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM c.conv_id
"""
