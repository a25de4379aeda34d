"""Operator 10, secret scans: incremental blob ledger.  DataFrame operations only.

Every version of a text is addressed by its SHA-256.  The ledger holds one row
for each (blob, rule version) ever scanned, with its findings, empty ones
included.  A run addresses all rows, scans one representative text of each blob
that lacks a rule version, appends the result to the ledger and joins the
findings back to every row (path) that holds the blob.

Positions are code points, from the lengths of the pieces between the matches:
``split`` and ``regexp_extract_all`` see the same leftmost matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import attach_by_key, same_row, scratch_table, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``pattern`` matches leftmost, non-overlapping; ``value`` is the group that needs ``least`` characters."""
    kind: str
    version: int
    pattern: str
    hint: str  # simpler pattern that every text with a finding contains
    value: int = 0
    least: int = 1


# Version 1 is the base set, in the order in which kinds are listed; later versions add kinds.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", 2, 6),
    # a run that starts here and is long enough: shorter runs cannot hold a longer one
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", r"AKIA[A-Z0-9]{16}"),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}"),
    Rule("pem", 2, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"PRIVATE KEY-----"),
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", r"eyJ[A-Za-z0-9_-]{8}"),
)
SPANS = "array<struct<start:int,kind:int,stop:int>>"
SLICE = 256  # matches whose places are summed together


def rule_spans(text: Column, rule: Rule, kind: int) -> Column:
    """Spans of one rule in ``text``; ``kind`` is the rule's place in the list."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    value = F.regexp_extract_all(text, pattern, F.lit(rule.value)) if rule.value else found
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(F.zip_with(found, value, lambda m, v: F.struct(F.length(m).alias("size"), F.length(v).alias("value"))), gaps,
                       lambda m, gap: F.struct(F.length(gap).alias("gap"), m["size"].alias("size"), m["value"].alias("value")))
    spans = once(sizes, lambda x: running_spans(x, rule, kind))
    return F.when(F.regexp_like(text, F.lit(rule.hint)), spans).otherwise(F.array().cast(SPANS))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often ``use`` names it, also inside lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_spans(sizes: Column, rule: Rule, kind: int) -> Column:
    """Spans from ``sizes``, an array of (gap before, size, value size) whose last element is the text after the last match.

    Places are running sums.  They are taken in slices of SLICE matches, then over
    the slices, so that arrays which grow by one element stay short and the work is
    linear in the number of matches.
    """
    def within(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = acc["at"] + x["gap"]
            end = at + F.coalesce(x["size"], F.lit(0))
            span = F.array(F.struct(at.alias("start"), F.lit(kind).alias("kind"), end.alias("stop")))
            return F.struct(end.alias("at"), F.when(x["value"] >= rule.least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))
        return F.aggregate(part, start, step)

    def placed(parts: Column) -> Column:
        before = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
                             lambda acc, p: F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        return F.flatten(F.zip_with(parts, before, lambda p, at: F.transform(p["out"], lambda x: F.struct(
            (x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["stop"] + at).alias("stop")))))

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / SLICE).cast("int")), lambda i: within(F.slice(sizes, i * SLICE + 1, F.lit(SLICE))))
    return once(parts, placed)


def version_spans(text: Column, version: int, rules: tuple[Rule, ...]) -> Column:
    parts = [rule_spans(text, r, k) for k, r in enumerate(rules) if r.version == version]
    return F.array_sort(F.concat(*parts)) if len(parts) > 1 else parts[0]


def address(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per version: id, row_no, run (input partition), blob, thash."""
    text = text_or_empty(text_col)
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"),
                       F.spark_partition_id().alias("run"), F.unhex(F.sha2(text, 256)).alias("blob"), F.xxhash64(text).alias("thash"))


def scan_unseen(docs: DataFrame, leaf: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...],
                id_col: str, text_col: str) -> DataFrame:
    """New ledger rows (blob, rule_version, spans): the blobs of ``leaf`` that lack a rule version, each scanned once."""
    versions = sorted({r.version for r in rules})
    # one representative per blob; copies of a hot blob are reduced map-side
    blobs = leaf.groupBy("blob").agg(F.min(F.struct("row_no", "id", "thash")).alias("one")).select("blob", "one.id", "one.thash")
    todo = F.array(*[F.lit(v) for v in versions])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(todo, F.coalesce("seen", F.array().cast("array<int>")))).drop("seen")
    else:
        blobs = blobs.withColumn("todo", todo)
    blobs = blobs.filter(F.size("todo") > 0)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_or_empty(text_col)).alias("thash"), text_or_empty(text_col).alias("text"))
    one = same_row(texts, blobs.hint("shuffle_hash"), ["id", "thash"], "inner")
    scans = F.array(*[F.struct(F.lit(v).alias("rule_version"),
                               F.when(F.array_contains("todo", v), version_spans(F.col("text"), v, rules)).alias("spans")) for v in versions])
    rows = one.select("blob", F.explode(scans).alias("s")).select("blob", "s.rule_version", "s.spans").filter("spans is not null")
    return rows.dropDuplicates(["blob", "rule_version"])  # rows that repeat id and text are scanned alike


def scan_secrets(docs: DataFrame, ledger: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text",
                 rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """(findings per row, new ledger rows).

    Findings: id, row_no, and ``spans`` (start, kind, stop; ordered by start,
    then by the kinds' order), one row per input row, with an empty list where
    nothing is found.  Null texts count as empty; repeated rows and equal texts
    share one scan; null ids are kept.  Pass the accumulated ledger back in to
    scan only unseen (blob, rule version) pairs.  An empty table gives two
    empty results; other columns are not read.
    """
    leaf = scratch_table(address(docs, id_col, text_col), "blobs")
    new = scratch_table(scan_unseen(docs, leaf, ledger, rules, id_col, text_col), "ledger")
    known = new if ledger is None else new.unionByName(ledger.select("blob", "rule_version", "spans"))
    hits = known.filter(F.size("spans") > 0).groupBy("blob") \
        .agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))  # one row per rule version
    rows = attach_by_key(leaf, hits, ["blob"])
    return rows.select("id", "row_no", F.coalesce("spans", F.array().cast(SPANS)).alias("spans")), new


def span_text(spans: Column, rules: tuple[Rule, ...]) -> Column:
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")


def op10_secrets(docs: DataFrame) -> DataFrame:
    rows, _ = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return rows.select(F.col("id").alias("doc_id"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                       F.sha2(span_text(base, RULES), 256).alias("base_sha256"), span_text(F.col("spans"), RULES).alias("spans"))


def _kind_sql(kind: int, rule: Rule) -> str:
    """Spans of one rule in DuckDB: (start, kind, stop) from the lengths between the matches."""
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    return f"""list_transform(list_filter(list_transform(range(1, len(regexp_extract_all(t, {pattern})) + 1), lambda i: struct_pack(
        s := coalesce(list_sum(list_transform(string_split_regex(t, {pattern})[1:i], lambda x: length(x))), 0)
             + coalesce(list_sum(list_transform(regexp_extract_all(t, {pattern})[1:i - 1], lambda x: length(x))), 0),
        n := length(regexp_extract_all(t, {pattern})[i]), v := length(regexp_extract_all(t, {pattern}, {rule.value})[i]))),
      lambda x: x.v >= {rule.least}), lambda x: struct_pack(s := x.s::BIGINT, k := {kind}, e := (x.s + x.n)::BIGINT))"""


def op10_sql() -> str:
    names = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
    text = lambda x: f"coalesce(array_to_string(list_transform({x}, lambda y: {names}[y.k + 1] || ':' || y.s || ':' || y.e), ','), '')"
    kinds = ", ".join(f"{_kind_sql(k, r)} AS k{k}" for k, r in enumerate(RULES))
    base, every = ("list_sort(list_concat(" + ", ".join(f"k{k}" for k in range(n)) + "))" for n in (3, len(RULES)))
    return f"""
SELECT doc_id, len(k0)::BIGINT AS n_assign, len(k1)::BIGINT AS n_access, len(k2)::BIGINT AS n_hex,
       sha256({text('base')}) AS base_sha256, {text('every')} AS spans
FROM (SELECT *, {base} AS base, {every} AS every FROM (
  SELECT doc_id, {kinds} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) d) a) b"""
