"""Operator 1, best-fit packing by bin completion.

Documents are tokenised in parallel and cut into pieces of at most one
sequence.  Only the number of pieces of each length matters for the packing, so
the driver sees a histogram with at most ``capacity`` rows, however large the
corpus, and returns a list of fillings with how often each is used.

Bin completion branches on the largest remaining length: the undominated
fillings of the room beside it, least waste first, each applied as often as the
counts allow.  Branches whose waste exceeds what the best solution leaves are
cut; a best-fit solution is the first incumbent.  Pieces are then matched with
their places by their rank within their length: ranks come from running counts
of (length, bucket) groups, so a length that holds a third of all pieces is
spread over all buckets.
"""

from __future__ import annotations

import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarry.llm.common import scratch_table, text_or_empty

CAPACITY = 2048
NODE_LIMIT = 20_000  # branch-and-bound nodes beyond the first descent
CACHE_WORDS = 500_000


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_alphabet() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


CLOSED = re.compile(rb"([A-Za-z]+)([!-&(-/:-@\[-`{-~]+)\Z")  # no apostrophe: contractions are pieces of their own


class TokenBytes(dict):
    """Word (UTF-8) -> its ids as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser never joins text across ASCII white space,
    so a document's ids are the ids of its white-space separated words.  A new
    word is split and merged by a byte-pair encoder over the file's own
    vocabulary, with the byte 0xFF (which no UTF-8 text holds) for the end of a
    word; tests compare it with the tokenizers library.  The library itself is
    used for vocabularies of another make.
    """

    END = b"\xff"

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.split = spec["model"], None
        ids = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model.get("merges", [])]
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if (model.get("end_of_word_suffix") == "</w>" and ids == sorted(set(ids)) and norms == ["NFC", "Replace", "Lowercase"]
                and [x["type"] for x in parts] == ["Split", "ByteLevel"]):
            self.split = regex.compile(parts[0]["pattern"]["Regex"])
            letters, special = byte_alphabet(), {t["content"] for t in spec["added_tokens"]}
            ranks = {}
            for token, i in model["vocab"].items():
                if token not in special:
                    body = token.removesuffix("</w>") if len(token) > 4 else token
                    ranks[bytes(letters[c] for c in body) + (self.END if body != token else b"")] = i
            self.pieces = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # TokenBytes or SpecialBytes decides on their strings
        self.special = {t["content"].encode(): struct.pack("<I", t["id"]) for t in spec.get("added_tokens", []) if t.get("special")}

    def ids(self, word: bytes) -> list[int]:
        if word.isalpha() and self.split is not None:  # ASCII letters
            return self.pieces(word.lower() + self.END)
        text = word.decode("utf-8", "replace")
        if self.split is None or max(text) >= "\u0250":  # beyond the Latin blocks: the library's own tables
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        if max(text) < "\u0100" and text.isalpha():  # composed letters with one-letter lower case
            return self.pieces(text.lower().encode("utf-8") + self.END)
        # lower-cased character by character, as the vocabulary's normaliser does
        text = "".join([c.lower() for c in unicodedata.normalize("NFC", text)])
        return [i for piece in self.split.findall(text) for i in self.pieces(piece.encode("utf-8") + self.END)]

    def __missing__(self, word: bytes) -> bytes:
        tail = CLOSED.match(word) if self.split is not None and not word.isalpha() else None
        if tail:  # letters, then marks: two pieces, mostly known
            out = self[tail[1]] + self[tail[2]]
        else:
            ids = self.ids(word)
            out = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


class SpecialBytes(dict):
    """Like ``TokenBytes``, with the vocabulary's special tokens inside a word as their own ids.

    They hold no white space, so a word is split at them as a text would be.
    """

    def __init__(self, words: TokenBytes):
        super().__init__()
        self.words = words
        self.cut = re.compile(b"(" + b"|".join(map(re.escape, sorted(words.special, key=len, reverse=True))) + b")") if words.special else None

    def __missing__(self, word: bytes) -> bytes:
        special = self.words.special
        if self.cut is None or not self.cut.search(word):
            out = self.words[word]
        else:
            out = b"".join(special[part] if part in special else self.words[part] for part in self.cut.split(word) if part)
        if len(self) < CACHE_WORDS:
            self[word] = out
        return out


_TOKENS: dict[str, TokenBytes] = {}
_SPECIAL: dict[str, SpecialBytes] = {}


def document_ids(text: str | None, path: str, end_id: int = 0, special: bool = False) -> bytes:
    """Ids of a document as little-endian unsigned 32-bit bytes, closed by ``end_id``.

    With ``special``, as the operator has it, the strings of the vocabulary's
    special tokens are these tokens; else they are ordinary text.
    """
    words = _TOKENS.get(path)
    if words is None:
        words = _TOKENS.setdefault(path, TokenBytes(path))
    if special:
        if path not in _SPECIAL:
            _SPECIAL[path] = SpecialBytes(words)
        words = _SPECIAL[path]
    raw = (text or "").encode("utf-8", "replace")
    return b"".join(map(words.__getitem__, raw.split())) + end_id.to_bytes(4, "little")


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row_no"), text_or_empty(text_col).alias("text"))


def cut_pieces(src: DataFrame, capacity: int, path: str) -> DataFrame:
    """``src(id, row_no, text)`` -> id, row_no, piece, start, length and crc32 of the ids of every piece."""
    width = 4 * capacity

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b["text"]):
                ids = document_ids(text, path, special=True)
                for p, o in enumerate(range(0, len(ids), width)):
                    part = ids[o:o + width]
                    at.append(i)
                    piece.append(p)
                    start.append(o // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pd.DataFrame({"id": b["id"].to_numpy()[at], "row_no": b["row_no"].to_numpy()[at], "piece": piece,
                                "start": start, "length": length, "ids_crc32": crc})

    id_type = src.schema["id"].dataType.simpleString()
    return src.mapInPandas(run, f"id {id_type}, row_no long, piece int, start long, length int, ids_crc32 long")


# ------------------------------------------------------------------ bin completion on a histogram
def lower_bound(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """Least number of bins: for each k, sizes over capacity - k stand alone, those in [k, capacity / 2] fill what the rest leaves."""
    best = -(-int((sizes * counts).sum()) // capacity)
    for k in range(0, capacity // 2 + 1, max(1, capacity // 256)):
        alone = counts[sizes > capacity - k].sum()
        large = (sizes <= capacity - k) & (2 * sizes > capacity)
        small = (2 * sizes <= capacity) & (sizes >= max(k, 1))
        room = counts[large].sum() * capacity - (sizes * counts)[large].sum()
        best = max(best, int(alone + counts[large].sum() + max(0, -(-int((sizes * counts)[small].sum() - room) // capacity))))
    return best


def fillings(left: np.ndarray, room: int, width: int = 6) -> list[tuple[int, tuple[int, ...]]]:
    """Undominated fillings of ``room`` from the counts ``left`` (by size): (waste, sizes), best first.

    One size, then two and three: a filling is dropped when one of fewer, larger
    sizes wastes no more.
    """
    have = np.nonzero(left[:room + 1])[0]
    if not len(have):
        return [(room, ())]
    one = int(have[-1])
    out = [(room - one, (one,))]
    if out[0][0] == 0:
        return out

    def pairs(space: int, used: int = -1) -> list[tuple[int, tuple[int, ...]]]:
        a = have[have < space]
        if not len(a):
            return []
        at = np.searchsorted(have, space - a, side="right") - 1
        b = have[np.maximum(at, 0)]
        ok = (at >= 0) & (b <= a)
        need = (a == b).astype(int) + 1
        ok &= left[a] - (a == used) >= need
        ok &= left[b] - (b == used) >= 1
        a, b = a[ok], b[ok]
        waste = space - a - b
        order = np.lexsort((-a, waste))[:width]
        return [(int(waste[i]), (int(a[i]), int(b[i]))) for i in order]

    two = pairs(room)
    out += [f for f in two if f[0] < out[0][0]]
    if min(out)[0] > 0:
        low = min(out)[0]
        for x in have[::-1][:4 * width]:
            three = [(w, (int(x), *p)) for w, p in pairs(room - int(x), int(x)) if w < low and p[0] <= x]
            out += three[:1]
            if three and three[0][0] == 0:
                break
    out.sort(key=lambda f: (f[0], len(f[1]), tuple(-s for s in f[1])))
    return out[:width]


def _apply(left: np.ndarray, largest: int, fill: tuple[int, ...]) -> tuple[dict[int, int], int]:
    use: dict[int, int] = {largest: 1}
    for s in fill:
        use[s] = use.get(s, 0) + 1
    return use, min(int(left[s]) // n for s, n in use.items())


def _complete(left: np.ndarray, capacity: int, rank: int = 0) -> list[tuple[dict[int, int], int]]:
    """One descent: the ``rank``-th filling at the first branch, the best one below; keeps on filling until nothing fits."""
    left, out, first = left.copy(), [], True
    while (nz := np.nonzero(left)[0]).size:
        largest = int(nz[-1])
        left[largest] -= 1
        options = fillings(left, capacity - largest)
        fill = options[min(rank if first else 0, len(options) - 1)][1]
        room = capacity - largest - sum(fill)
        for s in fill:
            left[s] -= 1
        while room and (small := np.nonzero(left[:room + 1])[0]).size:
            fill += (int(small[-1]),)
            left[small[-1]] -= 1
            room -= int(small[-1])
        for s in (largest, *fill):
            left[s] += 1
        use, times = _apply(left, largest, fill)
        for s, n in use.items():
            left[s] -= n * times
        out.append((use, times))
        first = False
    return out


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """The first incumbent: largest first, each bin filled with the largest size that fits."""
    left, out = left.copy(), []
    while (nz := np.nonzero(left)[0]).size:
        room, use = capacity, {}
        while room and (fit := np.nonzero(left[:room + 1])[0]).size:
            s = int(fit[-1])
            left[s] -= 1
            use[s] = use.get(s, 0) + 1
            room -= s
        for s, n in use.items():
            left[s] += n
        times = min(int(left[s]) // n for s, n in use.items())
        for s, n in use.items():
            left[s] -= n * times
        out.append((use, times))
    return out


def bin_completion(histogram: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> list[tuple[dict[int, int], int]]:
    """Fillings ``({length: pieces of it}, times)`` that use every piece of the histogram, in as few bins as found.

    Depth first: from the last branch of the incumbent back to the first, each
    alternative filling is completed and replaces the rest of the incumbent if
    that takes fewer bins; the search then goes on from its end.  A branch whose
    waste exceeds what a solution with one bin less may have is cut.  Stops at
    the lower bound, which proves the result optimal, or after ``node_limit``
    branches.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for s, n in histogram.items():
        left[s] = n
    bins = lambda sol: sum(t for _, t in sol)
    lost = lambda sol: sum(t * (capacity - sum(s * n for s, n in use.items())) for use, t in sol)
    bound = lower_bound(np.arange(capacity + 1), left, capacity)
    total = int((np.arange(capacity + 1) * left).sum())
    best = min((best_fit(left, capacity), _complete(left, capacity)), key=bins)
    left[:] = 0
    depth, nodes = len(best) - 1, 0
    while depth >= 0 and bins(best) > bound and nodes < node_limit:
        use, times = best[depth]
        for s, n in use.items():
            left[s] += n * times
        head = best[:depth]
        allowed = (bins(best) - 1) * capacity - total - lost(head)
        for rank, (use, _) in enumerate(_options(left, capacity)[1:], 1):
            if capacity - sum(s * n for s, n in use.items()) > allowed:
                continue
            tail = _complete(left, capacity, rank)
            nodes += len(tail)
            if bins(head) + bins(tail) < bins(best):
                best, left[:], depth = head + tail, 0, len(head) + len(tail)
                break
        depth -= 1
    return best


def _options(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    largest = int(np.nonzero(left)[0][-1])
    less = left.copy()
    less[largest] -= 1
    return [_apply(left, largest, f) for _, f in fillings(less, capacity - largest)]


def place_ranges(plan: list[tuple[dict[int, int], int]], capacity: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """Per length: (first rank, pieces per bin, first sequence, offset in the bin) of each filling that uses it, by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for use, times in plan:
        offset = 0
        for s, n in use.items():
            out.setdefault(s, []).append((rank.get(s, 0), n, sequence, offset))
            rank[s] = rank.get(s, 0) + n * times
            offset += s * n
        sequence += times
    return out


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                   path: str | None = None, node_limit: int = NODE_LIMIT) -> DataFrame:
    """One row per piece: id, row_no, piece, start, length, ids_crc32, sequence_id, offset.

    Every document is closed by id 0, so an empty or null text is one piece of
    length 1.  Only documents over ``capacity`` ids are cut.  Rows that repeat an
    id are separate documents (``row_no`` tells them apart).  An empty table
    gives an empty result; other columns are not read.
    """
    return place_pieces(cut_pieces(_numbered(docs, id_col, text_col), capacity, path or tokenizer_path()), capacity, node_limit)


def place_pieces(pieces: DataFrame, capacity: int, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Add sequence_id and offset to ``pieces(row_no, piece, length, ...)``."""
    spark = pieces.sparkSession
    pieces = scratch_table(pieces, "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranges = place_ranges(bin_completion(histogram, capacity, node_limit), capacity)
    # at most ``capacity`` rows; the fillings of a length are bounded by the plan, not by the data
    places = spark.createDataFrame([(s, [tuple(x) for x in r]) for s, r in ranges.items()] or [],
                                   "length int, ranges array<struct<first:long, per:long, sequence:long, offset:long>>")
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("row_no", "piece"), F.lit(_buckets(spark))))
    sizes = bucketed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start_rank"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row_no", "piece")) - 1
    ranked = bucketed.withColumn("nth", nth).join(starts, ["length", "bucket"]) \
        .withColumn("rank", F.col("start_rank") + F.col("nth"))
    mine = F.element_at(F.filter("ranges", lambda r: r["first"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(places), "length").withColumn("place", mine).withColumn("in", F.col("rank") - F.col("place.first"))
    return placed.select(
        "id", "row_no", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("place.sequence") + F.floor(F.col("in") / F.col("place.per"))).cast("long").alias("sequence_id"),
        (F.col("place.offset") + F.pmod(F.col("in"), F.col("place.per")) * F.col("length")).cast("long").alias("offset"))


def _buckets(spark) -> int:
    return max(64, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def packed_sequences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                     path: str | None = None) -> DataFrame:
    """The sequences themselves: sequence_id, input_ids, doc_ids and starts of their pieces.

    A sequence gathers at most ``capacity`` ids.
    """
    path = path or tokenizer_path()
    src = scratch_table(_numbered(docs, id_col, text_col), "numbered")
    plan = place_pieces(cut_pieces(src, capacity, path), capacity)
    per_doc = plan.groupBy("row_no").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("pieces"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, pieces in zip(b["id"], b["text"], b["pieces"], strict=True):
                ids = np.frombuffer(document_ids(text, path, special=True), dtype="<u4").astype(np.int64)
                out += [(i, p["sequence_id"], p["offset"], ids[p["start"]:p["start"] + p["length"]]) for p in pieces]
            yield pd.DataFrame(out, columns=["id", "sequence_id", "offset", "ids"])

    id_type = src.schema["id"].dataType.simpleString()
    parts = src.join(per_doc, "row_no").mapInPandas(run, f"id {id_type}, sequence_id long, offset long, ids array<long>")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "id", "ids")))
    return parts.groupBy("sequence_id").agg(ordered.alias("p")).select(
        "sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("input_ids"),
        F.transform("p", lambda x: x["id"]).alias("doc_ids"), F.transform("p", lambda x: x["offset"]).alias("starts"))


def op1_packing(docs: DataFrame) -> DataFrame:
    p = pack_documents(docs)
    return p.select(F.col("id").alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
