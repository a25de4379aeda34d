"""Operator 5, toxicity: noisy-channel deobfuscation, then a lexicon score.

1. A character trigram model is counted over all texts (a bounded table).
2. Every word becomes a lattice: look-alike characters stand for letters,
   repeated letters for one or two, separators for nothing.  Viterbi decoding
   under the trigram model picks the most likely spelling; all its states are
   kept.  Words of plain letters without a doubled one have a single path; each
   distinct spelling is decoded once per worker.  A run of letters spaced out
   one by one is a lattice in which every gap may be a word's end or nothing.
3. Restored words and their beginnings are weighed by how much more often they
   occur in toxic than in clean labelled documents (lower confidence bound of
   the log ratio).
4. A logistic model over a document's strongest and number of toxic words gives
   the score; it is fitted on words weighed on the other half of the labels.

The labelled rows used for 3 and 4 are a bounded sample (``max_rows`` per
class); counting and scoring cover every row and whole texts.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import crc_fold, scratch_table, text_or_empty

# Look-alike characters and the letters they stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou", "€": "e", "£": "l"}
SEPARATORS = set("-._~'’*+|!/\\,:;")
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûüœ"
L = len(LETTERS) + 2  # 0: edge of a word, last: any other letter
CODE = {c: i + 1 for i, c in enumerate(LETTERS)} | {" ": 0}
LOOKALIKE_COST, DELETE_COST, DOUBLE_COST = 1.0, 0.7, 0.7  # channel costs in nats
MAX_DECODED = 40  # letters or runs of them; longer words are identifiers or addresses and taken as they are
PLAIN = re.compile(r"[^\W\d_]+\Z")
DOUBLE = re.compile(r"(.)\1")
NUMBER = re.compile(r"[-+€£$(]*\d[\d.,:/+-]*[%€£$)]?\Z")
DECORATION = re.compile(r"\A(?:([^\w\s])\1+|[\"'(\[.,;:?¿¡])+|(?:([^\w\s])\2+|[\"')\].,;:?!])+\Z")
SPACED = re.compile(r"(?<!\S)(?:\S[ ]){3,}\S(?!\S)")
RUN = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
GAPPED = re.compile(r"(\S)(\s*)")
PREFIXES = (4, 5, 6)
CACHE_WORDS = 200_000
COUNTED = 100_000  # features that a task holds before it hands their counts on

_TABLE = np.zeros(0x250, dtype=np.int64)
for _c, _i in CODE.items():
    _TABLE[ord(_c)] = _i
for _o in range(0x250):
    if _TABLE[_o] == 0 and chr(_o).isalpha():
        _TABLE[_o] = L - 1


def trigram_counts(text: str, step: int = 200_000) -> np.ndarray:
    """Counts of code triples of a text, flattened; everything but letters is an edge.  Works in slices of ``step``."""
    total = np.zeros(L ** 3, dtype=np.int64)
    text = f"\n\n{text.lower()}\n"
    for at in range(0, max(len(text) - 2, 1), step):
        points = np.frombuffer(text[at:at + step + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        code = np.where(points < len(_TABLE), _TABLE[np.minimum(points, len(_TABLE) - 1)], L - 1)
        total += np.bincount((code[:-2] * L + code[1:-1]) * L + code[2:], minlength=L ** 3)
    return total


class CharModel:
    """Interpolated trigram log probabilities, indexed [before, last, next]."""

    def __init__(self, counts: np.ndarray):
        c = counts.reshape(L, L, L).astype(float)
        uni = (c.sum(axis=(0, 1)) + 0.5) / (c.sum() + 0.5 * L)
        pair = c.sum(axis=0)
        bi = (pair + 5 * uni) / (pair.sum(axis=1, keepdims=True) + 5)
        tri = (c + 5 * bi[None, :, :]) / (c.sum(axis=2, keepdims=True) + 5)
        self.logp = np.log(tri).tolist()

    def decode(self, units: list[list[tuple[str, float]]]) -> str:
        """Most likely spelling of a lattice; a unit lists (letters, cost)."""
        logp = self.logp
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # score, (before, letters)
        for options in units:
            nxt: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score - cost
                    for ch in letters:
                        z = CODE.get(ch, L - 1)
                        s += logp[x][y][z]
                        x, y = y, z
                    old = nxt.get((x, y))
                    if old is None or s > old[0]:
                        nxt[x, y] = (s, (path, letters))
            states = nxt
        path = max(((s + logp[a][b][0], path) for (a, b), (s, path) in states.items()), key=lambda end: end[0])[1]
        out = []
        while path is not None:
            path, letters = path
            out.append(letters)
        return "".join(reversed(out))


def lattice(word: str) -> list[list[tuple[str, float]]]:
    """Units of a lower-case word: runs of equal characters with what they may stand for."""
    units = []
    for m in re.finditer(r"(.)\1*", word, re.S):
        ch, n = m[1], len(m[0])
        options: list[tuple[str, float]] = []
        if ch.isalpha():
            options = [(ch, 0.0 if n == 1 else DOUBLE_COST * (n == 2)), *([(ch * 2, 0.0 if n == 2 else DOUBLE_COST)] if n > 1 else [])]
        for letter in LEET.get(ch, ""):
            options += [(letter * min(k, n), LOOKALIKE_COST * min(k, n)) for k in ((1, 2) if n > 1 else (1,))]
        if ch in SEPARATORS or not options:
            options.append(("", DELETE_COST if ch in SEPARATORS else 2 * DELETE_COST * n))
        units.append(options)
    return units


def restore(word: str, model: CharModel) -> str:
    """Lower-case spelling without obfuscation; words of plain letters only lose decoration around them."""
    word = DECORATION.sub("", word.lower()) or word.lower()
    if PLAIN.match(word) and not DOUBLE.search(word) or NUMBER.match(word):
        return word
    units = lattice(word)
    if not 2 <= sum(any(letters for letters, _ in options) for options in units) <= MAX_DECODED:
        return word
    return model.decode(units)


def run_lattice(run: str) -> list[list[tuple[str, float]]]:
    """Units of characters spaced out one by one, and of the gaps between them; a gap is a word's end or nothing."""
    units: list[list[tuple[str, float]]] = []
    gapped = GAPPED.findall(run.lower())
    narrow = min(len(gap) for _, gap in gapped[:-1])
    at = 0
    while at < len(gapped):
        end = at + 1
        while end < len(gapped) and gapped[end][0] == gapped[at][0] and len(gapped[end - 1][1]) == narrow:
            end += 1
        (options,) = lattice(gapped[at][0] * (end - at))
        # equal characters are one unit; a word may end between them
        letters = {o for o, _ in options if len(o) == 1}
        units.append(options + [(f"{o} {o}", cost) for o, cost in options if o in letters and end - at > 1])
        gap = gapped[end - 1][1]
        if end < len(gapped):
            units.append([("", 0.0 if len(gap) == narrow else DELETE_COST), (" ", 0.0)])
        at = end
    return units


def has_run(words: list[str]) -> bool:
    """Whether three single characters follow each other, without which RUN and SPACED find nothing."""
    return b"\1\1\1" in bytes([len(w) == 1 for w in words])


def spaced_words(text: str | None, model: CharModel, words: list[str] | None = None) -> set[str]:
    """Words in the runs of spaced out characters, without those that ``spellings`` has joined already."""
    text = text or ""
    if not has_run(text.split() if words is None else words):
        return set()
    runs = [run for run in RUN.findall(text) if any(map(str.isalpha, run))]
    found = {word for run in runs for word in model.decode(run_lattice(run)).split()}
    return found.difference(restore(m.replace(" ", ""), model) for m in SPACED.findall(text)) if found else found


def features(word: str) -> list[str]:
    return [word, *["^" + word[:k] for k in PREFIXES if len(word) > k]] if len(word) > 2 else []


def spellings(text: str | None, words: list[str] | None = None) -> set[str]:
    """Distinct raw words of a text, letters spaced out one by one joined."""
    text = text or ""
    words = text.split() if words is None else words
    return set(words).union(m.replace(" ", "") for m in SPACED.findall(text)) if has_run(words) else set(words)


@dataclass
class Lexicon:
    """Weights of restored words and beginnings; ``weigh`` caches each spelling's weight."""
    model: CharModel
    weights: dict[str, float]
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def weigh(self, word: str) -> float:
        return self.weigh_restored(restore(word, self.model))

    def weigh_restored(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)

    def evidence(self, text: str | None) -> tuple[float, float, float]:
        """Strongest weight, sum of the three strongest, log of the number of toxic words."""
        cache = _cache(self)
        words = (text or "").split()
        hits = [*map(cache.__getitem__, spellings(text, words)), *map(self.weigh_restored, spaced_words(text, self.model, words))]
        hits = sorted(filter(None, hits), reverse=True)
        return (hits[0] if hits else 0.0, sum(hits[:3]), float(np.log1p(len(hits))))


class _Weights(dict):
    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float:
        w = self.lexicon.weigh(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = w
        return w


_CACHES: dict[str, _Weights] = {}


def _cache(lexicon: Lexicon) -> _Weights:
    if lexicon.key not in _CACHES:
        if sum(map(len, _CACHES.values())) >= CACHE_WORDS // 2:  # of lexicons that are done with
            _CACHES.clear()
        _CACHES[lexicon.key] = _Weights(lexicon)
    return _CACHES[lexicon.key]


def char_model(texts: DataFrame) -> CharModel:
    """Trigram counts over all rows of ``texts(text)``: at most L^3 counts leave each task and reach the driver."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(L ** 3, dtype=np.int64)
        for b in batches:
            part, size = [], 0
            for t in b["text"]:
                part.append(t)
                size += len(t)
                if size >= 200_000:
                    total += trigram_counts("\n".join(part))
                    part, size = [], 0
            total += trigram_counts("\n".join(part))
        at = np.nonzero(total)[0]
        yield pd.DataFrame({"gram": at, "n": total[at]})
    rows = texts.mapInPandas(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(L ** 3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return CharModel(counts)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(half, label, text) of at most ``max_rows`` labelled training rows per class, drawn by a hash of the id."""
    lab = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).filter("id is not null and label in (0, 1)") \
        .filter(crc_fold("id") != 1)
    pick = None
    for c in (0, 1):
        part = lab.filter(F.col("label") == c).orderBy(F.xxhash64("id"), "id").limit(max_rows)
        pick = part if pick is None else pick.unionByName(part)
    src = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = src.join(F.broadcast(pick), "id")  # at most 2 * max_rows ids
    return rows.select(F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(2)).cast("int").alias("half"), "label", "text")


def weigh_features(sample: DataFrame, model: CharModel, max_features: int, floor: float = 1.0) -> dict[int, dict[str, float]]:
    """Weights learned on half 0, half 1 and both (2): lower 90 % bound of the log ratio of document frequencies."""
    bc = sample.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[int, int], Counter] = {}
        spelled: dict[str, list[str]] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for (half, label), counter in seen.items():
                yield pd.DataFrame({"half": half, "label": label, "feature": list(counter), "n": list(counter.values())})
            seen.clear()

        for b in batches:
            for half, label, text in zip(b["half"], b["label"], b["text"], strict=True):
                found: set[str] = {""}  # counts the documents
                words = text.split()
                for w in spellings(text, words):
                    if w not in spelled:
                        if len(spelled) >= COUNTED:
                            spelled.clear()
                        spelled[w] = features(restore(w, bc.value))
                    found.update(spelled[w])
                for w in spaced_words(text, bc.value, words):
                    found.update(features(w))
                seen.setdefault((half, label), Counter()).update(found)
                if sum(map(len, seen.values())) >= COUNTED:
                    yield from counted()
        yield from counted()

    counts = sample.mapInPandas(run, "half int, label int, feature string, n long")
    side = lambda h, y: F.coalesce(F.sum(F.when((F.col("half") == h) & (F.col("label") == y), F.col("n"))), F.lit(0)).alias(f"n{h}{y}")
    table = scratch_table(counts.groupBy("feature").agg(side(0, 0), side(0, 1), side(1, 0), side(1, 1)), "features")
    docs = table.filter("feature = ''").first()
    out: dict[int, dict[str, float]] = {}
    for h in (0, 1, 2):
        tox, clean = ("n01 + n11", "n00 + n10") if h == 2 else (f"n{h}1", f"n{h}0")
        all_tox, all_clean = ((docs["n01"] + docs["n11"], docs["n00"] + docs["n10"]) if h == 2 else (docs[f"n{h}1"], docs[f"n{h}0"])) if docs else (0, 0)
        weight = (F.log((F.expr(tox) + 0.5) / (all_tox + 1.0)) - F.log((F.expr(clean) + 0.5) / (all_clean + 1.0))
                  - 1.64 * F.sqrt(1.0 / (F.expr(tox) + 0.5) + 1.0 / (F.expr(clean) + 0.5)))
        best = table.filter("feature <> ''").select("feature", weight.alias("w")).filter(F.col("w") >= floor) \
            .orderBy(F.desc("w"), "feature").limit(max_features).collect()
        out[h] = {r["feature"]: r["w"] for r in best}
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> np.ndarray:
    """Ridge logistic regression by damped Newton steps; the last coefficient is the intercept."""
    a = np.hstack([x, np.ones((len(x), 1))])
    beta = np.zeros(a.shape[1])
    penalty = ridge * np.eye(a.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        grad = a.T @ (p - y) + penalty @ beta
        hess = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(hess, grad)
        beta -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return beta


def evidence_column(bc, half, text):
    """Evidence of ``text`` under the lexicon that ``half`` names; ``bc`` broadcasts the lexicons."""

    @F.pandas_udf("array<double>")
    def evidence(halves: pd.Series, texts: pd.Series) -> pd.Series:
        lex = bc.value
        return pd.Series([list(lex[h].evidence(t)) for h, t in zip(halves, texts, strict=True)])
    return evidence(half, text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_rows: int = 10_000, max_features: int = 20_000) -> DataFrame:
    """(id, held_out, score) per input row.

    Labels are learned from rows whose crc32 fold is not 1.  Null and empty
    texts have no evidence and get the score of that.  Without labelled rows of
    both classes the score is the smoothed share of class 1.  Repeated rows are
    scored each; an empty table gives an empty result; other columns are not
    read.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).alias("id"), (crc_fold(id_col) == 1).alias("held_out"), text_or_empty(text_col).alias("text"))
    model = char_model(rows.select("text"))
    sample = scratch_table(labelled_sample(docs, labels, id_col, text_col, label_col, max_rows), "labelled")
    weights = weigh_features(sample, model, max_features)
    lexicons = {h: Lexicon(model, w) for h, w in weights.items()}
    bc = sc.broadcast(lexicons)
    # each half is scored with the weights of the other one, as unseen documents will be
    fit = sample.select("label", evidence_column(bc, 1 - F.col("half"), F.col("text")).alias("x")).collect()
    y = np.array([r["label"] for r in fit], dtype=float)
    if len(y) and 0 < y.sum() < len(y):
        beta = fit_logistic(np.array([r["x"] for r in fit]), y)
    else:
        beta = np.array([0.0, 0.0, 0.0, np.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    x = rows.select("id", "held_out", evidence_column(bc, F.lit(2), F.col("text")).alias("x"))
    z = sum((F.col("x")[i] * float(beta[i]) for i in range(3)), F.lit(float(beta[3])))
    return x.select("id", "held_out", (1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))).alias("score"))


def op5_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    s = toxicity_scores(docs, labels)
    return s.select(F.col("id").alias("doc_id"), "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
