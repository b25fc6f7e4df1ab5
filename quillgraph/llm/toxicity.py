"""Toxicity by a weighted lexicon.

Texts are folded (case, compatibility forms, homoglyphs, digits and signs that stand for
letters, zero-width characters). Accents stay, as they tell words apart in many
languages; words with accents are read a second time without them, and letters that
stand alone in a row (i d i o t) a second time as one word. One Aho-Corasick automaton
then finds all entries, at the start of words and inside of them.

The lexicon is learned from labelled rows: words and word stems (of 4 to 8 letters) far
more frequent in toxic documents, weighted by log-odds of their capped counts. Exception
phrases (a match with its neighbour word, seen only in clean documents) cancel a match.
The weighted matches, as they are and normalised by length, give the score through a
logistic fit, whose features come from lexicons that were learned without the row's own
half of the sample.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import small_batches, table, written
from quillgraph.llm.quality import bounded, fold, learning_rows

#: Labelled rows that the lexicon and the fit are learned from, at most.
TRAIN_ROWS = 12_000
CUT = 0.7
#: Stems have so many letters. Whole words have any number.
STEM = (4, 8)
#: An occurrence counts up to so many times in a document.
REPEATS = 4
#: Lexicon entries: the least toxic documents, their least share, the least log-odds.
#: The share bounds the lexicon: it has at most 1 / MIN_SHARE times as many entries as
#: a toxic document has different words and stems.
MIN_DOCS = 3
MIN_SHARE = 0.005
MIN_ODDS = 2.5
MAX_ODDS = 8.0
#: A phrase is an exception if so many clean and no toxic documents have it.
EXCEPTION_DOCS = 3
#: What a clean document taken for toxic costs, in missed toxic ones of equal shares.
CLEAN_WEIGHT = 6

#: Letters of other scripts, digits and signs that look like Latin letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ԛ": "q",
    "г": "r", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѡ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ł": "l", "ø": "o", "đ": "d", "æ": "ae", "œ": "oe",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l"}
HIDDEN = "­​‌‍⁠﻿"
BREAKS = "\t\n\r\x0b\x0c!\"#%&'()*+,-./:;<=>?[\\]^_`{|}~ –—‘’“”…"


class _Fold(dict):
    """Translation of code points, decided when one is first met. Latin letters keep
    their accents, letters of other scripts lose them before they are looked up."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in HIDDEN or unicodedata.combining(c):
            out = ""
        elif c in BREAKS:
            out = " "
        else:
            own = unicodedata.normalize("NFKC", c).lower()
            bare = "".join(x for x in unicodedata.normalize("NFKD", own) if not unicodedata.combining(x))
            if not all("a" <= x <= "z" for x in bare):
                own = bare
            out = "".join(SUBSTITUTES.get(x, HOMOGLYPHS.get(x, x)) for x in own)
        self[code] = out
        return out


class _Plain(dict):
    """Letters without their accents."""

    def __missing__(self, code: int) -> str:
        out = self[code] = "".join(x for x in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(x))
        return out


_FOLD, _PLAIN = _Fold(), _Plain()
_APART = re.compile(r"(?<= )(?:[^\W\d_] ){4,}(?=[^ ]{2}|$| )")


def fold_text(text: str) -> str:
    """The folded text, with a space before and behind; then, behind a line break, words
    with accents again without them, and rows of single letters again as words."""
    text = unicodedata.normalize("NFC", text) if not text.isascii() else text
    folded = f" {text.translate(_FOLD)} "
    more = [m[0].replace(" ", "") for m in _APART.finditer(" ".join(["", *folded.split(), ""]))] if "  " in folded or _APART.search(folded) else []
    if not folded.isascii():
        more += [w.translate(_PLAIN) for w in folded.split() if not w.isascii()]
    return folded + "\n" + "".join(f" {w}" for w in more) + " " if more else folded


def grams(folded: str) -> Counter:
    """How often each whole word (" word ") and stem (" wor") is in a folded text, up to
    REPEATS."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        n = min(n, REPEATS)
        out[f" {w} "] += n
        for k in range(STEM[0], min(STEM[1], len(w) - 1) + 1):
            out[f" {w[:k]}"] += n
    return Counter({g: min(n, REPEATS) for g, n in out.items()})


def automaton(lexicon: dict[str, float]):
    """Entries as they stand (at a word's start), and without the space before, which
    finds them inside of words."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, w in lexicon.items():
        a.add_word(k, (len(k), w, k, False))
        inner = k.strip()
        if inner not in a:
            a.add_word(inner, (len(inner), w, k, True))
    if lexicon:
        a.make_automaton()
    return a


def matches(auto, folded: str) -> tuple[list[tuple[int, str, float]], list[tuple[int, str, float]]]:
    """(start, entry, weight): one for each word that begins with entries, the heaviest;
    and the same for places inside of words."""
    if not len(auto):
        return [], []
    found: tuple[dict, dict] = ({}, {})
    for end, (n, w, k, inner) in auto.iter(folded):
        start = end - n + 1
        if inner and (folded[start - 1].isspace() or k.endswith(" ") and not folded[end + 1].isspace()):
            continue
        own = found[inner]
        if start not in own or own[start][1] < w:
            own[start] = (k, w)
    return tuple([(a, k, w) for a, (k, w) in sorted(f.items())] for f in found)


def phrases(folded: str, start: int) -> list[str]:
    """The matched word with the word before, and with the word behind, if any."""
    end = folded.find(" ", start + 1)
    word = folded[start + 1 : end]
    stop = end
    while stop < len(folded) and folded[stop] == " ":
        stop += 1
    behind = folded[stop : folded.find(" ", stop)] if stop < len(folded) else ""
    stop = start
    while stop >= 0 and folded[stop] == " ":
        stop -= 1
    before = folded[folded.rfind(" ", 0, stop + 1) + 1 : stop + 1] if stop >= 0 else ""
    return [p for p in (f"{before} {word}" if before else "", f"{word} {behind}" if behind else "") if p]


def doc_features(auto, exceptions: frozenset[str], text: str) -> list[float]:
    """Weighted matches: their log sum, per hundred words, the heaviest, how many, the
    most of one entry, the share of words, and those inside of words per hundred."""
    folded = fold_text(text)
    at_start, inside = matches(auto, folded)
    weights, same = [], Counter()
    for start, k, w in at_start:
        if not exceptions or exceptions.isdisjoint(phrases(folded, start)):
            weights.append(w)
            same[k] += 1
    total, n = sum(weights), len(weights)
    words = max(1, len(folded.split()))
    return [
        np.log1p(total), np.log1p(100 * total / (words + 20)), max(weights, default=0.0) / MAX_ODDS, np.log1p(n), np.log1p(max(same.values(), default=0)),
        np.log((n + 0.1) / (words + 20)) / 4, np.log1p(100 * sum(w for _, _, w in inside) / (words + 20)),
    ]


N_FEATURES = 7


def _counted(rows: DataFrame, of, name: str) -> DataFrame:
    """(gram, toxic, clean, toxic_docs, clean_docs): how often each gram is in documents
    of (text, y), and in how many. Batches are counted before they leave Python."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n: tuple[Counter, Counter] = (Counter(), Counter())
            docs: tuple[Counter, Counter] = (Counter(), Counter())
            for text, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = of(text or "")
                n[y].update(own)
                docs[y].update(own.keys())
            keys = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (n[1], n[0], docs[1], docs[0]))], names=[name, "toxic", "clean", "toxic_docs", "clean_docs"])

    counts = ("toxic", "clean", "toxic_docs", "clean_docs")
    return rows.select("text", "y").mapInArrow(count, f"{name} string, " + ", ".join(f"{c} long" for c in counts)).groupBy(name).agg(*(F.sum(c).alias(c) for c in counts))


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries by log-odds of their counts. A stem stands for all words it begins; longer
    stems and words that begin with a kept stem are not kept as well."""
    sizes = {r.y: r["count"] for r in sample.groupBy("y").count().collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(MIN_DOCS, int(MIN_SHARE * n_toxic))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    rows = _counted(sample, lambda t: grams(fold_text(t)), "gram").where(F.col("toxic_docs") >= least).withColumn("odds", odds).where(F.col("odds") >= MIN_ODDS).select("gram", "odds").collect()
    kept: dict[str, float] = {}
    for r in sorted(rows, key=lambda r: (len(r.gram.rstrip()), r.gram.endswith(" "), r.gram)):
        stem = r.gram.rstrip()
        if not any(stem[:n] in kept for n in range(STEM[0] + 1, min(STEM[1] + 1, len(stem)) + 1)):
            kept[r.gram] = min(MAX_ODDS, float(r.odds))
    return kept


def learn_exceptions(sample: DataFrame, lexicon: dict[str, float]) -> frozenset[str]:
    def of(text: str) -> Counter:
        auto, folded = automaton_of(lexicon), fold_text(text)
        return Counter(p for start, _, _ in matches(auto, folded)[0] for p in phrases(folded, start))

    rows = _counted(sample, of, "phrase").where((F.col("toxic") == 0) & (F.col("clean_docs") >= EXCEPTION_DOCS)).select("phrase").collect()
    return frozenset(r.phrase for r in rows)


_AUTOMATA: dict[frozenset, object] = {}


def automaton_of(lexicon: dict[str, float]):
    """The automaton, built once in each worker."""
    key = frozenset(lexicon.items())
    if key not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[key] = automaton(lexicon)
    return _AUTOMATA[key]


def fit_logistic(x: np.ndarray, y: np.ndarray, *, steps: int = 50, l2: float = 1e-2) -> np.ndarray:
    """Newton's method with a ridge; the last weight is the bias."""
    x1 = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x1.shape[1])
    ridge = np.diag([l2] * x.shape[1] + [1e-4])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + ridge @ w
        hess = (x1 * (p * (1 - p))[:, None]).T @ x1 + ridge + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_shift(z: np.ndarray, y: np.ndarray) -> float:
    """The log-odds that part the classes best, missed toxic rows by their share against
    CLEAN_WEIGHT times that of clean ones beyond it; the middle of several."""
    if not 0 < y.sum() < len(y):
        return float(np.log(CUT / (1 - CUT)))
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    cost = np.concatenate([[0], np.cumsum(y)]) / y.sum() + CLEAN_WEIGHT * ((1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y)])) / (1 - y).sum()
    cost[1:-1][z[1:] == z[:-1]] = np.inf  # equal scores can't be parted
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    below = z[best[0] - 1] if best[0] else z[0] - 1
    above = z[best[-1]] if best[-1] < len(z) else z[-1] + 1
    return float((below + above) / 2)


def _extracted(rows: DataFrame, lexicon: dict[str, float], exceptions: frozenset[str]) -> list[tuple]:
    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton_of(lexicon)
        for b in batches:
            x = [doc_features(auto, exceptions, t or "") for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    return [(tuple(r.x), r.y) for r in rows.select("text", "y").mapInArrow(extract, "x array<double>, y int").collect()]


def train(learn: DataFrame, *, limit: int = TRAIN_ROWS) -> dict:
    """Lexicon, exceptions and fit from a bounded sample of (doc_id, text, y).

    Each half of the sample (by its texts' hash) gets its features from a lexicon of the
    other half; the weights and the cut that they give go with the lexicon of all."""
    half = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(2)).cast("int")
    sample = written(bounded(learn, limit).select("text", F.col("y").cast("int").alias("y"), half.alias("half")), "toxicity-sample")
    rows = []
    for h in (0, 1):
        other = sample.where(F.col("half") != h)
        lexicon = learn_lexicon(other)
        rows += _extracted(sample.where(F.col("half") == h), lexicon, learn_exceptions(other, lexicon))
    rows.sort()
    x, y = np.array([r[0] for r in rows]).reshape(len(rows), N_FEATURES), np.array([r[1] for r in rows], float)
    weights = fit_logistic(x, y)
    weights[-1] += np.log(CUT / (1 - CUT)) - best_shift(x @ weights[:-1] + weights[-1], y)
    lexicon = learn_lexicon(sample)
    return {"lexicon": lexicon, "exceptions": learn_exceptions(sample, lexicon), "weights": weights}


def score_texts(model: dict, texts: list[str | None]) -> np.ndarray:
    auto = automaton_of(model["lexicon"])
    x = np.array([doc_features(auto, model["exceptions"], t or "") for t in texts]).reshape(len(texts), N_FEATURES)
    return 1 / (1 + np.exp(-np.clip(x @ model["weights"][:-1] + model["weights"][-1], -30, 30)))


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of every whole text; null and empty texts score as texts
    without a match; repeated rows are kept."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(model, b.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of documents; learned from labelled rows outside
    the held-out fold. A row for each row: null and empty texts score as texts without a
    match, repeated rows are kept, other columns are ignored; without labels of both
    sorts the score is the share of toxic labels, or so."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = train(learning_rows(docs, table(spark, sf_dir, "labels"), "toxic", 3, 1, keep=False))
    return score_documents(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
