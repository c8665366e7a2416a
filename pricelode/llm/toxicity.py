"""Toxicity: a weighted lexicon, matched by Aho-Corasick on folded text.

Folding lowers the case and turns into plain Latin letters: homoglyphs of other scripts, letters with
marks or strokes, small capitals, full-width, circled and mathematical forms, and digits and signs
that stand for letters. Combining marks and characters without width go. Letters that stand one by one
(``m o r o n``) are read together as well. A term counts where it begins a word (a stem) or fills
one (a whole word), unless an exception phrase of whole words overlaps it. A text's matched weight, as
such and by length, gives its score through a logistic curve. A text takes time in proportion to its length
and matches.

The lexicon has seed stems and terms learned from a bounded sample: the ``TRAIN_ROWS``
labelled rows with the smallest hash of their id (their words are counted on the
executors; what returns are the terms that could pass the bar, all of them). Weights are smoothed log odds.

Defined cases: a null or empty text matches nothing and scores as such; a very long text is matched whole; null labels
don't train, and of repeated labels or documents one row trains for each id and label; without labels of
both kinds the seed lexicon and a fixed curve are used; equal scores (ties) need no order; repeated rows are scored one
by one; a null id is scored and not held out; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import slices, small_batches
from pricelode.llm.gam import remainder, training_rows

TRAIN_ROWS = 12_000
#: Learned terms: prefixes of words, LEAST to MOST characters, and whole words from LEAST_WHOLE on, in so
#: many toxic texts at least, whose smoothed odds of a toxic text are so much over the base rate's.
LEAST, MOST = 4, 14
LEAST_WHOLE = 3
LEAST_TEXTS = 5
LEAST_LOG_ODDS = 3.0
#: A term is made longer while so many of its toxic texts agree on the next character.
AGREE = 0.9

#: Stems that are insults in plain English, with the weight they have before any training.
SEED = ("idiot", "moron", "stupid", "imbecile", "scumbag", "worthless", "pathetic", "disgusting", "dumbass", "bastard", "asshole", "bitch", "retard")
SEED_WEIGHT = 3.0
#: Phrases in which a term is no insult, as whole words (a plural s may follow).
EXCEPTIONS = (
    "trash can", "trash bin", "trash bag", "trash collection", "clown fish", "clownfish", "class clown", "losers bracket", "loser of the match",
    "oxymoron", "scum of the pond", "pond scum", "retardant", "not stupid", "idiot proof", "idiot-proof",
)

#: Letters of other scripts that look like Latin ones. Fixed values.
_HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ո": "n", "ӏ": "l",
    "г": "r", "п": "n", "һ": "h", "ѡ": "w", "ց": "g", "հ": "h", "ս": "u", "օ": "o", "ք": "f",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "η": "n", "ω": "w", "ѵ": "v", "ԛ": "q", "ԝ": "w",
}
#: Digits and signs that stand for letters. Fixed values.
_SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(_SIGNS)
_INNER_SIGN = re.compile(r"(?<=\w)[@$!](?=\w)|(?<!\w)[@$](?=\w)")
_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[^\x00-\x7f]+")
_LATIN_NAME = re.compile(r"LATIN (?:SMALL |CAPITAL )?LETTER (?:SMALL CAPITAL |SCRIPT |DOTLESS |LONG )?([A-Z])(?: WITH .+)?")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_][ .*_-]){2,}[^\W_](?![^\W_])")
_SPACES = str.maketrans("", "", " .*_-")


@lru_cache(maxsize=1 << 16)
def folded_char(c: str) -> str:
    """What a character outside ASCII folds to: the letter that it shows, nothing for marks and
    characters without width, else itself."""
    if unicodedata.category(c) in ("Mn", "Me", "Cf"):
        return ""
    low = c.lower()
    if low in _HOMOGLYPHS:
        return _HOMOGLYPHS[low]
    base = "".join(x for x in unicodedata.normalize("NFKD", c) if unicodedata.category(x) not in ("Mn", "Me"))
    if len(base) == 1 and base.lower() in _HOMOGLYPHS:
        return _HOMOGLYPHS[base.lower()]
    if len(base) == 1 and base.isascii():
        return base
    named = _LATIN_NAME.fullmatch(unicodedata.name(c, ""))
    return named[1] if named else c


def fold(text: str) -> str:
    """The folded text. A sign folds only where it leads or joins letters, else it is a blank."""
    if not text.isascii():
        text = _OTHER.sub(lambda m: "".join(map(folded_char, m[0])), text)
    low = text.lower()
    if "@" in low or "$" in low or "!" in low:
        low = _INNER_SIGN.sub(lambda m: _SIGNS[m[0]], low).translate(_DROP_SIGNS)
    return low.translate(_FOLD)


def spaced_words(folded: str) -> list[str]:
    """Runs of three or more letters that stand one by one, read together."""
    return [m[0].translate(_SPACES) for m in _SPACED.finditer(folded)]


_DROP_SIGNS = str.maketrans("@$!", "   ")


class Lexicon(NamedTuple):
    terms: dict[str, tuple[float, bool]]  # term: weight, must it fill the word
    exceptions: tuple[str, ...]
    curve: tuple[float, float, float]  # logit = a + b * log1p(weight) + c * log1p(weight per 100 words)


def automaton(lexicon: Lexicon) -> ahocorasick.Automaton:
    """Values are (length, weight, must it fill the word); an exception has no weight."""
    found = ahocorasick.Automaton()
    for phrase in lexicon.exceptions:
        found.add_word(fold(phrase), (len(fold(phrase)), None, True))
    for term, (weight, whole) in lexicon.terms.items():
        if found.get(term, None) is None:  # an exception is never a term
            found.add_word(term, (len(term), weight, whole))
    found.make_automaton()
    return found


def matched_weight(folded: str, found: ahocorasick.Automaton, inside: bool = False) -> float:
    """The weights of the terms in a folded text; of terms that overlap, the heaviest counts. With
    ``inside``, a term may stand anywhere in a word."""
    spans, covered = [], []
    size = len(folded)
    for end, (length, weight, whole) in found.iter(folded):
        begin = end - length + 1
        starts = begin == 0 or not folded[begin - 1].isalnum()
        ends = end + 1 >= size or not folded[end + 1].isalnum()
        if weight is None:
            plural = not ends and folded[end + 1] == "s" and (end + 2 >= size or not folded[end + 2].isalnum())
            if starts and (ends or plural):
                covered.append((begin, end))
        elif inside or (starts and (ends or not whole)):
            spans.append((begin, end, weight))
    merged: list[list[int]] = []  # exceptions that touch are one
    for begin, end in sorted(covered):
        if merged and begin <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([begin, end])
    total, last, best, k = 0.0, -1, 0.0, 0
    for begin, end, weight in sorted(spans):
        while k < len(merged) and merged[k][1] < begin:
            k += 1
        if k < len(merged) and merged[k][0] <= end:
            continue
        if begin <= last:
            if weight > best:
                total, best = total + weight - best, weight
        else:
            total, best = total + weight, weight
        last = max(last, end)
    return total


def text_weight(text: str, found: ahocorasick.Automaton) -> float:
    folded = fold(text)
    return matched_weight(folded, found) + sum(matched_weight(w, found, inside=True) for w in spaced_words(folded))


def measures(texts: list[str], found: ahocorasick.Automaton) -> np.ndarray:
    """(texts, 2): the matched weight, and that for each 100 words."""
    out = np.zeros((len(texts), 2))
    for i, text in enumerate(texts):
        weight = text_weight(text, found)
        if weight:
            n = text.count(" ") + text.count("\n") + 1
            out[i] = weight, 100 * weight / (n + 20)
    return out


def curve_scores(x: np.ndarray, curve: tuple[float, float, float]) -> np.ndarray:
    logit = curve[0] + np.log1p(x) @ np.array(curve[1:])
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """A ridge logistic fit by Newton's steps."""
    a = np.column_stack([np.ones(len(x)), np.log1p(x)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        ridge = np.diag([0.0, 0.1, 0.1])
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(3), a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def _prefixes(text: str) -> set[str]:
    """Distinct prefixes of the folded words of a text; a whole word ends in a blank."""
    out: set[str] = set()
    for word in set(_WORD.findall(fold(text))):
        out.update(word[:k] for k in range(LEAST, min(len(word), MOST) + 1))
        if LEAST_WHOLE <= len(word) <= MOST:
            out.add(word + " ")
    return out


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, tuple[float, bool]]:
    """From (toxic texts, clean texts) of each prefix: the shortest prefixes over the bar,
    each made longer while nearly all its toxic texts agree on the next character."""

    def odds(c: tuple[int, int]) -> float:
        return float(np.log((c[0] + 0.5) / (toxic + 1)) - np.log((c[1] + 0.5) / (clean + 1)))

    good = {p for p, c in counts.items() if c[0] >= LEAST_TEXTS and odds(c) >= LEAST_LOG_ODDS and c[0] * 4 >= c[1]}
    children: dict[str, list[str]] = {}
    for p in counts:
        children.setdefault(p[:-1], []).append(p)
    terms: dict[str, tuple[float, bool]] = {}
    for p in sorted(good, key=lambda q: (len(q), q)):
        if any(p[:k] in good for k in range(LEAST, len(p))):
            continue
        while True:
            nxt = [c for c in children.get(p, []) if counts[c][0] >= AGREE * counts[p][0]]
            if not nxt:
                break
            p = max(nxt, key=lambda c: (counts[c][0], c))
        terms[p.rstrip(" ")] = (min(odds(counts[p]), 8.0), p.endswith(" "))
    return terms


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_no: int = 0, rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text") -> Lexicon:
    small_batches(docs.sparkSession)
    sample = training_rows(docs, labels, "toxic", folds, fold_no, False, rows, doc_id, text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = Counter(), Counter()
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[y].update(_prefixes(t or ""))
            keys = list(seen[0].keys() | seen[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([seen[y][k] for k in keys], pa.int64()) for y in (1, 0))], ["term", "toxic", "clean"])

    sums = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    totals = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    terms = {t: (SEED_WEIGHT, False) for t in SEED}
    plain = Lexicon(terms, EXCEPTIONS, (-3.0, 2.0, 1.0))
    if not toxic or not clean:
        return plain
    # All terms that could be chosen: over the bar, or longer forms of one that is, which may lose a
    # share of its toxic texts with each character, but gain no clean ones.
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    bar = LEAST_LOG_ODDS + (MOST - LEAST + 1) * float(np.log(AGREE))
    wanted = sums.where((F.col("toxic") >= F.lit(LEAST_TEXTS * AGREE ** (MOST - LEAST + 1))) & (odds >= bar))
    terms |= choose_terms({r["term"]: (r["toxic"], r["clean"]) for r in wanted.collect()}, toxic, clean)
    lexicon = Lexicon(terms, EXCEPTIONS, plain.curve)
    found = sample.mapInArrow(_measuring(lexicon, "y", "text"), "y int, weight double, density double").toPandas()
    x, y = found[["weight", "density"]].to_numpy(float), found["y"].to_numpy(float)
    order = np.lexsort((y, x[:, 1], x[:, 0]))
    return lexicon._replace(curve=fit_curve(x[order], y[order]))


def _measuring(lexicon: Lexicon, keep: str, text: str):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton(lexicon)
        for batch in batches:
            for part in slices(batch, text):
                x = measures(part.column(part.schema.get_field_index(text)).to_pylist(), found)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(keep)), pa.array(x[:, 0]), pa.array(x[:, 1])], [keep, "weight", "density"])

    return measure


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, fold_no: int = 0, doc_id: str = "doc_id", text: str = "text", lexicon: Lexicon | None = None) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted``, and the matched ``weight`` of each document."""
    lexicon = lexicon or learn(docs, labels, folds, fold_no, doc_id=doc_id, text=text)
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    curve = lexicon.curve
    made = narrow.mapInArrow(_measuring(lexicon, "doc_id", "text"), f"doc_id {kind}, weight double, density double")
    logit = F.lit(curve[0]) + F.log1p("weight") * curve[1] + F.log1p("density") * curve[2]
    score = 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-30.0)), F.lit(30.0))))
    held_out = F.coalesce(remainder(F.col("doc_id"), folds) == fold_no, F.lit(False))
    return made.select("doc_id", held_out.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "weight")
