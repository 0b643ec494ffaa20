"""Toxicity by noisy-channel deobfuscation.

Toxic words hide as ``1d10t``, ``i d i o t`` or ``idiiiiot``. A stretch of text that looks written so (a digit or sign
among letters, three single letters or more set apart, a letter three times; of any length) becomes a lattice: a character
stands for itself or for the letters it imitates, a sign may also stay a sign, a run of separators is dropped or is a
blank between words, and a letter may repeat the one before. A Viterbi search over the whole lattice under a character
trigram model finds the likeliest restored words; channel steps other than a letter for itself have a price. No state is
pruned: the model knows the last two symbols, so the states of a place are the pairs that can stand there. The model
counts the trigrams of all documents, so it grows with the corpus; letters beyond Latin-1 share symbols by the remainder
of their code point, which bounds its size, and keeps the letters of one script apart.

The restored text is scored with a learned lexicon: words that appear in enough toxic training documents and hardly
elsewhere (by the lower bound of their precision), and starts of words (three letters or more) of which the same holds
for several words, each with its precision. A logistic function of the evidence of the distinct lexicon words that a document holds, of
the evidence of the strongest, of their share in its words, and of how much of the text was restored, fitted on the same
rows, gives the score; a document without a lexicon word has one too.

Labels are learned from rows that are not held out, at most ``labelled`` toxic ones and twice as many others, by hash of
the id. Their texts stay on the executors: the driver gets features that pass the lexicon's limits, and a row of numbers a
document.

Defined results: null and empty texts have no evidence and get the score of that; all scores are 0 when nothing toxic is
labelled; labels that are null or unmatched teach nothing; repeated rows get equal scores; documents labelled twice teach
twice; more columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import letters_of
from .stage import cut, held_out

LABELLED = 3_000
THRESHOLD = 0.7
LONGEST_PREFIX = 9
SHORTEST_PREFIX = 3

# The letters that a character imitates.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}

SYMBOLS = 128
_LETTER = r"[^\W\d_]"
_SIGNS = re.escape("".join(c for c in LEET if not c.isalnum()))
_ANY = rf"[\w{_SIGNS}]"
_SIGN = rf"[\d_{_SIGNS}]"
#: A token with a sign among letters; three or more single letters set apart; a token with a letter three times.
_LEETED = re.compile(rf"(?<!{_ANY})(?={_SIGN}*{_LETTER}+{_SIGN}+{_LETTER}|{_SIGN}{{1,2}}{_LETTER}{{2}}){_ANY}{{3,}}(?!{_ANY})")
_SPACED = re.compile(rf"(?<!{_ANY})(?!_){_ANY}(?:[ ._*-]+(?!_){_ANY}){{2,}}(?!{_ANY})")
_REPEATED = re.compile(rf"(?<!{_LETTER})(?={_LETTER}*?({_LETTER})\1\1){_LETTER}{{3,}}(?!{_LETTER})")
_WORD = re.compile(rf"{_LETTER}+")
_PARTS = re.compile(r"[ ._*-]+|.", re.DOTALL)

#: Prices in nats of reading a sign as a letter or as itself, and of taking a letter as a repetition.
SUBSTITUTE, KEEP_SIGN, REPEAT, KEEP_REPEAT = 0.4, 3.0, 0.2, 2.5
#: Prices of dropping separators and of taking them as a blank: of one, and of a longer run.
SEPARATE, SEPARATE_RUN, KEEP_BLANK, KEEP_RUN = 0.1, 1.5, 1.5, 0.2
#: The price of taking one of just two equal letters as a repetition.
REPEAT_ONCE = 9.0
#: A start of words counts if so many toxic words have it.
DISTINCT_WORDS = 5
#: Precision, as the lower bound of an interval of so many deviations squared, that a feature must have.
LEAST_PRECISION, DEVIATIONS = 0.4, 2.7


def symbols_of(text: str) -> np.ndarray:
    """The model's symbols of a text: 0 for all but letters, then a-z, Latin-1, and other letters by remainder."""
    points, _ = letters_of(text)
    others = 60 + points % 68
    return np.where(points == 0, 0, np.where(points < 128, points - 96, np.where((points >= 0xDF) & (points <= 0xFF), points - 0xDF + 27, others))).astype(np.uint8)


class CharacterModel:
    """Interpolated trigrams over the fixed alphabet."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (three + 8 * p2[None]) / (three.sum(axis=2, keepdims=True) + 8)
        self.cost = -np.log(p3).astype(np.float32)

    def restore(self, observed: str) -> str:
        """The likeliest words behind an observed stretch (lower case)."""
        # by the last two symbols: the price so far, and the characters as (all before, last)
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        parts = _PARTS.findall(observed)
        cost = self.cost
        for place, c in enumerate(parts):
            out: dict[tuple[int, int], tuple[float, tuple | None]] = {}

            def offer(key, price, word, out=out) -> None:
                if key not in out or price < out[key][0]:
                    out[key] = (price, word)

            def blank(a, b, price, word, sign, offer=offer) -> None:
                if b == 0:
                    offer((a, b), price, (word, sign) if sign != " " else word)
                else:
                    offer((b, 0), price + float(cost[a, b, 0]), (word, sign))

            if _code(c) == 0 and c not in LEET:
                long = len(c) > 1
                for (a, b), (price, word) in states.items():
                    offer((a, b), price + (SEPARATE_RUN if long else SEPARATE), word)
                    blank(a, b, price + (KEEP_RUN if long else KEEP_BLANK), word, " ")
                states = out
                continue
            three = parts[place - 1 : place + 2] == 3 * [c] or parts[place : place + 3] == 3 * [c] or parts[max(0, place - 2) : place + 1] == 3 * [c]
            readings = [(x, SUBSTITUTE) for x in LEET[c]] if c in LEET else [(c, 0.0)]
            for (a, b), (price, word) in states.items():
                if c in LEET:
                    blank(a, b, price + KEEP_SIGN, word, c)
                for letter, more in readings:
                    k = _code(letter)
                    if b == k:
                        offer((a, b), price + more + (REPEAT if three else REPEAT_ONCE), word)
                    offer((b, k), price + more + float(cost[a, b, k]) + KEEP_REPEAT * (a == b == k), (word, letter))
            states = out
        word = min(((price + (float(cost[a, b, 0]) if b else 0.0), a, b) for (a, b), (price, _) in states.items()), default=None)
        word = states[word[1:]][1] if word else None
        letters = []
        while word:
            word, letter = word
            letters.append(letter)
        return "".join(reversed(letters))


@lru_cache(maxsize=4096)
def _code(c: str) -> int:
    got = symbols_of(c)
    return int(got[0]) if len(got) else 0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of all texts: a fixed number of sums, whatever the corpus."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(SYMBOLS**3, dtype=np.int64), [], 0
        for batch in batches:
            for text in batch.column("text"):
                s = np.concatenate(([0, 0], symbols_of(text.as_py() or ""), [0])).astype(np.int32)
                held.append((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:])
                size += len(s)
                if size > 1 << 20:
                    total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["gram", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3, dtype=np.int64)
    got = rows.toArrow()
    counts[got.column("gram").to_numpy()] = got.column("n").to_numpy()
    return counts


class Restorer:
    """Restored text, with a memory of short stretches seen before."""

    LONGEST, MOST = 64, 200_000

    def __init__(self, model: CharacterModel):
        self.model = model
        self.seen: dict[str, str] = {}
        self.restored = 0

    def _word(self, match: re.Match) -> str:
        found = match.group(0)
        if found not in self.seen:
            if sum(map(str.isalpha, found)) < 2:
                return found
            if len(found) > self.LONGEST:
                self.restored += 1
                return self.model.restore(found)
            if len(self.seen) > self.MOST:
                self.seen.clear()
            self.seen[found] = self.model.restore(found)
        self.restored += 1
        return self.seen[found]

    def __call__(self, text: str) -> str:
        """The text restored; ``restored`` counts its stretches."""
        text, self.restored = text.lower(), 0
        for pattern in (_SPACED, _LEETED, _REPEATED):
            text = pattern.sub(self._word, text)
        return text


def _features(text: str) -> set[str]:
    """Distinct words (ended by a blank) and their starts."""
    words = set(_WORD.findall(text))
    out = {w + " " for w in words}
    for w in words:
        out.update(w[:n] for n in range(SHORTEST_PREFIX, min(len(w), LONGEST_PREFIX) + 1))
    return out


def learn_lexicon(texts: DataFrame) -> dict[str, float]:
    """Features of restored ``texts(text, toxic)`` with their precision; of nested starts that say the same, the shortest."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (toxic if y else clean).update(_features(text))
            names = list(toxic | clean)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic[f] for f in names], pa.int64()), pa.array([clean[f] for f in names], pa.int64())], ["feature", "toxic", "clean"])

    counts = cut(texts.select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 0"))
    n_toxic = texts.where("toxic = 1").count()
    least = max(3, math.ceil(0.006 * n_toxic))
    word = F.col("feature").endswith(" ")
    size = F.least(F.length("feature") - 2, F.lit(LONGEST_PREFIX))
    starts = counts.where(word & (size >= SHORTEST_PREFIX)).select(F.explode(F.transform(F.sequence(F.lit(SHORTEST_PREFIX), size), lambda n: F.substr(F.col("feature"), F.lit(1), n))).alias("start"))
    starts = starts.groupBy("start").agg(F.count("*").alias("words")).where(F.col("words") >= DISTINCT_WORDS)
    held = counts.where(F.col("toxic") >= least).join(starts, F.col("feature") == F.col("start"), "left").where(word | F.col("start").isNotNull())
    n, z2 = F.col("toxic") + F.col("clean"), F.lit(DEVIATIONS)
    p = F.col("toxic") / n
    low = (p + z2 / (2 * n) - F.sqrt(z2 * (p * (1 - p) / n + z2 / (4 * n * n)))) / (1 + z2 / n)
    rows = held.select("feature", low.alias("low"), ((F.col("toxic") + 0.5) / (n + 1)).alias("p")).where(F.col("low") >= LEAST_PRECISION).collect()
    out = {r["feature"]: r["low"] for r in rows}
    # a longer start or word of a start that is as good adds nothing
    return {r["feature"]: r["p"] for r in rows if not any(out.get(r["feature"][:n], 0) >= r["low"] - 0.05 for n in range(SHORTEST_PREFIX, len(r["feature"])))}


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the last column of x is 1."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, x.T @ (p - y) + ridge * w)
    return w


class Scorer:
    """Scores of whole texts under a lexicon and weights."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None = None):
        self.lexicon, self.weights = lexicon, weights
        self.search = ahocorasick.Automaton()
        for feature, p in lexicon.items():
            word = feature.strip()
            self.search.add_word(word, (len(word), *((0.0, p) if feature.endswith(" ") else (p, 0.0))) if word not in self.search else _both(self.search.get(word), feature, p))
        if lexicon:
            self.search.make_automaton()

    def evidence(self, text: str, restored: int = 0) -> list[float]:
        """Of a restored text: in all, of the strongest, by share of the words, whether there is any; the share of stretches restored; 1."""
        hits: dict[str, float] = {}
        for end, (size, start, whole) in self.search.iter(text) if self.lexicon else ():
            first = end - size + 1
            if first and _WORD.match(text, first - 1):
                continue
            word = _WORD.match(text, first).group(0)
            p = max(start, whole if len(word) == size else 0.0)
            if p:
                hits[word] = max(p, hits.get(word, 0.0))
        words = 1 + text.count(" ") + text.count("\n")
        each = [-math.log(1 - min(p, 0.99)) for p in hits.values()]
        return [math.log1p(sum(each)), max(each, default=0.0), math.sqrt(len(each) / words), float(bool(each)), math.sqrt(restored / words), 1.0]

    def score(self, text: str, restored: int = 0) -> float:
        if self.weights is None:
            return 0.0
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(self.evidence(text, restored), self.weights)))))))


def _both(held: tuple, feature: str, p: float) -> tuple:
    """A start and a word of the same letters."""
    size, start, whole = held
    return (size, start, p) if feature.endswith(" ") else (size, p, whole)


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> tuple[CharacterModel, dict[str, float], np.ndarray | None]:
    """The character model of all ``docs(doc_id, text)``; the lexicon and weights of the labelled rows that aren't held out."""
    model = CharacterModel(trigram_counts(docs))
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select(F.col("doc_id").alias("l_id"), F.col("toxic").cast("int").alias("toxic"))
    draw = lambda y, n: known.where(F.col("toxic") == y).orderBy(F.xxhash64("l_id"), "l_id").limit(n)
    # a bounded number of ids, so that the documents stay where they are
    picked = F.broadcast(draw(1, labelled).unionByName(draw(0, 2 * labelled)))
    rows = docs.where("text is not null").join(picked, F.col("doc_id") == F.col("l_id")).select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def restored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(shared.value)
        for batch in batches:
            found = [(restore(t), restore.restored) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64()), batch.column("toxic")], ["text", "restored", "toxic"])

    texts = cut(rows.mapInArrow(restored, "text string, restored long, toxic int"))
    if texts.where("toxic = 1").isEmpty():
        return model, {}, None
    lexicon = learn_lexicon(texts)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            found = [scorer.evidence(t, n) for t, n in zip(batch.column("text").to_pylist(), batch.column("restored").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    # one order on every run
    seen = sorted((list(r["x"]), r["toxic"]) for r in texts.mapInArrow(evidence, "x array<double>, toxic int").collect())
    return model, lexicon, fit_logistic(np.array([x for x, _ in seen]), np.array([y for _, y in seen], dtype=float))


def score_toxicity(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` per row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string"))
    shared = spark.sparkContext.broadcast(train(docs, labels, labelled))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, lexicon, weights = shared.value
        restore, scorer = Restorer(model), Scorer(lexicon, weights)
        for batch in batches:
            scores = [scorer.score(restore(t.as_py() or ""), restore.restored) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(score, f"doc_id {kind}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
