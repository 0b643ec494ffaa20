"""Language identification by cross-parsing entropy.

For every language seen in labelled text a suffix automaton of a bounded sample is built. A text is cross-parsed
against each: from the left, the longest factor of the sample, then the next, and so on; the language whose parse has
the fewest phrases, per symbol and normalised by the logarithm of its sample's length, wins. Samples of less than
``SMALLEST`` symbols count as that long: the logarithm of a few symbols would make their short phrases cheap.

Symbols are learned: every letter (Unicode category L, of any plane, lower-cased) or mark (category M, which many scripts
write vowels with) of the samples is a symbol of its own, a run of anything else is one blank, and a letter that no sample
has is one that matches nothing. Each language numbers the letters of its own sample, so that a script costs only the
languages written in it. Parses restart every ``BLOCK`` symbols so that many blocks, of all texts and lengths, are parsed
in lock-step with array look-ups; a restart adds at most one phrase a block, to all languages alike. Steps stand in dense
tables as long as those of all languages fit into ``DENSE`` entries, and else as sorted lists; both give equal parses.

Training rows: non-null text and language, held-out ids excluded, distinct texts in the order of their hash; per language
``sample`` characters are taken, a piece from a hashed place of each text: pieces are as long as ``texts`` texts need to
fill the sample, more texts are taken where some are shorter, and pieces are longer where there are fewer. Those bounds
are parameters (``SAMPLE`` and ``TEXTS`` by default); the parse covers every symbol of every text.

Defined results: ``und`` with score 0 for a null text or one without letters (digits, signs and emoji are none), and for every text when there is nothing
to learn from; ties go to the language that is first by code point; repeated rows get equal results. The score is
``1 - best / next best`` phrases mapped to 0..1 (1 when only one language is known).

``keep_identified`` gives rows without a language the predicted one, and rejects texts without letters, and texts that need more normalised phrases a symbol than held-in text
of their best language does. That limit is fitted on the sample: one half of a language's texts is parsed against the
other, in pieces of each of ``PIECES`` symbols, and a text is held to the pieces that are not longer than it. Texts
shorter than the shortest piece, and languages with too little text to fit a limit, are not rejected.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .automaton import SuffixAutomaton
from .shingles import utf8
from .stage import cut, held_out, small_batches

SAMPLE = 24_000
#: Texts of a language that its sample is spread over, if they are long enough.
TEXTS = 64
BLOCK = 512
#: Symbols that a smaller sample is normalised as.
SMALLEST = 4_096
#: Lengths of the held-in pieces that limits are fitted on, the fewest pieces for a limit, and its deviations above their mean.
PIECES, FEWEST, DEVIATIONS = (32, 64, 128, 256, 512), 8, 6.0
BLANK = 0
#: Entries (four bytes each) of all languages' dense tables.
DENSE = 1 << 26
UNDETERMINED = "und"
#: Blocks that are parsed at once, and texts, by their number and bytes, that are taken from a batch at once.
_LANES, _ROWS, _BYTES = 1 << 11, 2_000, 1 << 20


_POINTS = 0x40000  # no letters or marks of scripts stand beyond, but for _LATE
_LATE = range(0xE0100, 0xE01F0)
_KINDS: list[tuple[np.ndarray, np.ndarray]] = []


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point: 2 for letters, 1 for marks, 0 for anything else; and its lower case."""
    if not _KINDS:
        kind, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.int32)
        for c in (*range(_POINTS), *_LATE):
            x = chr(c)
            if x.isalpha():
                kind[c] = 2
                low = x.lower()
                if low != x and len(low) == 1:
                    lower[c] = ord(low)
            elif unicodedata.category(x)[0] == "M":
                kind[c] = 1
        _KINDS.append((kind, lower))
    return _KINDS[0]


def letters_of(text: str) -> tuple[np.ndarray, bool]:
    """The lower-case letters and marks of a text, runs of other characters as one 0 each; and whether there are letters."""
    kind, lower = _kinds()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    of = kind[points]
    out = np.where(of > 0, lower[points], BLANK)
    keep = out != BLANK
    keep[1:] |= out[:-1] != BLANK
    return out[keep], bool((of == 2).any())


class _Steps:
    """The steps of one language's automaton, dense or as a sorted list, over its own symbols."""

    def __init__(self, automaton: SuffixAutomaton, symbols: int, dense: bool):
        self.symbols, self.alone = symbols, len(automaton.next)
        root = np.full(symbols, self.alone, dtype=np.int32)
        for symbol, state in automaton.next[0].items():
            root[symbol] = state
        self.root, self.table = root, None
        if dense:
            self.table = automaton.jump_table(symbols)
        else:
            known = [(state * symbols + symbol, to) for state, steps in enumerate(automaton.next) for symbol, to in steps.items()]
            keys, to = np.array(sorted(known), dtype=np.int64).T
            # one more key than any: a search never ends beyond
            self.keys, self.to = np.append(keys, np.iinfo(np.int64).max), np.append(to, 0).astype(np.int32)

    def take(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states; where there is no step on, minus the state after a restart less one."""
        if self.table is not None:
            return self.table.take(state * self.symbols + symbol)
        key = state.astype(np.int64) * self.symbols + symbol
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], -self.root[symbol] - 1)


class Model:
    """The automata of the samples of languages."""

    def __init__(self, samples: dict[str, list[str]], dense: int = DENSE):
        self.languages = sorted(samples)
        sequences = {name: [letters_of(t)[0] for t in samples[name]] for name in self.languages}
        learned = {name: np.union1d([BLANK], np.concatenate(sequences[name])) for name in self.languages}
        #: every learned letter in order; symbols are places in it, the last one for all others
        self.letters = np.unique(np.concatenate([np.array([BLANK]), *learned.values()])).astype(np.int32)
        self.of = np.full(0x110000, len(self.letters), dtype=np.uint32)
        self.of[self.letters] = np.arange(len(self.letters))
        self.steps, self.own, self.scale = [], [], []
        automata = []
        for name in self.languages:
            own = np.full(len(self.letters) + 1, len(learned[name]), dtype=np.int32)
            own[self.of[learned[name]]] = np.arange(len(learned[name]))
            automaton = SuffixAutomaton()
            for sequence in sequences[name]:
                automaton.add(own[self.of[sequence]])
            automata.append(automaton)
            self.own.append(own)
            self.scale.append(np.log2(max(sum(map(len, sequences[name])), SMALLEST)))
        sizes = [(len(a.next) + 1) * (len(learned[name]) + 1) for a, name in zip(automata, self.languages, strict=True)]
        self.steps = [_Steps(a, len(learned[name]) + 1, sum(sizes) <= dense) for a, name in zip(automata, self.languages, strict=True)]

    def symbols_of(self, text: str) -> tuple[np.ndarray, bool]:
        """The symbols of a text, and whether it has letters."""
        found, letters = letters_of(text)
        return self.of[found], letters

    def phrases(self, blocks: list[np.ndarray]) -> np.ndarray:
        """Phrases of each block (of at most ``BLOCK`` symbols) against each language."""
        order = np.argsort([-len(b) for b in blocks], kind="stable")
        sizes = np.array([len(blocks[i]) for i in order])
        grid = np.zeros((int(sizes[0]), len(blocks)), dtype=np.int32)
        for lane, i in enumerate(order):
            grid[: len(blocks[i]), lane] = blocks[i]
        live = np.searchsorted(-sizes, -np.arange(len(grid)), "left")
        out = np.empty((len(blocks), len(self.languages)))
        for k, (steps, own) in enumerate(zip(self.steps, self.own, strict=True)):
            state = np.full(len(blocks), steps.alone, dtype=np.int32)
            count = np.zeros(len(blocks), dtype=np.int32)
            mine = own[grid]
            for step, n in zip(mine, live, strict=True):
                to = steps.take(state[:n], step[:n])
                ended = to < 0
                count[:n] += ended
                to ^= -ended.astype(np.int32)  # -x - 1 where a phrase started
                state[:n] = to
            out[order, k] = count * self.scale[k]
        return out

    def costs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Normalised phrases of each text against each language, and whether it has letters."""
        blocks, owner = [], []
        costs, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=bool)

        def parse() -> None:
            if blocks:
                np.add.at(costs, owner, self.phrases(blocks))
                blocks.clear()
                owner.clear()

        for i, text in enumerate(texts):
            sequence, letters[i] = self.symbols_of(text)
            for at in range(0, len(sequence), BLOCK):
                blocks.append(sequence[at : at + BLOCK])
                owner.append(i)
                if len(blocks) >= _LANES:
                    parse()
        parse()
        return costs, letters

    def identified(self, texts: list[str]) -> tuple[np.ndarray, list[str | None]]:
        """Whether each text has letters and parses like held-in text of its best language; and that language."""
        costs, letters = self.costs(texts)
        if not self.languages:
            return letters, [None] * len(texts)
        best = costs.argmin(axis=1)
        sizes = np.array([len(letters_of(t)[0]) for t in texts])
        limit = self.limits[best, np.searchsorted(PIECES, sizes, "right")]
        return letters & (costs[np.arange(len(texts)), best] <= limit * np.maximum(sizes, 1)), [self.languages[b] for b in best]

    def fit_limits(self, samples: dict[str, list[str]]) -> None:
        """Most normalised phrases a symbol of held-in text, by language and by how many of ``PIECES`` a text reaches."""
        self.limits = np.full((len(self.languages), len(PIECES) + 1), np.inf)
        for k, name in enumerate(self.languages):
            halves = [samples[name][::2], samples[name][1::2]]
            if not halves[1]:
                text = samples[name][0]
                halves = [[text[: len(text) // 2]], [text[len(text) // 2 :]]]
            models = [Model({name: half}) for half in halves]
            for at, size in enumerate(PIECES):
                rates: list[float] = []
                for model, half in zip(models, reversed(halves), strict=True):
                    sequences = [model.symbols_of(t)[0] for t in half]
                    pieces = [s[i : i + size] for s in sequences for i in range(0, len(s) - size + 1, size)]
                    if pieces:
                        rates += (model.phrases(pieces)[:, 0] / size).tolist()
                # too few pieces: what shorter ones allow
                self.limits[k, at + 1] = max(max(rates), np.mean(rates) + DEVIATIONS * np.std(rates)) if len(rates) >= FEWEST else self.limits[k, at]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        costs, letters = self.costs([t or "" for t in texts])
        best = costs.argmin(axis=1)
        ranked = np.sort(costs, axis=1)
        score = np.clip(1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1e-12), 0, 1) if costs.shape[1] > 1 else np.ones(len(texts))
        return [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, letters, strict=True)], np.where(letters, score, 0.0).tolist()


def train(rows: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> Model:
    """Automata of the samples of ``rows(text, lang)``."""
    return Model(samples_of(rows, sample, texts))


def _level(lengths: list[int], sample: int, piece: int) -> int:
    """The least size of a piece, ``piece`` or more, with which the texts fill the sample."""
    rest, left = sample, len(lengths)
    for n in sorted(lengths):
        if n * left >= rest:
            break
        rest, left = rest - n, left - 1
    return max(piece, -(-rest // left)) if left else max(piece, *lengths)


def samples_of(rows: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> dict[str, list[str]]:
    """Pieces of distinct texts of each language of ``rows(text, lang)``: ``sample`` characters, or all there are."""
    rows = rows.where("text is not null and lang is not null and length(trim(text)) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    piece = max(1, sample // texts)
    # a text gives a character at least: so many texts fill every sample
    first = Window.partitionBy("lang").orderBy("h")
    ranked = rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n")).withColumn("k", F.row_number().over(first)).where(F.col("k") <= sample)
    share = F.least("n", F.lit(piece))
    picked = ranked.withColumn("before", F.sum(share).over(first.rowsBetween(Window.unboundedPreceding, 0)) - share).where(F.col("before") < sample)
    lengths: dict[str, list[tuple[int, int]]] = {}
    for row in picked.select("lang", "h", "n").toLocalIterator():
        lengths.setdefault(row["lang"], []).append((row["h"], row["n"]))
    if not lengths:
        return {}
    levels = {name: _level([n for _, n in held], sample, piece) for name, held in lengths.items()}
    chosen = rows.sparkSession.createDataFrame([(name, h, levels[name]) for name, held in lengths.items() for h, _ in held], "lang string, h long, level int")
    start = F.expr("cast(1 + pmod(xxhash64(text, 1), greatest(length(text) - level, 0) + 1) as int)")
    pieces = rows.join(F.broadcast(chosen), ["lang", "h"]).select("lang", "h", F.col("text").substr(start, F.col("level")).alias("text")).dropDuplicates(["lang", "h"])
    samples: dict[str, list[str]] = {}
    for row in pieces.orderBy("lang", "h").toLocalIterator():
        taken = samples.setdefault(row["lang"], [])
        text = row["text"][: max(0, sample - sum(map(len, taken)))]
        if text:
            taken.append(text)
    return samples


def _parts(batch: pa.RecordBatch, place: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of few bytes of text, or one row: what a task holds beside the batch doesn't grow with it."""
    sizes = pc.fill_null(pc.binary_length(batch.column(place)), 0).to_numpy(zero_copy_only=False)
    ends, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(max(at + 1, int(np.searchsorted(ends, before + _BYTES, "right"))), at + _ROWS)
        yield batch.slice(at, to - at)
        at = to


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every row of ``docs(doc_id, text)``."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 1):
                names, scores = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def language_of(docs: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> DataFrame:
    """Train on the rows of ``docs(doc_id, text, lang)`` that aren't held out, then identify all rows."""
    return identify(docs, train(docs.where(~held_out()).select("text", "lang"), sample, texts))


def keep_identified(docs: DataFrame, sample: int = SAMPLE, texts: int = TEXTS) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` that parse like text of a learned language, with a null ``lang`` filled in.

    All other columns, and languages that are given, are as they were. With no labelled text to learn from nothing can be
    rejected but texts without letters, and nothing be filled in. Repeated rows fare alike; null ids count as not held out.
    """
    samples = samples_of(docs.where(~held_out()).select("text", F.col("lang").cast("string")), sample, texts)
    model = Model(samples)
    model.fit_limits(samples)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place, named = docs.columns.index("text"), docs.columns.index("lang")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, place):
                kept, names = shared.value.identified([t or "" for t in part.column(place).to_pylist()])
                given = part.column(named)
                if pa.types.is_string(given.type) or pa.types.is_large_string(given.type):
                    filled = pc.if_else(pc.is_null(given), pa.array(names, given.type), given)
                    part = pa.RecordBatch.from_arrays([filled if i == named else c for i, c in enumerate(part.columns)], schema=part.schema)
                yield part.filter(pa.array(kept, pa.bool_()))

    # small batches hold for what is executed here: later stages don't parse again, either
    with small_batches(docs.sparkSession):
        return cut(docs.mapInArrow(keep, docs.schema))
