"""Spelling variants: words one edit apart, by an even-partition pigeonhole join.

Words are maximal runs of ``LETTERS`` of a text, A-Z lower-cased. A copying slip is drawn for each run of a document: with h
the crc32 of ``<doc_id>:<run>``, every ``SLIP``-th loses the code point ``h % length``. Results of at least ``SHORTEST`` code
points that occur ``LEAST`` times or more are the words; two are *near* if one insertion, deletion or replacement of a code
point makes one the other.

1. A word of length L has two segments, of L div 2 code points and the rest. An edit spares one of them: the word is indexed
   under either, with the place where the edit must then be. Words of the same length are probed at the same place, words
   one longer at the place that an insertion shifts the segment to (index and probes are rows of one table, four a word).
2. A key that more than ``CROWDED`` rows share is split: the half where the edit must be is cut into two again, of which
   an edit spares one, so its rows go on under longer keys. Down to one code point, all words of a key are near each other.
3. Rows of a key meet; a pair of different lengths that has several keys counts at the one where the words first differ,
   all others have one key only, so nothing needs a shuffle to be deduplicated. One edit is then verified.
4. A word's form is its near word of largest n (ties: the smallest), if that is twice its own n. Roots follow forms to
   their end, in steps that double.

Defined results: a null text has no words; a null id is written as nothing before the colon; repeated rows count each; more
columns are ignored; an empty table gives no rows. Texts of any length are read in slices, cut between words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as S
from .stage import cut

LETTERS = r"[a-zÀ-ÿ]+"
SLIP, SHORTEST, LEAST = 97, 5, 3
#: A form is a near word that occurs as many times as often.
FORM_TIMES = 2
#: Rows of one key; more are split by where the edit is.
CROWDED = 512
#: Code points read at a time, and distinct words held at a time.
SLICE, HELD = 1 << 20, 1 << 18
_RUNS, _OTHER = re.compile(LETTERS), re.compile(r"[^A-Za-zÀ-ÿ]")
_LOWER = bytes(S.LOWER.tolist())


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` code points that no word crosses, A-Z lower-cased."""
    first = 0
    while first < len(text):
        end = _OTHER.search(text, first + size) if first + size < len(text) else None
        last = end.end() if end else len(text)
        yield text[first:last].encode("utf-8", "replace").translate(_LOWER).decode()
        first = last


def add_words(total: Counter, doc_id: str | None, text: str) -> None:
    """Counts the words of a text, slips made."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for part in slices(text):
        for run, many in Counter(_RUNS.findall(part)).items():
            h = zlib.crc32(run.encode(), seed)
            if h % SLIP == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= SHORTEST:
                total[run] += many


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    give = lambda: pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
            if text.is_valid:
                add_words(total, doc_id.as_py(), text.as_py())
            if len(total) > HELD:
                yield give()
                total.clear()
    yield give()


def count_words(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``(word, n)`` of ``docs(doc_id, text)``."""
    counted = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(_counted, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


_KEY = ["size", "lo", "hi", "spared"]


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds what is spared of the word if the edit lies in ``[lo, hi)`` of a word of ``size``."""
    after = F.col("hi") + F.when(F.col("longer"), 1).otherwise(0)
    spared = F.concat(F.col("word").substr(F.lit(1), F.col("lo")), F.lit("|"), F.col("word").substr(after + 1, F.length("word")))
    return rows.withColumn("spared", spared)


def _cuts(lo: Column, hi: Column) -> Column:
    middle = lo + F.floor((hi - lo) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), middle.alias("hi")), F.struct(middle.alias("lo"), hi.alias("hi")))


def _halved(rows: DataFrame) -> DataFrame:
    """Every row under the two halves of its interval."""
    rows = rows.withColumn("half", F.explode(_cuts(F.col("lo"), F.col("hi"))))
    return _keyed(rows.select("word", "n", "longer", "size", "half.*"))


def keyed_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Index and probe rows ``(word, n, longer, size, lo, hi, spared)`` of ``words(word, n)``."""
    whole = F.length("word")
    roles = F.array(F.struct(whole.alias("size"), F.lit(False).alias("longer")), F.struct((whole - 1).alias("size"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(roles).alias("role")).select("word", "n", "role.longer", "role.size", F.lit(0).alias("lo"), F.col("role.size").alias("hi"))
    rows, done = cut(_halved(rows)), None
    while True:
        many = rows.groupBy(*_KEY).agg(F.count("*").alias("many"), F.count_if(~F.col("longer")).alias("indexed"))
        # a probe that no word is indexed for finds nothing
        many = many.where("indexed > 0 and many > 1").select(*_KEY, ((F.col("many") > crowded) & (F.col("hi") - F.col("lo") > 1)).alias("split"))
        rows = cut(rows.join(many, _KEY))
        rest = rows.where(~F.col("split")).drop("split")
        done = rest if done is None else done.unionByName(rest)
        crowd = rows.where("split").drop("split")
        if crowd.isEmpty():
            return done
        rows = cut(_halved(crowd))


def near_words(words: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Pairs of near words of ``words(word, n)``, each both ways: ``(word, n, near, near_n)``."""
    rows = keyed_words(words, crowded)
    own = rows.where(~F.col("longer")).select(*_KEY, F.col("word").alias("a"), F.col("n").alias("a_n"))
    other = rows.select(*_KEY, "longer", F.col("word").alias("b"), F.col("n").alias("b_n"))
    first = F.when(F.col("longer"), (F.col("hi") == F.col("size")) | (F.col("a").substr(F.lit(1), F.col("hi")) != F.col("b").substr(F.lit(1), F.col("hi")))).otherwise(F.col("a") < F.col("b"))
    pairs = own.join(other, _KEY).where(first & (F.levenshtein("a", "b", 1) == 1))
    way = lambda x, y: F.struct(F.col(x).alias("word"), F.col(f"{x}_n").alias("n"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n"))
    return pairs.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of ``forms(word, form)``: the end of each chain. Counts rise along a chain, so it ends."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = ahead.drop("moved")
        if ahead.where("moved").isEmpty():
            return now


def group_spellings(docs: DataFrame) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``docs(doc_id, text)``; see the module."""
    words = cut(count_words(docs))
    best = F.min(F.struct((-F.col("near_n")).alias("order"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"), F.any_value("n").alias("own_n"))
    enough = -F.col("best.order") >= FORM_TIMES * F.col("own_n")
    near = cut(near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")))
    ends = roots(near.where("form is not null"))
    out = words.join(near, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
