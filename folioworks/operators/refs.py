"""Cross-references in section text: patterns, positions, resolution, context and leak scans.

Every pattern is one row of a table of ``Pattern``; all matches of a text are found with their places by looking up what
matched, or by splitting the text at a pattern that looks around, so no function outside the engine runs. White space in
patterns is Unicode white space.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Unicode white space, and what makes a match depend on more than its own characters.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_LOOKS_AROUND = re.compile(r"\(\?<?[=!>]|\\[bBAGzZ1-9]|(?<!\[)\^|\$|[+*?}]\+")


@dataclass(frozen=True)
class Pattern:
    number: int
    regex: str
    groups: int
    #: Matches are dropped where the text before them, of this many characters, matches this.
    before_chars: int = 0
    before: str = ""


# The reference grammars of the two corpora.
ABSOLUTE = Pattern(1, r"(?U)Pt\.?\s*(\d+)\s+Ch\.?\s*(\d+)\s+Sec\.?\s*(\d+)\s*\[([^\]]+)\]", 4)
SECTION = Pattern(2, r"(?U)Sec\.?\s*(\d+)\s*\[([^\]]+)\]", 2, 30, r"(?U)Ch\.?\s*\d+\s*$")
CHAPTER = Pattern(3, r"(?U)(?<!Pt\.\s)Ch\.?\s*(\d+)\s+Sec\.?\s*(\d+)\s*(?:\[([^\]]+)\])?", 3, 15, r"(?U)Pt\.?\s*\d+\s*$")
SAME_PART = Pattern(4, r"(?U)§\s*217\.(\d+[a-z]?)((?:\([a-z0-9]+\))*)", 2)
OTHER_PART = Pattern(5, r"(?U)12\s+CFR\s+(?:part\s+)?(\d+)(?:\.(\d+[a-z]?))?", 2)
SUBPART = Pattern(6, r"(?Ui)subpart\s+([A-J])\s+of\s+this\s+part", 1)
APPENDIX = Pattern(7, r"(?Ui)appendix\s+([A-Z])\s+(?:to|of)\s+(?:this\s+)?part", 1)
PARAGRAPH = Pattern(8, r"(?Ui)paragraph\s*((?:\([a-z0-9]+\))+)\s+of\s+this\s+section", 1)

# Classes of giveaways in a question, what they look like (in any letter case), and their names.
LEAKS = (
    (r"§\s*\d", "§ literal"),
    (r"\bSec(tion)?\.?\s*217\b", "Section 217"),
    (r"\bPart\s*217\b", "Part 217"),
    (r"12\s*CFR", "12 CFR"),
    (r"\bSubpart\s+[A-J]\b", "Subpart letter"),
    (r"\bparagraph\s*\(", "paragraph (X)"),
    (r"\(\s*[a-z]\s*\)\s*\(\s*\d", "(a)(1) id"),
    (r"\(\s*\d+\s*\)\s*\(\s*[ivx]+\s*\)", "(1)(i) id"),
    (r"\baccording\s+to\b", "according to"),
    (r"\bunder\s+§", "under §"),
    (r"\bas\s+defined\s+in", "as defined in"),
)


def matches(text: Column, pattern: str, groups: int) -> Column:
    """[X1-X8] All matches, as an array of ``(raw, offset, g1..)`` with 0-based code-point offsets."""
    raws = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = lambda at: F.struct(F.lit(at).alias("at"), F.array().cast("array<int>").alias("offs"))
    offset = lambda at, offs, first: F.struct(at.alias("at"), F.concat(offs, F.array(first)).alias("offs"))
    if _LOOKS_AROUND.search(pattern):
        between = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.transform(raws, F.length)
        # running offsets: one pass that appends to the offsets so far
        steps = F.zip_with(F.slice(between, F.lit(1), F.size(sizes)), sizes, lambda b, s: F.struct(b.alias("b"), F.coalesce(s, F.lit(0)).alias("s")))
        offs = F.aggregate(steps, start(0), lambda acc, x: offset(acc["at"] + x["b"] + x["s"], acc["offs"], acc["at"] + x["b"]))["offs"]
    else:
        # what matched stands nowhere between the match before and its own place: it would have matched there
        found = F.aggregate(raws, start(1), lambda acc, raw: F.transform(F.array(F.position(raw, text, acc["at"])), lambda p: offset(p + F.length(raw), acc["offs"], p - 1))[0])
        offs = found["offs"]
    # groups are read from each match: the text is searched for whole matches only
    return F.zip_with(raws, offs, lambda raw, at: F.struct(raw.alias("raw"), *(F.regexp_extract(raw, pattern, k).alias(f"g{k}") for k in range(1, groups + 1)), at.alias("offset")))


def find_each(sections: DataFrame, patterns: tuple[Pattern, ...], text: str = "text") -> DataFrame:
    """One row per match of any of the patterns that its surroundings allow: one pass over the sections."""
    most = max(p.groups for p in patterns)
    group = lambda p, m, k: (m[f"g{k}"] if k <= p.groups else F.lit("")).alias(f"g{k}")
    shaped = lambda p: F.transform(matches(F.col(text), p.regex, p.groups), lambda m: F.struct(F.lit(p.number).alias("pattern_no"), m["raw"].alias("raw"), m["offset"].alias("char_offset"), *(group(p, m, k) for k in range(1, most + 1))))
    rows = sections.withColumn("m", F.explode(F.concat(*map(shaped, patterns)))).select(*sections.columns, "m.*")
    before = lambda n: F.substr(F.col(text), F.greatest(F.col("char_offset") - n, F.lit(0)) + 1, F.least(F.lit(n), F.col("char_offset")))
    for p in patterns:
        if p.before:
            rows = rows.where((F.col("pattern_no") != p.number) | ~before(p.before_chars).rlike(p.before))
    return rows


def find_all(sections: DataFrame, pattern: Pattern, text: str = "text") -> DataFrame:
    """One row per match that its surroundings allow, beside the section's columns."""
    with_m = sections.withColumn("m", F.explode(matches(F.col(text), pattern.regex, pattern.groups)))
    rows = with_m.select(*sections.columns, F.lit(pattern.number).alias("pattern_no"), F.col("m.raw").alias("raw"), F.col("m.offset").alias("char_offset"), *(F.col(f"m.g{k}").alias(f"g{k}") for k in range(1, pattern.groups + 1)))
    if pattern.before:
        first = F.greatest(F.col("char_offset") - pattern.before_chars, F.lit(0))
        rows = rows.where(~F.substr(F.col(text), first + 1, F.col("char_offset") - first).rlike(pattern.before))
    return rows


def canonical(pt: Column, ch: Column, sec: Column, clause: Column | None = None) -> Column:
    """``Pt5.Ch2.Sec10`` and, with a clause, ``.[clause]``."""
    base = F.concat(F.lit("Pt"), pt.cast("string"), F.lit(".Ch"), ch.cast("string"), F.lit(".Sec"), sec.cast("string"))
    return base if clause is None else F.when(clause != "", F.concat(base, F.lit(".["), clause, F.lit("]"))).otherwise(base)


def identity(folder: Column) -> Column:
    """Part, chapter and section of a folder's name."""
    get = lambda k: F.regexp_extract(folder, r"Pt(\d+)-Chap(\d+)-sec(\d+)", k).cast("int")
    return F.struct(get(1).alias("pt"), get(2).alias("ch"), get(3).alias("sec"))


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(x, F.lit(WHITE))


def context(text: Column, offset: Column, size: Column, chars: int = 200) -> Column:
    """[X9] The text around a match."""
    first = F.greatest(offset - chars, F.lit(0))
    return stripped(F.substr(text, first + 1, offset + size + chars - first))


def clause_window(text: Column, clause: Column, chars: int = 500) -> Column:
    """[X10] Text around the first ``[clause]``, or else the bare clause; null if it stands nowhere."""
    marked, bare = F.position(F.concat(F.lit("["), clause, F.lit("]")), text), F.position(clause, text)
    at = F.when(marked > 0, marked).when(bare > 0, bare)
    first = F.greatest(at - 1 - chars, F.lit(0))
    return F.substr(text, first + 1, at - 1 + F.length(clause) + chars - first)


def crossing(spt: Column, sch: Column, ssec: Column, tpt: Column, tch: Column, tsec: Column) -> tuple[Column, Column, Column]:
    """Whether a reference leaves the part, else the chapter, else the section."""
    part = tpt != spt
    chapter = (tch != sch) & ~part
    return part, chapter, (tsec != ssec) & ~chapter & ~part


def corpus1_edges(sections: DataFrame) -> DataFrame:
    """[X1][X2][X3] Edges of ``sections(section_id, pt, ch, sec, text)`` in all three forms, duplicates included."""
    found = find_each(sections.select("section_id", "pt", "ch", "sec", "text"), (ABSOLUTE, SECTION, CHAPTER))
    by = lambda absolute, section, chapter: F.when(F.col("pattern_no") == 1, absolute).when(F.col("pattern_no") == 2, section).otherwise(chapter)
    number = lambda c: F.col(c).cast("int")
    rows = found.withColumns({
        "tpt": by(number("g1"), F.col("pt"), F.col("pt")), "tch": by(number("g2"), F.col("ch"), number("g1")), "tsec": by(number("g3"), number("g1"), number("g2")), "clause": by(F.col("g4"), F.col("g2"), F.col("g3")),
    })
    rows = rows.where(by(F.lit(True), F.col("tsec") != F.col("sec"), F.col("tch") != F.col("ch")))
    part, chapter, section = crossing(*(F.col(c) for c in ("pt", "ch", "sec", "tpt", "tch", "tsec")))
    target = [F.col("tpt"), F.col("tch"), F.col("tsec")]
    return rows.select(
        F.col("section_id").alias("source"), canonical(*target).alias("target_section"), canonical(*target, F.col("clause")).alias("target_clause"), "clause", "raw", "pattern_no",
        by(part, F.lit(False), F.lit(False)).alias("crosses_part"), by(chapter, F.lit(False), F.lit(True)).alias("crosses_chapter"), by(section, F.lit(True), F.lit(False)).alias("crosses_section"),
        context(F.col("text"), F.col("char_offset"), F.length("raw")).alias("context"), "char_offset",
    )


def corpus2_edges(sections: DataFrame, part: int = 217) -> DataFrame:
    """[X4-X8][F3][J1] Edges of ``sections(section_id, subpart, sec, appendix, text)`` of a part, with kind and tier hint.

    Same-part targets that do not exist are dropped; a subpart stands for its first section id, and is looked up as it
    is written (a small letter finds none); other parts' targets are kept as they are.
    """
    own = sections.select("section_id", "subpart", "sec", "text")
    kinds = lambda *each: F.coalesce(*(F.when(F.col("pattern_no") == p.number, v) for p, v in zip((SAME_PART, OTHER_PART, SUBPART, APPENDIX, PARAGRAPH), each, strict=True)))
    # texts stay behind before anything is looked up
    found = lambda *patterns: find_each(own, patterns).withColumn("context", context(F.col("text"), F.col("char_offset"), F.length("raw"))).drop("text")
    # sections that are named move to the index of sections; subparts, appendices and names of other things stay where they are
    index = sections.where("sec is not null").select(F.col("sec").alias("g1"), F.col("section_id").alias("t_id"), F.col("subpart").alias("t_subpart"))
    near = found(SAME_PART).join(index, "g1")
    firsts = sections.where("subpart is not null and sec is not null").groupBy("subpart").agg(F.min("section_id").alias("t_id"))
    names = firsts.select(F.lit(SUBPART.number).alias("pattern_no"), F.col("subpart").alias("g1"), "t_id", F.col("subpart").alias("t_subpart"))
    names = names.union(sections.where("appendix is not null").select(F.lit(APPENDIX.number), "appendix", "section_id", F.lit(None).cast("string")))
    rows = near.unionByName(found(OTHER_PART, SUBPART, APPENDIX, PARAGRAPH).join(F.broadcast(names), ["pattern_no", "g1"], "left"))
    elsewhere = F.concat(F.lit("Pt"), "g1", F.when(F.col("g2") != "", F.concat(F.lit(".Sec"), "g1", F.lit("."), "g2")).otherwise(""))
    rows = rows.withColumn("target", kinds(F.col("t_id"), elsewhere, F.col("t_id"), F.col("t_id"), F.col("section_id")))
    rows = rows.where(F.col("target").isNotNull() & kinds(F.lit(True), F.col("g1") != str(part), ~F.col("g1").eqNullSafe(F.col("subpart")), F.lit(True), F.lit(True)))
    same = F.when(F.col("g1") == F.col("sec"), 1).when(F.col("t_subpart").eqNullSafe(F.col("subpart")), 2).otherwise(3)
    kind = F.when(same == 1, "same_section").when(same == 2, "same_subpart").otherwise("cross_subpart")
    return rows.select(
        F.col("section_id").alias("source"), "target", kinds(kind, F.lit("cross_part"), F.lit("subpart_rep"), F.lit("appendix_ref"), F.lit("same_section_paragraph")).alias("kind"),
        kinds(same, F.lit(4), F.lit(3), F.lit(3), F.lit(1)).alias("tier_hint"), "raw", kinds(F.col("g2"), F.lit(""), F.lit(""), F.lit(""), F.col("g1")).alias("paragraphs"),
        "context", "char_offset", "pattern_no",
    )


def first_edges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """[G3][G4] The first of equal edges, by pattern and then place."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy("pattern_no", "char_offset")
    return edges.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def loose_references(text: Column, pt: Column, ch: Column, own: Column) -> Column:
    """[X11] Sorted ids that a text names: in full, by chapter (parts masked, so that a full one names this part's chapter
    too), or locally, unless a chapter stands right before; its own id left out."""
    full = F.transform(matches(text, r"(?U)Pt\.?\s*(\d+)\s+Ch\.?\s*(\d+)\s+Sec\.?\s*(\d+)", 3), lambda m: canonical(m["g1"], m["g2"], m["g3"]))
    masked = F.regexp_replace(text, r"(?U)Pt\.?\s*\d+\s+", "__MASKED__ ")
    chapter = F.transform(matches(masked, r"(?U)(?<!Pt\.\s)Ch\.?\s*(\d+)\s+Sec\.?\s*(\d+)", 2), lambda m: canonical(pt, m["g1"], m["g2"]))
    before = lambda m: F.substr(text, F.greatest(m["offset"] - 15, F.lit(0)) + 1, F.least(m["offset"], F.lit(15)))
    alone = F.filter(matches(text, r"(?U)Sec\.?\s*(\d+)\s*\[", 1), lambda m: ~before(m).rlike(r"(?U)Ch\.?\s*\d+\s*$"))
    local = F.transform(alone, lambda m: canonical(pt, ch, m["g1"]))
    return F.array_sort(F.array_except(F.array_distinct(F.concat(full, chapter, local)), F.array(own)))


def leak_scan(text: Column, patterns: tuple[tuple[str, str], ...] = LEAKS) -> Column:
    """[X12] The first match of each class of giveaways, in the classes' order and as written."""
    return F.filter(F.array(*(F.regexp_extract(text, f"(?Ui){p}", 0) for p, _ in patterns)), lambda x: x != "")


def marker_scan(log: Column, markers: list[str], preamble_end: Column) -> Column:
    """[X13] Whether a log holds a marker; a first hit inside an echoed preamble doesn't count."""
    low = F.lower(log)
    hits = F.transform(F.array(*(F.lit(m.lower()) for m in markers)), lambda m: F.position(m, low) - 1)
    return F.exists(hits, lambda at: (at >= 0) & ~((preamble_end > 0) & (at < preamble_end)))
