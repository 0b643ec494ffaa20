"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that OCR and PDF text layers write for others.
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("\r\n", ""), ("\u0002", "-"))

CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯]"


def half_width(x: Column, letters_and_digits_only: bool = True) -> Column:
    """[C6] Full-width forms as their ASCII twins; all of them, or letters and digits only."""
    codes = [c for c in range(0xFF01, 0xFF5F) if not letters_and_digits_only or chr(c - 0xFEE0).isalnum()]
    return F.translate(x, "".join(map(chr, codes)), "".join(chr(c - 0xFEE0) for c in codes))


def ends_in_hyphen(x: Column) -> Column:
    """[C7] A word broken at the end of a line."""
    return x.rlike(r"[A-Za-z]+-\s*$")


def plain_characters(x: Column) -> Column:
    """[C8] Ligatures spelled out and control marks replaced."""
    for old, new in LIGATURES:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def cjk_share(x: Column) -> Column:
    """[C13] The share of CJK characters among the characters that aren't white space; null for none."""
    solid = F.length(F.regexp_replace(x, r"(?U)\s+", ""))
    return F.when(solid > 0, F.regexp_count(x, F.lit(CJK)) / solid.cast("double"))


def language_guess(x: Column, threshold: float = 0.3) -> Column:
    """[C13] ``zh`` or ``en`` by the share of CJK characters, where no model is plugged in; empty for no text."""
    return F.when(cjk_share(x) >= threshold, "zh").when(cjk_share(x).isNotNull(), "en").otherwise("")


def digests(x: Column) -> dict[str, Column]:
    """[C15] Upper and lower md5, sha256, and the first 16 and 8 hex digits of the latter."""
    raw = x.cast("binary")
    full = F.sha2(raw, 256)
    return {"md5_upper": F.upper(F.md5(raw)), "md5": F.md5(raw), "sha256": full, "request": F.left(full, F.lit(16)), "response": F.left(full, F.lit(8))}


def item_id(prefix: str, number: Column, width: int = 4) -> Column:
    """[C16] ``R500_0007``; longer numbers stand whole."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.lit(width), F.length(digits)), F.lit("0")))


def cache_name(x: Column) -> Column:
    """[C16] A key that is safe as a file name."""
    return F.regexp_replace(x, r"[^a-zA-Z0-9_]", "_")


def section_anchor(x: Column) -> Column:
    """[C17] ``Pt5.Ch2.Sec10`` as ``pt5-ch2-sec10``."""
    return F.lower(F.replace(x, F.lit("."), F.lit("-")))


def filled(template: str, **values: Column) -> Column:
    """[C18] A template with ``{name}`` fields; the template is the caller's."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def numbered(facts: Column, first: int = 1) -> Column:
    """[C19] One line per fact, numbered."""
    return F.array_join(F.transform(facts, lambda f, i: F.concat((i + first).cast("string"), F.lit(". "), f)), "\n")


def bulleted(facts: Column) -> Column:
    """[C19]"""
    return F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n")


def integrity_notice(signals: Column, status: Column, weight: Column) -> Column:
    """[C20] The first three signals, 100 characters each, with status and weight."""
    shown = F.array_join(F.transform(F.slice(F.coalesce(signals, F.array().cast("array<string>")), 1, 3), lambda s: F.left(s, F.lit(100))), "; ")
    return F.concat(F.coalesce(status, F.lit("unknown")), F.lit(" (weight "), F.format_string("%.2f", F.coalesce(weight, F.lit(1.0))), F.lit("): "), shown)


def safe_file_name(x: Column) -> Column:
    """[C30] Letters, digits and marks that any file system takes; never empty."""
    clean = F.regexp_replace(F.regexp_replace(x, r"(?U)[^\w.\-]+", "_"), r"^[._]+|_+$", "")
    return F.when(clean == "", "unnamed").otherwise(clean)


def table_shape(html: Column) -> tuple[Column, Column]:
    """[C31] ``complex_table`` if cells span or tables nest, and the nesting level."""
    nested = F.regexp_count(html, F.lit(r"(?i)<table")) > 1
    return F.when(html.contains("colspan") | html.contains("rowspan") | nested, "complex_table").otherwise("simple_table"), F.when(nested, 2).otherwise(1)


def without_fences(x: Column) -> Column:
    """[X19] Code fences go."""
    return F.regexp_replace(F.regexp_replace(x, r"^```[A-Za-z0-9_+-]*\n?", ""), r"\n?```\s*$", "")


def without_display_marks(x: Column) -> Column:
    r"""[X19] The ``\[`` and ``\]`` around a formula go."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s*\\\[", ""), r"\\\]\s*$", "")


def escaped_markdown(x: Column) -> Column:
    """[C10] Marks that markdown would read."""
    return F.regexp_replace(x, r"([*`~$])", r"\\$1")


def json_path(x: Column, path: str) -> Column:
    """[C33]"""
    return F.get_json_object(x, path)


def magic_type(content: Column) -> Column:
    """[S14] File type by the first bytes; null if none fits."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    return F.when(head(4) == "25504446", "pdf").when(head(4) == "89504E47", "png").when(head(3) == "FFD8FF", "jpg").when(head(4) == "47494638", "gif").when(head(2) == "424D", "bmp").when(head(4).isin("49492A00", "4D4D002A"), "tiff").when((head(4) == "52494646") & (F.hex(F.substring(content, 9, 4)) == "57454250"), "webp")


def page_range(page: Column, first: Column, last: Column, n_pages: Column) -> Column:
    """[S15] Whether a 0-based page is in the inclusive range; a null or negative end means the last page."""
    end = F.when(last.isNull() | (last < 0) | (last > n_pages - 1), n_pages - 1).otherwise(last)
    return page.between(F.coalesce(first, F.lit(0)), end)


# How files of some kinds of code begin, or what only they hold; the first that fits counts.
CODE = (
    ("html", r"(?i)^\s*(<!doctype html|<html)"), ("xml", r"^\s*<\?xml"), ("json", r"(?s)^\s*[\[{]\s*(\"[^\"\n]*\"\s*[:,\]]|[\]}])"), ("shell", r"^#!.*\b(ba|z)?sh\b"),
    ("python", r"(?m)^#!.*\bpython|^\s*(def \w+\(.*\).*:|class \w+.*:|from [\w.]+ import |import \w+$)"), ("c", r"(?m)^\s*#\s*include\s*[<\"]"), ("java", r"(?m)^\s*(public\s+)?(final\s+)?(class|interface)\s+\w+.*\{"),
    ("sql", r"(?i)^\s*(select\b.*\bfrom|insert\s+into|create\s+(table|view))\b"), ("javascript", r"(?m)^\s*(const|let|var)\s+\w+\s*=|^\s*function\s+\w+\s*\("),
)


def code_language(x: Column) -> Column:
    """[C14] The kind of a piece of code by its marks, where no model is plugged in; ``txt`` if none fits."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(CODE):
        found = F.when(x.rlike(pattern), name).otherwise(found)
    return F.coalesce(found, F.lit("txt"))


def suffix_guess(content: Column, path: Column) -> Column:
    """[C14] A file's suffix by its first bytes, else by its text; what looks like html or has a drawing's name is a pdf if
    it is named one and begins like one."""
    by_bytes = magic_type(content)
    text = code_language(F.decode(F.substring(content, 1, 2_000), "ISO-8859-1"))
    named = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)) == "pdf"
    return F.when(named & (F.hex(F.substring(content, 1, 4)) == "25504446"), "pdf").otherwise(F.coalesce(by_bytes, text))
