"""Personal data in text: exact base patterns, and a character tagger for what is written otherwise.

The base finds emails, IPv4 addresses, payment cards and phone numbers by pattern. The method adds spans: a
character-level bidirectional LSTM with CRF transitions (numpy), trained from labelled spans. Those are written from
templates (plain and disguised forms, and look-alikes that aren't personal data) into stretches of a bounded sample of
the corpus (``CONTEXT_TEXTS`` texts, a piece from a hashed place of each). It also tags secrets (the value of a password,
token or key), which have columns of their own.

It reads overlapping windows of ``WINDOW`` characters around every place that a span must hold one of (a digit, or an ``@``
or the word at, alone or in brackets, that two labels with a dot between them follow), as far as the longest span reaches to both sides, and half a
window more: all text that a valid span can cover. The emissions of overlapping windows are averaged by the distance to
the window's edge, raised where text has the shape of an address, and one Viterbi search over the whole stretch settles
the spans, however many windows it has. Ends are then set to the ends of the words or numbers that they stand in. Spans that overlap a base span, or lack what their kind
needs (digits, parts, a check digit), are not added.

Places are code points, ends exclusive. Defined results: null texts are empty and hold nothing; repeated rows get equal
results; with an empty table there are no rows (the tagger is trained on the templates alone); more columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tagger import Tagger, classes_of

KINDS = ("email", "ip", "card", "phone")
#: What the tagger knows beside them.
SECRET = len(KINDS)
WINDOW, STRIDE = 64, 32
EXAMPLES, EPOCHS, HIDDEN = 6_000, 7, 24
#: Texts of the corpus that training examples are written into, and characters taken of each.
CONTEXT_TEXTS, CONTEXT_CHARS = 200, 2_000

_EMAIL_LEFT = re.compile(r"[A-Za-z0-9._%+-]+$")
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_AT = r"(?<![A-Za-z0-9])at(?![A-Za-z0-9])"
_DOT = r"(?<![A-Za-z0-9])dot(?![A-Za-z0-9])"
#: What every valid span holds one of.
_TRIGGER = re.compile(rf"[0-9]+|@|{_AT}", re.IGNORECASE)
_AN_AT, _A_DOT = re.compile(rf"@|{_AT}", re.IGNORECASE), re.compile(rf"\.|{_DOT}", re.IGNORECASE)
#: Characters of the longest valid address, and of the longest span without one.
LONGEST, LONGEST_NUMBER = 80, 40
TAGS = 1 + 2 * (len(KINDS) + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    if not _ANY.search(text):
        return out
    free, at = 0, text.find("@")
    while at >= 0:
        left = at
        # the longest run to the left that starts at or after the last match's end
        while left > free and not _NOT_LOCAL.match(text, left - 1):
            left -= 1
        right = _EMAIL_RIGHT.match(text, at) if left < at else None
        if right:
            out.append((left, 0, right.end()))
            free = right.end()
        else:
            free = max(free, at)
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


# -- training examples


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(3, 9)))


def _card_number(r: random.Random) -> str:
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(r.choice((13, 14, 14, 14))))
    return next(body + c for c in "0123456789" if luhn(body + c))


# Forms that examples are written in; those of the second tuple are never trained on: tests read them.
_ATS = (("@", "@", " at ", " (at) ", " [at] ", "(at)", "[at]", "_at_", " AT ", " @ ", "-at-"), (" {at} ", "<at>", " (AT) ", "[ at ]"))
_DOTS = ((".", ".", " dot ", "(dot)", " (dot) ", "[dot]", "[.]", " . ", "_dot_", " DOT "), ("{dot}", " <dot> ", "(.)", "{.}"))
_POINTS = ((".", "[.]", " . ", "(.)", "-", " dot ", "(dot)", " [dot] "), ("{.}", "[dot]", "<.>"))
_GAPS = (("", " ", "-", ".", "  ", "/", "_", " / ", "--", " . ", "|", ",", " -", " : ", ";", "- "), (":", " - ", ", "))
_PHONE_GAPS = ((" ", "-", ".", "/", " ", " / ", " -", "  "), ("_", " - "))
_KEYS = (("password", "passwd", "token", "api_key", "secret", "pwd", "key", "PASSWORD", "Token"), ("access_token", "SECRET_KEY", "auth_key"))
_EQUALS = (("=", ": ", " = ", ":", '="', ' = "'), (":= ", " => "))


def _digits(r: random.Random, k: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(k))


def _entity(r: random.Random, unseen: int = 0, kind: int | None = None) -> tuple[int, str, str]:
    """Kind, what stands before the span, and the span."""
    kind = r.randrange(len(KINDS) + 1) if kind is None else kind
    if kind == 0:
        user = _name(r) + r.choice(("", "", "." + _digits(r, 2), "_" + _name(r), _digits(r, 2), "." + _name(r)))
        hosts = [r.choice((_name(r), f"mail{_digits(r, 1)}", _name(r) + "-" + _name(r))) for _ in range(r.choice((1, 1, 2)))] + [r.choice(("com", "org", "net", "de", "fr", "io", "co"))]
        at, dot = r.choice((("@", "."), (r.choice((" at ", "_at_", " AT ")), "."), (r.choice(_ATS[0]), r.choice(_DOTS[0])))) if not unseen else (r.choice(_ATS[1]), r.choice((*_DOTS[1], ".")))
        return 0, "", user + at + dot.join(hosts)
    if kind == 1:
        return 1, "", r.choice(_POINTS[unseen]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == 2:
        card = _card_number(r)
        return 2, "", r.choice(_GAPS[unseen]).join(card[i : i + 4] for i in range(0, len(card), 4))
    if kind == 3:
        gap, area = r.choice(_PHONE_GAPS[unseen]), _digits(r, r.choice((2, 3, 3)))
        country = r.choice(("", "", f"+{_digits(r, r.choice((1, 2)))}{r.choice((' ', gap))}", f"00{_digits(r, 2)} "))
        area = r.choice((area, area, f"({area})" if not unseen else f"(0){area}"))
        rest = gap.join(_digits(r, k) for k in r.choice(((3, 4), (7,), (4, 4), (3, 2, 2), (6,))))
        found = country + area + gap + rest
        return (3, "", found) if 9 <= sum(c.isdigit() for c in found) <= 15 else _entity(r, unseen, 3)
    value = "".join(r.choice(r.choice(("0123456789abcdef", "0123456789ABCDEFGHabcdefghxyz"))) for _ in range(r.choice((12, 16, 18, 24, 32, 40))))
    return SECRET, r.choice(_KEYS[unseen]) + r.choice(_EQUALS[unseen]), value[:5] + r.choice("0123456789") + value[6:]


def _look_alike(r: random.Random) -> str:
    n = lambda k: _digits(r, k)
    hexed = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    w = lambda: _name(r)
    return r.choice((hexed(32), hexed(40), f"20{n(2)}-{n(2)}-{n(2)}", f"{n(1)}.{n(1)}", f"v{n(1)}.{n(2)}.{n(1)}", n(4), n(6), f"{n(2)}:{n(2)}", f"{n(3)},{n(3)}", f"{n(1)}.{n(2)}", n(8), f"Version {n(1)}.0.", f"#{n(5)}", f"@{w()}", n(24), f"{w()} at {w()}. {w().title()}", f"at {w()} {w()}. {w().title()} at {w()}", f"{w()} at {w()}, {w()}.", f"19{n(2)}-19{n(2)}", f"{n(3)}-{n(3)}", f"key {w()} token {w()}", f"password: {w()}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(1)}.{n(1)}.{n(1)}", f"the dot at {w()} {n(2)}. {w().title()}"))


def examples(contexts: list[str], n: int = EXAMPLES, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes, and their tags."""
    r = random.Random(seed)
    contexts = [c for c in contexts if c.strip()] or ["the of and to in a is that for on with as by at from", "la de que el en un por con para los del se las"]
    ids, gold = np.zeros((n, WINDOW), np.int64), np.zeros((n, WINDOW), np.int64)
    for k in range(n):
        text, tags = "", []
        while len(text) < 2 * WINDOW:
            around = r.choice(contexts)
            at = r.randrange(max(1, len(around) - 40))
            bit = around[at : at + r.randint(5, 45)]
            bit = re.sub(r"[0-9@]", "", bit)
            text, tags = text + bit, tags + [0] * len(bit)
            gap = r.choice((" ", " ", " ", ": ", "\n", " (", ", "))
            text, tags = text + gap, tags + [0] * len(gap)
            if r.random() < 0.65:
                kind, before, found = _entity(r)
                tags += [0] * len(before) + [1 + 2 * kind] + [2 + 2 * kind] * (len(found) - 1)
                found = before + found
            else:
                found = _look_alike(r)
                tags += [0] * len(found)
            tail = r.choice((" ", " ", " ", ". ", ", ", "\n", ") "))
            text, tags = text + found + tail, tags + [0] * len(tail)
        at = r.randrange(len(text) - WINDOW)
        ids[k], gold[k] = classes_of(text[at : at + WINDOW]), tags[at : at + WINDOW]
    return ids, gold


def train(contexts: list[str], n: int = EXAMPLES, epochs: int = EPOCHS) -> Tagger:
    tagger = Tagger(TAGS, hidden=HIDDEN)
    tagger.fit(*examples(contexts, n), epochs=epochs)
    return tagger


# -- reading


def _reach(text: str, m: re.Match) -> tuple[int, int]:
    """The range of the valid spans that hold a trigger; empty if there can be none."""
    if "0" <= m.group()[0] <= "9":
        return m.start() - LONGEST_NUMBER, m.end() + LONGEST_NUMBER
    # an address goes on with labels and a dot between them
    return (m.end() - LONGEST, m.start() + LONGEST) if _GOES_ON.match(text, m.end()) else (0, 0)


def stretches(text: str) -> list[tuple[int, int]]:
    """Where a span could be, with room for half a window on both sides, as disjoint ranges."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = _reach(text, m)
        if a >= b:
            continue
        a, b = max(0, a - STRIDE), min(len(text), b + STRIDE)
        while out and a <= out[-1][1]:
            first, last = out.pop()
            a, b = min(a, first), max(b, last)
        out.append([a, b])
    return [(a, b) for a, b in out]


_IN_NUMBER, _IN_NAME, _IN_VALUE = re.compile("[0-9]"), re.compile("[A-Za-z0-9._%+-]"), re.compile("[A-Za-z0-9_/+-]")


# An address as it may be written: the name, the sign, and labels between dots; a dot that can't end a sentence.
_LABEL = "[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
_SIGN = r"(?:\s*[\[({<]\s*(?:at|@)\s*[\])}>]\s*|[\s_-]+at[\s_-]+|\s?@\s?)"
_BETWEEN = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|[\s_-]+dot[\s_-]+|\s\.\s|\.)"
_ADDRESS = re.compile(rf"[A-Za-z0-9._%+-]*[A-Za-z0-9]{_SIGN}{_LABEL}(?:(?:{_BETWEEN}|\.\s){_LABEL})+", re.IGNORECASE)
_MORE = re.compile(rf"{_BETWEEN}{_LABEL}", re.IGNORECASE)
#: What follows the sign of all that is taken for an address.
_GOES_ON = re.compile(rf"\s*[\])}}>]?[\s_-]*{_LABEL}(?:{_BETWEEN}|\.\s){_LABEL}", re.IGNORECASE)
#: What has the shape of an address, without a full stop between sentences, and the nats by which that is likelier one.
_SHAPED, SHAPED = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*[A-Za-z0-9]{_SIGN}{_LABEL}(?:{_BETWEEN}{_LABEL})+", re.IGNORECASE), 2.0


def _address(text: str, start: int, end: int) -> tuple[int, int]:
    """Of a span that holds an address the address itself, and all its labels."""
    found = _ADDRESS.search(text, start, min(end, start + 4 * LONGEST)) or next((m for m in _SHAPED.finditer(text, max(0, start - LONGEST), min(len(text), end + LONGEST)) if m.start() < end and start < m.end()), None)
    if not found:
        return start, start
    start, end = found.span()
    while (more := _MORE.match(text, end)) and more.end() - start <= LONGEST:
        end = more.end()
    return start, end


def _snapped(kind: int, text: str, start: int, end: int) -> tuple[int, int]:
    """The span to the ends of the words or numbers that its ends stand in, at most ``LONGEST`` characters on."""
    inside = _IN_NAME if kind == 0 else _IN_VALUE if kind == SECRET else _IN_NUMBER
    least, most = max(0, start - LONGEST), min(len(text), end + LONGEST)
    while start < end and text[start] in " \n\t.,;:=\"'_-/" + ("()[]{}<>" if kind != 3 else "[]{}<>)"):
        start += 1
    while end > start and text[end - 1] in " \n\t.,;:=\"'_-/()[]{}<>":
        end -= 1
    if start < end:
        while start > least and inside.match(text[start]) and inside.match(text[start - 1]):
            start -= 1
        while end < most and inside.match(text[end - 1]) and inside.match(text[end]):
            end += 1
        while kind in (0, SECRET) and end > start and text[end - 1] in "._%+-/":
            end -= 1
        while kind in (0, SECRET) and start < end and text[start] in "._%+-/":
            start += 1
    if kind == 0:
        return _address(text, start, end)
    if kind == 3 and start > 0 and text[start - 1] == "(" and ")" in text[start:end]:
        start -= 1
    if kind == 3 and start > 0 and text[start - 1] == "+":
        start -= 1
    return start, end


def _valid(kind: int, text: str, start: int, end: int) -> bool:
    found = text[start:end]
    digits = sum(c in "0123456789" for c in found)
    if kind == 0:
        # within the text: the end of a word isn't one of its own
        held = lambda sign: any(m.end() <= end for m in sign.finditer(text, start, min(len(text), end + 1)))
        return len(found) <= LONGEST and held(_AN_AT) and held(_A_DOT) and found[:1].isalnum()
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(found) <= 40
    if kind == 2:
        number = re.sub("[^0-9]", "", found)
        return 14 <= digits <= 19 and luhn(number) and len(found) <= LONGEST_NUMBER
    if kind == SECRET:
        return 8 <= len(found) <= 64 and digits > 0 and not re.search(r"\s", found)
    return 9 <= digits <= 15 and not re.search("[A-Za-z]", found) and len(found) <= 30


class Reader:
    """Windows of many texts are read together."""

    LANES = 2_048

    def __init__(self, tagger: Tagger):
        self.tagger = tagger
        near = np.minimum(np.arange(WINDOW), np.arange(WINDOW)[::-1]) + 1.0
        self.weight = near[:, None].astype(np.float32)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The tagger's spans (start, kind, end) of each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        todo: list[tuple[int, int, int]] = []
        held = 0
        for k, text in enumerate(texts):
            for a, b in stretches(text):
                todo.append((k, a, b))
                held += b - a
                if held > STRIDE * self.LANES:
                    self._read(texts, todo, out)
                    todo, held = [], 0
        if todo:
            self._read(texts, todo, out)
        return out

    def _read(self, texts: list[str], todo: list[tuple[int, int, int]], out: list) -> None:
        windows, places = [], []
        for s, (k, a, b) in enumerate(todo):
            ids = classes_of(texts[k][a:b])
            for at in range(0, max(1, len(ids) - STRIDE), STRIDE):
                part = ids[at : at + WINDOW]
                windows.append(np.pad(part, (0, WINDOW - len(part))))
                places.append((s, at, len(part)))
        sums = [np.zeros((b - a, TAGS), np.float32) for _, a, b in todo]
        weights = [np.zeros((b - a, 1), np.float32) for _, a, b in todo]
        for first in range(0, len(windows), self.LANES):
            e, _ = self.tagger.emissions(np.stack(windows[first : first + self.LANES], axis=1))
            for lane, (s, at, n) in enumerate(places[first : first + self.LANES]):
                sums[s][at : at + n] += e[:n, lane] * self.weight[:n]
                weights[s][at : at + n] += self.weight[:n]
        for (k, a, _), total, weight in zip(todo, sums, weights, strict=True):
            scores = total / weight
            for m in _SHAPED.finditer(texts[k], a, a + len(scores)):
                scores[m.start() - a, 1] += SHAPED
                scores[m.start() - a + 1 : m.end() - a, 2] += SHAPED
            tags = self.tagger.decode(scores)
            t = 0
            while t < len(tags):
                if tags[t] == 0:
                    t += 1
                    continue
                kind, end = (int(tags[t]) - 1) // 2, t + 1
                while end < len(tags) and tags[end] == 2 + 2 * kind:
                    end += 1
                first, last = _snapped(kind, texts[k], a + t, a + end)
                if kind == 3 and _valid(2, texts[k], first, last):
                    kind = 2  # as long as a card's number, with its check digit
                if first < last and _valid(kind, texts[k], first, last) and (not out[k] or out[k][-1][2] <= first):
                    out[k].append((first, kind, last))
                t = end


def _shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _apart(own: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans of the second list, in order, that overlap none of the first."""
    starts, ends = [s[0] for s in own], list(accumulate((s[2] for s in own), max))
    # of the base spans that start before a span ends, the furthest end
    return [s for s in more if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[0]]


_NAMES = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "secrets")


def find_personal_data(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: base counts, the digest of the base spans, all spans, how many spans and secrets there are, and the secrets."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.col("text").cast("string"))
    if tagger is None:
        # the least hashes first, as numbers; then the texts that have them
        start = F.expr(f"cast(1 + pmod(xxhash64(text, 1), greatest(length(text) - {CONTEXT_CHARS}, 0) + 1) as int)")
        hashed = docs.where("length(text) > 40").select(F.xxhash64("text").alias("h"), F.substr("text", start, F.lit(CONTEXT_CHARS)).alias("text"))
        last = hashed.select("h").distinct().orderBy("h").limit(CONTEXT_TEXTS).agg(F.max("h")).first()[0]
        sample = hashed.where(F.col("h") <= last).dropDuplicates(["h"]) if last is not None else hashed.limit(0)
        tagger = train([r["text"] for r in sorted(sample.collect(), key=lambda r: r["h"])])
    shared = spark.sparkContext.broadcast(tagger)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = reader.spans(texts)
            counts, digests, shown, many, hidden = [[] for _ in KINDS], [], [], [], []
            for own, more in zip(base, added, strict=True):
                for kind, column in enumerate(counts):
                    column.append(sum(s[1] == kind for s in own))
                digests.append(hashlib.sha256(_shown(own).encode()).hexdigest())
                new = _apart(own, more)
                shown.append(_shown(sorted(own + [s for s in new if s[1] != SECRET])))
                hidden.append(",".join(f"{start}:{end}" for start, kind, end in new if kind == SECRET))
                many.append(len(own) + len(new))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(shown, pa.string()), pa.array(many, pa.int64()), pa.array(hidden, pa.string())], list(_NAMES))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(find, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, secrets string")
