"""Operators whose result depends on the order of their steps, as Arrow-batched functions per page, document or table.

Groups are pages, documents or tables: some hundred rows each, never a key that grows with the corpus. The engine gathers
each group into one row, so that a batch holds thousands of them.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

BOX = ["x0", "y0", "x1", "y1"]


def _box(row: dict) -> list[float]:
    return [float(row[c]) for c in BOX]


def _area(b) -> float:
    w, h = b[2] - b[0], b[3] - b[1]
    return w * h if w > 0 and h > 0 else 0.0


def _shared(a, b) -> float:
    # most boxes lie apart, which one side tells
    w = (b[2] if b[2] < a[2] else a[2]) - (b[0] if b[0] > a[0] else a[0])
    if not w > 0:
        return 0.0
    h = (b[3] if b[3] < a[3] else a[3]) - (b[1] if b[1] > a[1] else a[1])
    return w * h if h > 0 else 0.0


def _iou(a, b) -> float:
    shared = _shared(a, b)
    if shared == 0:
        return 0.0
    union = _area(a) + _area(b) - shared
    return shared / union if union > 0 else 0.0


def _union(a, b) -> list[float]:
    return [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]


def _values(column: pa.Array) -> list:
    """A column as Python values; plain ones are converted at once."""
    kind = column.type
    plain = pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_boolean(kind)
    if pa.types.is_string(kind) or (plain and not column.null_count):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _per_group(rows: DataFrame, on: list[str], run: Callable[[list[dict]], list[dict]], schema: str | None = None) -> DataFrame:
    """``run`` over the rows of each group, as dictionaries in no set order."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = rows.schema if schema is None else _parse_datatype_string(schema)
    shape, names = to_arrow_schema(StructType(kind.fields)), rows.columns
    gathered = rows.groupBy(*on).agg(F.collect_list(F.struct(*rows.columns)).alias("members")).select("members")

    def each(batches):
        for batch in batches:
            members = batch.column("members")
            flat = members.flatten()
            held = [dict(zip(names, values, strict=True)) for values in zip(*map(_values, flat.flatten()), strict=True)]
            ends = (members.offsets.to_numpy() - members.offsets[0].as_py()).tolist()
            out = [r for first, last in zip(ends, ends[1:], strict=False) for r in run(held[first:last])]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in out], f.type) for f in shape], schema=shape)

    return gathered.mapInArrow(each, kind)


def _typed(rows: DataFrame, names: list[str], more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names), more])


def _placed(rows: list[dict]) -> list[dict]:
    return sorted(rows, key=lambda r: r["pos"])


def _survivors(rows: list[dict], loser: Callable[[int, int, list], int | None]) -> list[dict]:
    """Rows in order of place, less the losers of pairs that both are still there."""
    rows = _placed(rows)
    boxes, gone = [_box(r) for r in rows], set()
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if i in gone:
                break
            if j not in gone:
                k = loser(i, j, boxes)
                if k is not None:
                    gone.add(k)
    return [r | dict(zip(BOX, b, strict=True)) for k, (r, b) in enumerate(zip(rows, boxes, strict=True)) if k not in gone]


def drop_overlapping(spans: DataFrame, on: list[str], threshold: float = 0.9) -> DataFrame:
    """[W5] Of two spans above the IoU the lower score goes (the second of equals); what has gone drops nothing more."""

    def run(rows: list[dict]) -> list[dict]:
        score = [r["score"] for r in _placed(rows)]
        return _survivors(rows, lambda i, j, b: (i if score[i] < score[j] else j) if _iou(b[i], b[j]) > threshold else None)

    return _per_group(spans, on, run)


def drop_smaller(spans: DataFrame, on: list[str], threshold: float = 0.65) -> DataFrame:
    """[W6] Of two spans that share more than the threshold of the smaller one, that one goes (the first of equals)."""

    def loser(i: int, j: int, b: list) -> int | None:
        shared = _shared(b[i], b[j])
        if shared == 0:
            return None
        one, other = _area(b[i]), _area(b[j])
        small, area = (i, one) if one <= other else (j, other)
        return small if area > 0 and shared / area > threshold else None

    return _per_group(spans, on, lambda rows: _survivors(rows, loser))


def absorb_smaller(blocks: DataFrame, on: list[str], threshold: float = 0.8) -> DataFrame:
    """[W7] Of two blocks that share more than the threshold of the smaller one, that one (the first of equals) goes, and
    the other grows around it before the next test; what has gone is still tested as it was, and grows."""

    def run(rows: list[dict]) -> list[dict]:
        rows = _placed(rows)
        b, gone = [_box(r) for r in rows], set()
        for i in range(len(rows)):
            for j in range(i + 1, len(rows)):
                shared = _shared(b[i], b[j])
                if shared == 0:
                    continue
                small, large = (i, j) if _area(b[i]) <= _area(b[j]) else (j, i)
                if small not in gone and _area(b[small]) > 0 and shared / _area(b[small]) > threshold:
                    b[large] = _union(b[i], b[j])
                    gone.add(small)
        return [r | dict(zip(BOX, box, strict=True)) for k, (r, box) in enumerate(zip(rows, b, strict=True)) if k not in gone]

    return _per_group(blocks, on, run)


def union_to_fixpoint(tables: DataFrame, on: list[str], threshold: float = 0.7) -> DataFrame:
    """[W8] While there are two tables above the IoU, the first such pair becomes their common box, with the first one's
    other columns, and goes to the end of the list."""

    def run(rows: list[dict]) -> list[dict]:
        rows = _placed(rows)
        while True:
            pair = next(((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if _iou(_box(rows[i]), _box(rows[j])) > threshold), None)
            if pair is None:
                return rows
            second, first = rows.pop(pair[1]), rows.pop(pair[0])
            rows.append(first | dict(zip(BOX, _union(_box(first), _box(second)), strict=True)))

    return _per_group(tables, on, run)


def drop_nesting(tables: DataFrame, on: list[str], overlap: float = 0.8, area: float = 0.8) -> DataFrame:
    """[W8] A table goes if three others or more lie in it (by ``overlap``), apart from each other, and fill ``area`` of it."""

    def run(rows: list[dict]) -> list[dict]:
        b, kept = [_box(r) for r in rows], []
        for i, r in enumerate(rows):
            inner = [j for j in range(len(rows)) if j != i and 0 < _shared(b[i], b[j]) >= overlap * _area(b[j])]
            apart = all(_shared(b[j], b[k]) <= 0 for n, j in enumerate(inner) for k in inner[n + 1 :])
            if not (len(inner) >= 3 and apart and sum(_area(b[j]) for j in inner) > area * _area(b[i])):
                kept.append(r)
        return kept

    return _per_group(tables, on, run)


def container_or_children(boxes: DataFrame, on: list[str], threshold: float = 0.8, least: int = 2) -> DataFrame:
    """[W9] A box that holds two others or more (by the threshold, those that have gone left out) stays and grows around them
    if its score beats their mean, and they go; else it goes. What lies in what is asked of the boxes as they came."""

    def run(rows: list[dict]) -> list[dict]:
        rows = _placed(rows)
        b, gone = [_box(r) for r in rows], set()
        grown = [list(x) for x in b]
        for i in range(len(rows)):
            inner = [j for j in range(len(rows)) if j != i and j not in gone and 0 < _shared(b[i], b[j]) >= threshold * _area(b[j])]
            if i in gone or len(inner) < least:
                continue
            if rows[i]["score"] > sum(rows[j]["score"] for j in inner) / len(inner):
                gone.update(inner)
                for j in inner:
                    grown[i] = _union(grown[i], b[j])
            else:
                gone.add(i)
        return [r | dict(zip(BOX, box, strict=True)) for k, (r, box) in enumerate(zip(rows, grown, strict=True)) if k not in gone]

    return _per_group(boxes, on, run)


def caption_by_distance(rows: DataFrame, on: list[str], factor: float = 3.0) -> DataFrame:
    """[J16] Captions to bodies, from the upper left: of what is open, the box nearest to the common corner meets the nearest
    of the other kind. They are a pair unless some body (taken or not) is ``factor`` times nearer to the caption: then the
    body is passed over. Captions left when no pair can be made go to their nearest body.

    ``rows(on, pos, role, box)`` with roles ``caption`` and ``body``; returns ``(on, caption, body)``.
    """

    def apart(a: list, b: list) -> float:
        dx, dy = max(0.0, b[0] - a[2], a[0] - b[2]), max(0.0, b[1] - a[3], a[1] - b[3])
        return (dx * dx + dy * dy) ** 0.5

    def run(members: list[dict]) -> list[dict]:
        # in order of the distance from the origin, bodies first
        boxes = sorted(((r["role"] != "body", _box(r), r["pos"]) for r in _placed(members)), key=lambda x: (x[0], x[1][0] ** 2 + x[1][1] ** 2))
        bodies = [k for k, x in enumerate(boxes) if not x[0]]
        nearest = {k: min((apart(boxes[k][1], boxes[j][1]) for j in bodies), default=0.0) for k, x in enumerate(boxes) if x[0]}
        still, matched, pairs = list(range(len(boxes))), set(), {}
        while len(matched) < len(bodies) and still:
            left, top = min(boxes[k][1][0] for k in still), min(boxes[k][1][1] for k in still)
            by_corner = sorted(still, key=lambda k: (boxes[k][1][0] - left) ** 2 + (boxes[k][1][1] - top) ** 2)
            first = by_corner[0]
            by_first = sorted(by_corner, key=lambda k: apart(boxes[first][1], boxes[k][1]))
            other = next((k for k in by_first[1:] if boxes[k][0] != boxes[first][0]), None)
            if other is None:
                break
            body, caption = (other, first) if boxes[first][0] else (first, other)
            still.remove(body)
            if apart(boxes[body][1], boxes[caption][1]) < factor * nearest[caption] or nearest[caption] == float("inf"):
                still.remove(caption)
                matched.add(body)
                pairs[caption] = body
        for k in nearest:
            if k not in pairs and bodies:
                pairs[k] = min(bodies, key=lambda j: (apart(boxes[k][1], boxes[j][1]), j))
        key = {c: members[0][c] for c in on}
        return [key | {"caption": boxes[i][2], "body": boxes[j][2]} for i, j in sorted(pairs.items())]

    return _per_group(rows, on, run, _typed(rows, on, "caption int, body int"))


def greedy_one_to_one(scores: DataFrame, doc: str, least: float = 0.6, least_noisy: float = 0.45) -> DataFrame:
    """[J18] Tables in order, each to the best block that none before it took (the first of equals), if the score is enough:
    less is asked of a ``noisy`` block, where the scores have that column. A score of 0 is none."""

    def run(rows: list[dict]) -> list[dict]:
        taken, keep = set(), []
        for t in sorted({r["table_ix"] for r in rows}):
            free = [r for r in rows if r["table_ix"] == t and r["block_ix"] not in taken and r["score"] > 0]
            best = min(free, key=lambda r: (-r["score"], r["block_ix"]), default=None)
            if best and best["score"] >= (least_noisy if best.get("noisy") else least):
                taken.add(best["block_ix"])
                keep.append(best)
        return keep

    return _per_group(scores, [doc], run)


def keep_first_distinct(tables: DataFrame, doc: str, threshold: float = 0.92) -> DataFrame:
    """[C5] A table goes if it is too like one that was kept before it (overlap coefficient of its ``tokens``)."""

    def run(rows: list[dict]) -> list[dict]:
        kept: list[tuple[dict, set]] = []
        for r in _placed(rows):
            tokens = set(r["tokens"])
            if not any(tokens and t and len(tokens & t) / min(len(tokens), len(t)) >= threshold for _, t in kept):
                kept.append((r, tokens))
        return [r for r, _ in kept]

    return _per_group(tables, [doc], run)


def xy_cut(boxes: DataFrame, on: list[str]) -> DataFrame:
    """[W19] Reading order by recursive cuts: horizontal bands, in each of them columns, and those cut again.

    A cut needs a gap: boxes that touch stand in one band. A band that is one column is read by left edges (ties by top
    and place).
    """

    def bands(rows: list, low: str, high: str) -> list[list]:
        out, reach = [], None
        for r in sorted(rows, key=lambda r: (r[low], r[high])):
            if reach is None or r[low] > reach:
                out.append([])
                reach = r[high]
            out[-1].append(r)
            reach = max(reach, r[high])
        return out

    def cut(rows: list) -> list:
        out = []
        for band in bands(rows, "y0", "y1"):
            columns = bands(band, "x0", "x1")
            out += sorted(band, key=lambda r: (r["x0"], r["y0"], r["pos"])) if len(columns) == 1 else [r for part in columns for r in cut(part)]
        return out

    def run(rows: list[dict]) -> list[dict]:
        return [{c: r[c] for c in on} | {"pos": r["pos"], "read_index": k} for k, r in enumerate(cut(rows))]

    return _per_group(boxes, on, run, _typed(boxes, on, "pos int, read_index int"))


def text_box_order(boxes: DataFrame, on: list[str], row: float = 10.0) -> DataFrame:
    """[W21] By top and left, then neighbours on about one line are exchanged into order from the left."""

    def run(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: (r["y0"], r["x0"], r["pos"]))
        for i in range(len(rows) - 1):
            for j in range(i, -1, -1):
                if abs(rows[j + 1]["y0"] - rows[j]["y0"]) >= row or rows[j + 1]["x0"] >= rows[j]["x0"]:
                    break
                rows[j], rows[j + 1] = rows[j + 1], rows[j]
        return [r | {"read_index": k} for k, r in enumerate(rows)]

    return _per_group(boxes, on, run, _typed(boxes, boxes.columns, "read_index int"))


def gathered_rows(cells: DataFrame, on: list[str], char: float = 10.0, threshold: float = 0.2) -> DataFrame:
    """[W22] Cells in order of place gather those after them that stand in one row (either's height lies in the other's but for
    the threshold): texts are joined with a blank for each whole ``char`` of the gap, and boxes grow.

    ``cells(on, pos, box, content)``; returns a row for each gathered one, under the place of its first cell.
    """

    def beside(a: list, b: list) -> bool:
        shared = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
        return any(h > 0 and (h - shared) / h < threshold for h in (a[3] - a[1], b[3] - b[1]))

    def run(rows: list[dict]) -> list[dict]:
        rows = [[r, _box(r), r["content"]] for r in _placed(rows)]
        out = []
        while rows:
            (first, box, text), rest = rows[0], []
            for other in rows[1:]:
                if beside(box, other[1]):
                    text += " " * int(max(other[1][0] - box[2], 0) / char) + other[2]
                    box = _union(box, other[1])
                else:
                    rest.append(other)
            out.append({c: first[c] for c in on} | {"pos": first["pos"], "text": text})
            rows = rest
        return out

    return _per_group(cells, on, run, _typed(cells, on, "pos int, text string"))


_ROW, _CELL = re.compile(r"(?is)<tr\b[^>]*>(.*?)</tr>"), re.compile(r"(?is)<t([dh])\b([^>]*)>(.*?)</t[dh]>")


def _span(attributes: str, name: str) -> int:
    m = re.search(rf'{name}\s*=\s*["\']?(\d+)', attributes, re.IGNORECASE)
    return max(1, int(m.group(1))) if m else 1


@lru_cache(maxsize=4096)
def occupancy(html: str) -> list[tuple[int, int, int, int, str, bool]]:
    """[W24] Cells (first row, last row, first column, last column, text, header) with spans laid out; not to be changed in place."""
    taken, out = set(), []
    for r, row in enumerate(_ROW.findall(html or "")):
        c = 0
        for kind, attributes, body in _CELL.findall(row):
            while (r, c) in taken:
                c += 1
            rows, cols = _span(attributes, "rowspan"), _span(attributes, "colspan")
            taken.update((r + i, c + j) for i in range(rows) for j in range(cols))
            out.append((r, r + rows - 1, c, c + cols - 1, re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", body)).strip(), kind.lower() == "h"))
            c += cols
    return out


def grid_cells(tables: DataFrame, key: str, html: str = "html") -> DataFrame:
    """[W24] One row per cell of each table, in logical coordinates; tables of a batch that are alike are read once."""
    cells = {"r0": pa.int32(), "r1": pa.int32(), "c0": pa.int32(), "c1": pa.int32(), "text": pa.string(), "header": pa.bool_()}

    def run(batches):
        for batch in batches:
            codes = batch.column(html).dictionary_encode("encode")
            own = [occupancy(h) for h in codes.dictionary.to_pylist()]
            columns = list(zip(*(c for each in own for c in each), strict=True)) or [()] * len(cells)
            held = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, cells.values(), strict=True)], list(cells))
            which, many = codes.indices.to_numpy(), np.array([len(each) for each in own], dtype=np.int64)
            n, first = many[which], (np.cumsum(many) - many)[which]
            # the places of each table's cells, one table after the other
            at = np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)
            keys = batch.column(key).take(pa.array(np.repeat(np.arange(len(n)), n)))
            yield pa.RecordBatch.from_arrays([keys, *held.take(pa.array(at)).columns], [key, *cells])

    kind = dict(tables.dtypes)[key]
    return tables.select(key, html).mapInArrow(run, f"{key} {kind}, r0 int, r1 int, c0 int, c1 int, text string, header boolean")


# The tokens of the table notation. A cell with text or without, the same cell to the left, above, or both, and a new row.
_OTSL = re.compile(r"<(fcel|ecel|lcel|ucel|xcel|ched|rhed|srow|nl)>([^<]*)")


def otsl_cells(text: str) -> list[tuple[int, int, int, int, str, bool]]:
    """[X18] The cells of a grid in table notation."""
    grid: list[list[tuple[str, str]]] = [[]]
    for token, body in _OTSL.findall(text or ""):
        if token == "nl":
            grid.append([])
        else:
            grid[-1].append((token, body.strip()))
    grid = [r for r in grid if r]
    at = lambda r, c: grid[r][c][0] if r < len(grid) and c < len(grid[r]) else None
    out = []
    for r, row in enumerate(grid):
        for c, (token, body) in enumerate(row):
            if token in ("lcel", "ucel", "xcel"):
                continue
            c1, r1 = c, r
            while at(r, c1 + 1) == "lcel":
                c1 += 1
            while at(r1 + 1, c) == "ucel":
                r1 += 1
            out.append((r, r1, c, c1, body, token in ("ched", "rhed", "srow")))
    return out


def cells_html(cells: list[tuple[int, int, int, int, str, bool]]) -> str:
    """[X18] Cells as HTML, spans as attributes."""
    rows: dict[int, list[str]] = {}
    for r0, r1, c0, c1, text, header in sorted(cells, key=lambda x: (x[0], x[2])):
        tag = "th" if header else "td"
        spans = (f' rowspan="{r1 - r0 + 1}"' if r1 > r0 else "") + (f' colspan="{c1 - c0 + 1}"' if c1 > c0 else "")
        rows.setdefault(r0, []).append(f"<{tag}{spans}>{text}</{tag}>")
    return "<table>" + "".join(f"<tr>{''.join(rows[r])}</tr>" for r in sorted(rows)) + "</table>"


@lru_cache(maxsize=4096)
def _written(cells: tuple) -> str:
    return cells_html(list(cells))


def otsl_to_html(tables: DataFrame, key: str, otsl: str = "otsl") -> DataFrame:
    """[X18]"""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "html": [cells_html(otsl_cells(t)) for t in pdf[otsl]]})

    return tables.select(key, otsl).mapInPandas(run, f"{key} {dict(tables.dtypes)[key]}, html string")


# Fixed value: full-width forms and their ASCII twins.
_HALF = {k: k - 0xFEE0 for k in range(0xFF01, 0xFF5F)}
_MORE = re.compile(r"(?i)\((cont(\.|inued)?|续)\)|\bcontinued\b|续表")


def _widths(cells) -> tuple[int, ...]:
    return tuple(c1 - c0 + 1 for _, _, c0, c1, *_ in cells)


def _columns(cells) -> int:
    return max(c[3] for c in cells) + 1


def _header_rows(a: list, b: list, most: int = 5) -> int:
    """Leading rows that both tables have alike, in structure and text without white space."""
    n = 0
    while n < most:
        x, y = ([c for c in t if c[0] == n] for t in (a, b))
        text = lambda cells: ["".join(c[4].split()).translate(_HALF) for c in cells]
        if not x or not y or _widths(x) != _widths(y) or text(x) != text(y):
            return n
        n += 1
    return n


def merge_page_tables(tables: DataFrame, doc: str) -> DataFrame:
    """[C28] Tables that go on over a page break, from the last page backwards.

    ``tables(doc, page, is_first, is_last, html, caption, n_footnotes, x0, x1)``: the first table of a page goes on with
    the last one of the page before if its caption says so or it has none, the other has no footnotes (one at most when
    the caption says so), their widths differ by less than a tenth of the narrower, and they have as many columns or
    meet in rows alike. Common header rows are left out; the merged-in table's html becomes empty.
    """

    def goes_on(now: dict, before: dict, a: list, b: list) -> bool:
        caption = now["caption"] or ""
        says = bool(_MORE.search(caption))
        wide, other = now["x1"] - now["x0"], before["x1"] - before["x0"]
        if (caption and not says) or before["n_footnotes"] > (1 if says else 0) or min(wide, other) <= 0 or abs(wide - other) / min(wide, other) >= 0.1:
            return False
        last = [c for c in a if c[1] == max(x[1] for x in a)]
        first = [c for c in b if c[0] == _header_rows(a, b)] or [c for c in b if c[0] == 0]
        return _columns(a) == _columns(b) or len(last) == len(first) or sum(_widths(last)) == sum(_widths(first))

    def run(rows: list[dict]) -> list[dict]:
        rows = sorted(rows, key=lambda r: (r["page"], not r["is_first"], r["is_last"], r["x0"]))
        cells = [occupancy(r["html"]) for r in rows]
        for k in reversed(range(len(rows))):
            before = [j for j in range(k) if rows[j]["page"] == rows[k]["page"] - 1 and rows[j]["is_last"]]
            if not rows[k]["is_first"] or not before or not cells[k] or not cells[before[-1]]:
                continue
            j = before[-1]
            a, b = cells[j], cells[k]
            if not goes_on(rows[k], rows[j], a, b):
                continue
            head, missing = _header_rows(a, b), _columns(a) - _columns(b)
            down = max(c[1] for c in a) + 1 - head
            widen = lambda c1, last=_columns(b) - 1, by=max(0, missing): c1 + by if c1 == last else c1
            cells[j] = a + [(r0 + down, r1 + down, c0, widen(c1), *rest) for r0, r1, c0, c1, *rest in b if r0 >= head]
            cells[k] = []
            rows[j]["n_footnotes"] += rows[k]["n_footnotes"]
            rows[k]["n_footnotes"] = 0
        return [r | {"html": _written(tuple(c)) if c else ""} for r, c in zip(rows, cells, strict=True)]

    return _per_group(tables, [doc], run)


# How a condition's line starts, and the two lines that belong together.
CONDITION = "for hatchway corners"
_FIGURE = re.compile(r"(?m)^(for hatchway corners.*HC3\s*)\n(in Figure \d+)\s*$")


def _is_condition(line: str) -> bool:
    return re.sub(r"\s+", " ", line).strip().lower().startswith(CONDITION)


def _array_rows(body: str) -> list[str]:
    """The rows of a LaTeX array, without the marks of their first cell and an outer brace."""
    body = re.sub(r"\\begin\{array\}\s*\{[^}]*\}|\\end\{array\}", "", body)
    rows = (re.sub(r"\s*\}\s*$", "", re.sub(r"^\{\s*", "", re.sub(r"^\s*&\s*", "", row.strip()))).strip() for row in body.split("\\\\"))
    return [r for r in rows if r]


def split_conditions(text: str) -> str:
    r"""[X17] An array between ``$$`` lines whose rows are as many as the condition line before it and those after it becomes
    a formula for each, under its condition; any other stays. Three line breaks and more become two."""
    lines, out, at = (text or "").splitlines(), [], 0
    while at < len(lines):
        close = next((k for k in range(at + 1, len(lines)) if lines[k].strip() == "$$"), None) if lines[at].strip() == "$$" else None
        if close is None:
            out.append(lines[at])
            at += 1
            continue
        body = "\n".join(lines[at + 1 : close]).strip()
        rows = _array_rows(body) if "\\begin{array}" in body else []
        before = next((k for k in range(len(out) - 1, -1, -1) if out[k].strip()), None)
        after, conditions = close + 1, []
        while after < len(lines) and (not lines[after].strip() or _is_condition(lines[after])):
            conditions += [lines[after]] if lines[after].strip() else []
            after += 1
        if rows and before is not None and _is_condition(out[before]) and len(rows) == 1 + len(conditions):
            conditions.insert(0, out.pop(before))
            for condition, row in zip(conditions, rows, strict=True):
                out += [condition, "", "$$", row, "$$", ""]
            at = after
        else:
            out += lines[at : close + 1]
            at = close + 1
    return re.sub(r"\n{3,}", "\n\n", _FIGURE.sub(r"\1 \2", "\n".join(out))).strip() + "\n"


def conditions_split(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """[X17]"""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({doc: pdf[doc], "text": [split_conditions(t) for t in pdf[text]]})

    return docs.select(doc, text).mapInPandas(run, f"{doc} {dict(docs.dtypes)[doc]}, text string")
