"""Embedding near-dedup by int8 tile products with rigorous error bounds.

Vectors link when their labels are equal and their cosine, in double precision, is at least ``THRESHOLD``. Vectors that
are null, zero, or hold a null or non-finite component, and those without a label, link with nothing; nor do vectors of
different length.

Every vector is normalised in double precision and quantised to int8 with a scale of its own, ``x = s q + e``. For two
vectors ``x.y = s t (q.r) + s q.f + e.y``, so ``|x.y - s t (q.r)| <= (|x| + |e|) |f| + |e| |y|``: the norms of the
two error vectors, kept per vector, bound the error of the integer product whatever the data. What travels between tiles
are the int8 values, scales and norms. Tiles are multiplied in strips of ``STRIP`` dimensions in float32 lanes, in which
products of int8 are exact up to that length, and the strips are summed in double precision. Pairs whose upper bound is
below the threshold are done; those whose lower bound is above it link. Only the others, near the threshold, fetch their
raw vectors and are computed again in double precision.

1. Equal vectors of a label become one class with a count, so copies are never paired.
2. Within a label a class belongs to a tile of about ``TILE`` classes, by the vector's nearest pivot and a hash, each
   with its mean direction and radius. Two tiles whose angle leaves no pair above the threshold are skipped (triangle
   inequality for angles). The rest meet as pairs of tiles, one task row each: a large label is many tiles.
3. Each pair of tiles returns the pairs that its bounds leave open, and of those that link the number of vectors per
   class, and links that span the components among the two tiles: rows in proportion to the classes, not to the links.
   Open pairs are joined with their raw vectors; the bounds leave few of them.
4. Components by alternating stars.

The directions and radii of all tiles of a label are compared with each other: some ``n / TILE`` squared small rows for a
label of n classes, quadratic as the named method is, and a millionth of the pairs of vectors.

Defined results: one row per row; null ids keep their row and are no component's least id (null if it has no other);
equal rows are copies that link with each other; a cosine of exactly the threshold links; an empty table gives no rows;
more columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .stage import cut

THRESHOLD = 0.93
TILE = 1024
PIVOTS = 8
#: 127 * 127 * STRIP is less than 2 ** 24, up to which float32 holds all integers.
STRIP = 1024
#: Room for rounding in double precision.
SLACK = 1e-9


def normalised(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, and the norms of the errors, rounded up."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    error = np.sqrt(((x - scale[:, None] * q) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
    return q, scale, error


def products(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The exact products of all pairs of int8 vectors of two tiles."""
    out = np.zeros((len(q), len(r)))
    for at in range(0, q.shape[1], STRIP):
        out += q[:, at : at + STRIP].astype(np.float32) @ r[:, at : at + STRIP].astype(np.float32).T
    return out


def tile_links(a: tuple, b: tuple, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Places of the pairs of two tiles, each (int8 values, scales, error norms), that link, and of those left open."""
    (q, s, e), (r, t, f) = a, b
    rough = products(q, r) * s[:, None] * t[None, :]
    bound = (1 + e)[:, None] * f[None, :] + e[:, None] + SLACK
    near = rough + bound >= threshold
    sure = rough - bound >= threshold
    return np.nonzero(sure), np.nonzero(near & ~sure)


def _spanning(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each node of a component of the given links to its least node."""
    least = np.arange(n)
    while True:
        new = least.copy()
        np.minimum.at(new, a, least[b])
        np.minimum.at(new, b, least[a])
        while (new[new] != new).any():
            new = new[new]
        if (new == least).all():
            moved = np.flatnonzero(least != np.arange(n))
            return moved, least[moved]
        least = new


def _pivots(width: int) -> np.ndarray:
    """Fixed directions, the same in every task."""
    return normalised(np.random.default_rng(97).standard_normal((PIVOTS, width)))


def _place(pdf_iter):
    """The nearest pivot of each class."""
    for pdf in pdf_iter:
        near = np.zeros(len(pdf), dtype=np.int32)
        for width, rows in pdf.groupby(pdf["raw"].map(len)).indices.items():
            near[rows] = (normalised(np.stack(pdf["raw"].iloc[rows].to_list())) @ _pivots(width).T).argmax(axis=1)
        yield pdf.assign(near=near)


def _tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """One tile: its classes in one row, quantised, with mean direction and radius."""
    pdf = pdf.sort_values("vec_class")
    x = normalised(np.stack(pdf["raw"].to_list()))
    mean = x.sum(axis=0)
    norm = np.sqrt((mean * mean).sum())
    mean = mean / norm if norm > 0 else x[0]
    radius = float(np.arccos(np.clip((x @ mean).min(), -1, 1)))
    q, scale, error = quantised(x)
    row = {c: pdf[c].iloc[0] for c in ("label", "width", "near", "slot")}
    return pd.DataFrame([row | {"vec_class": pdf["vec_class"].to_list(), "many": pdf["many"].to_list(), "q": q.tobytes(), "scale": scale.tobytes(), "error": error.tobytes(), "mean": mean.tolist(), "radius": radius}])


_TILE = ("vec_class", "many", "q", "scale", "error")
#: A link (a, b), a number of linked vectors n of a, or a pair (a, b) that the bounds leave open.
_FOUND = "a long, b long, n long, open boolean"


def _compare(threshold: float):
    def compare(batches):
        for batch in batches:
            for p in batch.to_pylist():
                tiles = [(np.frombuffer(p[f"q_{s}"], np.int8).reshape(-1, p["width"]), np.frombuffer(p[f"scale_{s}"]), np.frombuffer(p[f"error_{s}"])) for s in "ab"]
                same = p["tile_a"] == p["tile_b"]
                (i, j), (k, m) = tile_links(*tiles, threshold)
                if same:
                    (i, j), (k, m) = (i[i < j], j[i < j]), (k[k < m], m[k < m])
                ids_a, ids_b = np.array(p["vec_class_a"]), np.array(p["vec_class_b"])
                many_a, many_b = np.array(p["many_a"]), np.array(p["many_b"])
                ids, shift = (ids_a, 0) if same else (np.concatenate((ids_a, ids_b)), len(ids_a))
                u, v = _spanning(len(ids), i, j + shift)
                rows = [(ids[u], ids[v], np.zeros(len(u), np.int64), False)]
                for own, seen in ((ids_a, np.bincount(i, weights=many_b[j], minlength=len(ids_a))), (ids_b, np.bincount(j, weights=many_a[i], minlength=len(ids_b)))):
                    hit = np.flatnonzero(seen)
                    rows.append((own[hit], None, seen[hit].astype(np.int64), False))
                rows.append((ids_a[k], ids_b[m], np.zeros(len(k), np.int64), True))
                for a, b, n, opened in rows:
                    if len(a):
                        other = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), other, pa.array(n, pa.int64()), pa.array(np.full(len(a), opened))], ["a", "b", "n", "open"])

    return compare


def _verify(threshold: float):
    """Of open pairs with their raw vectors, those whose cosine in double precision is at least the threshold."""

    def verify(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                part = batch.slice(at, 1_000)
                sides = [part.column(c) for c in ("raw_a", "raw_b")]
                width = len(sides[0][0])
                x, y = (normalised(c.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)) if _even(c, width) else None for c in sides)
                if x is None or y is None:  # vectors of several lengths stand side by side
                    keep = [float((normalised(np.array([a.as_py()])) * normalised(np.array([b.as_py()]))).sum()) >= threshold for a, b in zip(*sides, strict=True)]
                else:
                    keep = np.einsum("ij,ij->i", x, y) >= threshold
                kept = part.filter(pa.array(keep, pa.bool_()))
                yield kept.select(["a", "b", "many_a", "many_b"])

    return verify


def _even(column: pa.Array, width: int) -> bool:
    return len(column.flatten()) == width * len(column) and all(len(v) == width for v in column)


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors(vec_id, embedding, label)``."""
    raw = F.col("embedding").cast("array<double>")
    finite = F.forall("raw", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", raw.alias("raw"))
    usable = F.coalesce(F.col("label").isNotNull() & (F.size("raw") > 0) & finite & F.exists("raw", lambda v: v != 0), F.lit(False))
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("raw", F.transform("raw", lambda v: v + F.lit(0.0)))
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("label", "raw")))
    # a class is numbered once and written, so that its number holds wherever it is read again
    classes = rows.where("key is not null").groupBy("key", "label", "raw").agg(F.count("*").alias("many"))
    classes = cut(classes.withColumn("vec_class", F.monotonically_increasing_id()))
    label_kind = dict(vectors.dtypes)["label"]
    sized = classes.select("vec_class", "label", "raw", "many", F.size("raw").alias("width"))
    placed = sized.mapInPandas(_place, f"vec_class long, label {label_kind}, raw array<double>, many long, width int, near int")
    # as many slots as keep a tile near its size, by counts that don't leave the cluster
    counts = cut(placed.groupBy("label", "width", "near").agg(F.count("*").alias("n"))).withColumn("slots", F.ceil(F.col("n") / tile).cast("int"))
    placed = placed.join(counts.drop("n"), ["label", "width", "near"]).withColumn("slot", F.pmod(F.xxhash64("vec_class", F.lit(3)), F.col("slots")).cast("int"))
    tiles = placed.groupBy("label", "width", "near", "slot").applyInPandas(
        _tile, f"label {label_kind}, width int, near int, slot int, vec_class array<long>, many array<long>, q binary, scale binary, error binary, mean array<double>, radius double"
    )
    tiles = cut(tiles.withColumn("tile", F.monotonically_increasing_id()))
    heads = tiles.select("label", "width", "tile", "mean", "radius")
    other = heads.select(F.col("label"), F.col("width"), *(F.col(c).alias(f"{c}_b") for c in ("tile", "mean", "radius")))
    angle = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.aggregate(F.zip_with("mean", "mean_b", lambda x, y: x * y), F.lit(0.0), lambda x, y: x + y))))
    pairs = heads.join(other, ["label", "width"]).where("tile <= tile_b").where(angle - F.col("radius") - F.col("radius_b") <= float(np.arccos(threshold)) + 1e-6)
    side = lambda s: tiles.select("tile", *(F.col(c).alias(f"{c}_{s}") for c in _TILE)).withColumnRenamed("tile", f"tile_{s}")
    pairs = pairs.select("width", F.col("tile").alias("tile_a"), "tile_b").repartition(*("tile_a", "tile_b"))
    found = cut(pairs.join(side("a"), "tile_a").join(side("b"), "tile_b").mapInArrow(_compare(threshold), _FOUND))
    end = lambda s: classes.select(F.col("vec_class").alias(s), F.col("many").alias(f"many_{s}"), F.col("raw").alias(f"raw_{s}"))
    opened = found.where("open").select("a", "b").join(end("a"), "a").join(end("b"), "b")
    near = cut(opened.select("a", "b", "many_a", "many_b", "raw_a", "raw_b").mapInArrow(_verify(threshold), "a long, b long, many_a long, many_b long"))
    number = found.where("not open and b is null").select("a", "n").union(near.select("a", "many_b")).union(near.select("b", "many_a"))
    linked = number.groupBy("a").agg(F.sum("n").alias("n_other"))
    parts = connected_components(found.where("not open and b is not null").select("a", "b").union(near.select("a", "b")), "a", "b")
    known = classes.select(F.col("key").alias("c_key"), F.col("label").alias("c_label"), F.col("raw").alias("c_raw"), "vec_class", "many")
    own = rows.join(known, (F.col("key") == F.col("c_key")) & (F.col("label") == F.col("c_label")) & (F.col("raw") == F.col("c_raw")), "left").select("vec_id", "vec_class", "many")
    own = own.join(linked, F.col("vec_class") == F.col("a"), "left").join(parts, F.col("vec_class") == F.col("node"), "left")
    own = cut(own.select("vec_id", F.coalesce("root", "vec_class").alias("root"), (F.coalesce("many", F.lit(1)) - 1 + F.coalesce("n_other", F.lit(0))).alias("n_links")))
    least = cut(own.where("root is not null").groupBy("root").agg(F.min("vec_id").alias("least"), F.count("*").alias("size")).where("size > 1").select(F.col("root").alias("least_root"), "least"))
    out = own.join(least, F.col("root") == F.col("least_root"), "left").withColumn("component_id", F.coalesce("least", "vec_id"))
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))
