"""Embedding near-duplicates by PCA-ordered tiled comparison.

Vectors keep their own components (scaled by a power of two, which is exact);
inside tasks unit vectors are rotated by principal axes (fitted on a bounded
sample; any rotation gives the same cosines).  Two vectors with cosine t are within
``sqrt(2 - 2t)``, so only cells of a grid of that width over the leading axes,
and its neighbours, can hold links.  Cells are cut into tiles of about
``TILE`` vectors; a pair of tiles whose boxes are too far apart is skipped.
Inside a pair of tiles leading dimensions are multiplied first, the rest is
bounded by suffix norms (Cauchy-Schwarz), and rows and columns that cannot
reach the threshold drop out before more dimensions are added.  Pairs within
``SLACK`` of the threshold are decided on the unrotated components.

A tile pair returns a row for each vector that has links (a count and its
smallest neighbour in the pair's own components), never the pairs, so a large
group of near copies stays linear in what is shuffled.  Equal vectors collapse
into one class before anything is compared.

Defined results: a null label, a null vector, a zero vector or one with null
or non-finite components links with nothing; vectors of different lengths
don't link; a null vec_id has a null component and no links; repeated vec_ids
are one node; labels of any type are compared as text; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .graph import connected_components

THRESHOLD = 0.98
SAMPLE = 4096
AXES = 3
TILE = 1024
STEP = 8
BOX = 16
SLACK = 1e-9


def _valid_rows(batch) -> list[tuple]:
    """``(vec_id, label, dims, class, components)`` of the valid rows of an Arrow batch."""
    col = lambda c: batch.column(batch.schema.get_field_index(c))
    out = []
    for vec_id, label, x in zip(col("vec_id"), col("label"), col("embedding")):
        if not (vec_id.is_valid and label.is_valid and x.is_valid):
            continue
        values = x.values
        if values is None or not len(values) or values.null_count:
            continue
        v = values.to_numpy(zero_copy_only=False).astype(np.float64)
        top = np.abs(v).max()
        if not np.isfinite(top) or top == 0:
            continue
        v = np.ldexp(v, -int(np.frexp(top)[1])) + 0.0  # no overflow or underflow in the norm, no negative zeros
        u = _units(v[None])[0]
        out.append((vec_id.as_py(), label.as_py(), len(v), hashlib.blake2b(u.tobytes(), digest_size=16).digest(), v))
    return out


def _units(x: np.ndarray) -> np.ndarray:
    """Rows over their norms."""
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """``(vec_id, label, dims, cls, x)`` of the vectors that may link."""
    import pyarrow as pa

    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("cls", pa.binary()), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            rows = [(i, g, n, c, v.tobytes()) for i, g, n, c, v in _valid_rows(b)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    source = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast("array<double>"))
    return source.mapInArrow(run, "vec_id long, label string, dims int, cls binary, x binary")


def principal_axes(vectors: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """For each length, orthogonal axes in falling order of variance, from a bounded sample."""
    rows = vectors.select("dims", "x").orderBy(F.xxhash64("cls"), "vec_id").limit(sample).collect()
    axes = {}
    for dims in {r.dims for r in rows}:
        x = _units(np.stack([np.frombuffer(r.x) for r in rows if r.dims == dims]))
        values, v = np.linalg.eigh(x.T @ x - len(x) * np.outer(x.mean(axis=0), x.mean(axis=0)))
        axes[dims] = np.ascontiguousarray(v[:, np.argsort(-values, kind="stable")])
    return axes


def rotated(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit rows on the principal axes (on their own where the sample had none of their length)."""
    u = _units(x)
    return u @ axes[x.shape[1]] if x.shape[1] in axes else u


def with_cells(classes: DataFrame, axes: dict[int, np.ndarray], width: float) -> DataFrame:
    """``(node, weight, label, dims, cell, x)``: vectors and their grid cells."""
    import pyarrow as pa

    schema = pa.schema([("node", pa.int64()), ("weight", pa.int64()), ("label", pa.string()), ("dims", pa.int32()), ("cell", pa.list_(pa.int32())), ("x", pa.binary())])

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            lead = [rotated(np.frombuffer(x)[None], axes)[0, :AXES] for x in col("x").to_pylist()]
            cells = [[*np.floor(y / width).astype(int).tolist(), 0, 0, 0][:AXES] for y in lead]
            yield pa.RecordBatch.from_arrays([col("node"), col("weight"), col("label"), col("dims"), pa.array(cells, pa.list_(pa.int32())), col("x")], schema=schema)

    return classes.select("node", "weight", "label", "dims", "x").mapInArrow(run, "node long, weight long, label string, dims int, cell array<int>, x binary")


def tiles(points: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """``(label, dims, cell, tile, nodes, weights, matrix, lo, hi)`` of about ``TILE`` vectors each.

    A cell's vectors meet its count in a join that Spark may split, and are
    grouped by the tile alone, so a hot cell is spread over its tiles.
    """
    import pyarrow as pa

    key = ["label", "dims", "cell"]
    counts = materialize(points.groupBy(*key).agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts")), "vec-cells")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    parts = points.join(counts, key).withColumn("tile", F.concat_ws(":", "dims", F.array_join(F.col("cell").cast("array<string>"), ","), part, "label"))
    packed = parts.groupBy("tile").agg(*(F.first(c).alias(c) for c in key), F.collect_list(F.struct("node", "weight", "x")).alias("rows"))
    schema = pa.schema([("label", pa.string()), ("dims", pa.int32()), ("cell", pa.list_(pa.int32())), ("tile", pa.string()), ("nodes", pa.binary()), ("weights", pa.binary()), ("matrix", pa.binary()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                rows = sorted(r["rows"], key=lambda x: x["node"])
                m = np.frombuffer(b"".join(x["x"] for x in rows)).reshape(len(rows), -1)
                box = rotated(m, axes)[:, :BOX]
                values = (r["label"], r["dims"], r["cell"], r["tile"], np.array([x["node"] for x in rows], np.int64).tobytes(), np.array([x["weight"] for x in rows], np.int64).tobytes(), m.tobytes(), box.min(axis=0).tolist(), box.max(axis=0).tolist())
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    return packed.select(*key, "tile", "rows").mapInArrow(run, "label string, dims int, cell array<int>, tile string, nodes binary, weights binary, matrix binary, lo array<double>, hi array<double>")


def tile_pairs(t: DataFrame, limit: float) -> DataFrame:
    """``(s, t)``: pairs of tiles of equal or neighbouring cells whose boxes are near enough."""
    half = [o for o in itertools.product((-1, 0, 1), repeat=AXES) if o >= (0,) * AXES]
    offsets = F.array(*(F.array(*map(F.lit, o)) for o in half))
    meta = t.select("label", "dims", "cell", "tile", "lo", "hi")
    left = meta.select("label", "dims", F.col("tile").alias("s"), F.col("lo").alias("lo_s"), F.col("hi").alias("hi_s"), F.col("cell").alias("cell_s"), F.explode(offsets).alias("o"))
    left = left.withColumn("cell", F.zip_with("cell_s", "o", lambda a, b: a + b))
    right = meta.withColumnsRenamed({"tile": "t", "lo": "lo_t", "hi": "hi_t"})
    gap = F.zip_with(F.arrays_zip("lo_s", "hi_s"), F.arrays_zip("lo_t", "hi_t"), lambda a, b: F.greatest(a["lo_s"] - b["hi_t"], b["lo_t"] - a["hi_s"], F.lit(0.0)))
    distance = F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x * x)
    same = F.col("cell_s") == F.col("cell")
    near = left.join(right, ["label", "dims", "cell"]).filter(~same | (F.col("s") <= F.col("t"))).filter(distance <= limit * limit + SLACK)
    return near.select("s", "t")


def _cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In extended precision."""
    x, y = x.astype(np.longdouble), y.astype(np.longdouble)
    return (x @ y) / np.sqrt((x @ x) * (y @ y))


def links_of(a: np.ndarray, b: np.ndarray, threshold: float, exact=None) -> tuple[np.ndarray, np.ndarray]:
    """Indices ``(i, j)`` of row pairs with a product of at least ``threshold``.

    Leading dimensions first; the rest is bounded by the suffixes' norms.
    ``exact(i, j)`` gives the cosine that decides pairs within ``SLACK``.
    """
    d = a.shape[1]
    rows, cols = np.arange(len(a)), np.arange(len(b))
    product = np.zeros((len(a), len(b)))
    for at in range(0, d, STEP):
        end = min(d, at + STEP)
        product += a[rows, at:end] @ b[cols, at:end].T
        if end < d:
            rest = np.sqrt((a[rows, end:] ** 2).sum(axis=1))[:, None] * np.sqrt((b[cols, end:] ** 2).sum(axis=1))[None, :]
            live = product + rest >= threshold - SLACK
            r, c = live.any(axis=1), live.any(axis=0)
            if not r.any():
                return np.zeros(0, int), np.zeros(0, int)
            if r.mean() < 0.7 or c.mean() < 0.7:
                rows, cols, product = rows[r], cols[c], product[np.ix_(r, c)]
    i, j = np.nonzero(product >= threshold - SLACK)
    near = np.flatnonzero(product[i, j] < threshold + SLACK)
    i, j = rows[i], cols[j]
    if not len(near) or exact is None:
        return i, j
    keep = np.ones(len(i), bool)
    keep[near] = [exact(i[k], j[k]) >= threshold for k in near]
    return i[keep], j[keep]


def _roots(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the smallest one it is connected with by links ``(i, j)``."""
    low = nodes.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, i, before[j])
        np.minimum.at(low, j, before[i])
        # follow the smallest node's own value
        low = np.minimum(low, low[np.searchsorted(nodes, low)])
        if (low == before).all():
            return low


def compare(pairs: DataFrame, t: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """``(node, links, root)``: for each pair of tiles, its vectors that have links."""
    import pyarrow as pa

    side = lambda x: t.select(F.col("tile").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("nodes", "weights", "matrix")))
    joined = pairs.join(side("s"), "s").join(side("t"), "t")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda c: batch.column(batch.schema.get_field_index(c))[k].as_py()  # noqa: E731, B023
                alone = get("s") == get("t")
                na, wa = np.frombuffer(get("nodes_s"), np.int64), np.frombuffer(get("weights_s"), np.int64)
                a = np.frombuffer(get("matrix_s")).reshape(len(na), -1)
                nb, wb = np.frombuffer(get("nodes_t"), np.int64), np.frombuffer(get("weights_t"), np.int64)
                b = np.frombuffer(get("matrix_t")).reshape(len(nb), -1)
                i, j = links_of(rotated(a, axes), rotated(b, axes), threshold, lambda p, q: _cosine(a[p], b[q]))  # noqa: B023
                if alone:
                    i, j = i[i < j], j[i < j]
                if not len(i):
                    continue
                nodes = np.unique(np.r_[na[i], nb[j]])
                p, q = np.searchsorted(nodes, na[i]), np.searchsorted(nodes, nb[j])
                count = np.zeros(len(nodes), np.int64)
                np.add.at(count, p, wb[j])
                np.add.at(count, q, wa[i])
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(count), pa.array(_roots(nodes, p, q))], names=["node", "links", "root"])

    return joined.mapInArrow(run, "node long, links long, root long")


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, a row for every vector."""
    limit = math.sqrt(2 - 2 * threshold)
    vectors = materialize(vectors_of(embeddings), "vec-rows")
    group = ["label", "dims", "cls"]
    first = F.min(F.struct("vec_id", "x")).alias("r")
    classes = materialize(vectors.groupBy(*group).agg(first, F.count("*").alias("weight")).select(*group, F.col("r.vec_id").alias("node"), "weight", F.col("r.x").alias("x")), "vec-classes")
    axes = principal_axes(vectors)
    t = materialize(tiles(with_cells(classes, axes, limit + SLACK), axes), "vec-tiles")
    found = materialize(compare(tile_pairs(t, limit), t, axes, threshold), "vec-links")
    labels = connected_components(found.filter("node > root").select(F.col("node").alias("a"), F.col("root").alias("b")), "vec-cc")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    node = classes.select(*group, "node", "weight").join(counts, "node", "left").join(labels, "node", "left")
    node = node.select(*group, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("_links"), F.coalesce("component", "node").alias("_c"))
    linked = vectors.select("vec_id", *group).join(node, group).groupBy("vec_id").agg(F.max("_links").alias("_links"), F.min("_c").alias("_c"))
    out = embeddings.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked, "vec_id", "left")
    component = F.coalesce("_c", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_embeddings(embeddings: DataFrame) -> DataFrame:
    """Links of equal label with a cosine of at least 0.98."""
    return near_vectors(embeddings)


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0
    AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND list_inner_product(x, x) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x)) / sqrt(list_inner_product(b.x, b.x)) >= 0.98
), n AS (SELECT a, count(*) AS n FROM l GROUP BY a),
reach AS (SELECT vec_id AS v, vec_id AS r FROM v UNION SELECT l.b, reach.r FROM reach JOIN l ON l.a = reach.v AND reach.r < l.b),
m AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, m.r AS component_id, m.r = v.vec_id AS kept
FROM v JOIN m ON m.v = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
