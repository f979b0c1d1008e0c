"""MinHash near-duplicate detection on SetSketch registers.

1. One pass over whole texts: word digest, number of distinct shingles and
   ``REGISTERS`` SetSketch registers (exponentially spaced, truncated minima
   of base ``BASE``: mergeable by ``max``, locality-sensitive, one byte each).
2. Texts with the same words collapse into classes (pre-aggregated, so a group
   of copies with a third of all rows costs one row each task).
3. ``BANDS`` bands of ``ROWS`` registers are bucket keys.  A bucket links its
   members to its smallest one, never all of them with each other.
4. Pairs are estimated jointly by likelihood from both sketches and the known
   set sizes; those that may reach the threshold are confirmed on full sets.
5. Confirmed links are contracted to components.  Only buckets that still hold
   several components need more: their nodes outside the bucket's largest
   component are compared with all of its nodes, tile by tile, and only links
   that join components leave a task.

At a similarity of 0.8 a pair escapes all 64 bands with probability 8e-6 (less
above it); links inside a component that others connect need not be found.

Defined results: null and empty texts have no shingles and link with nothing;
a text with fewer words than a shingle is one shingle; rows with a null doc_id
get a null component and stay; repeated doc_ids are one node of the graph;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, discard, materialize
from .graph import connected_components

BASE = 1.1
RATE = 20.0
LIMIT = 254
ROWS = 8
BANDS = 64
REGISTERS = ROWS * BANDS
MARGIN = 0.1
TILE = 512
TILE_BYTES = 4 << 20
GROUP = 1 << 18
BITMAP_BITS = 1 << 23

_rng = np.random.default_rng(20240611)
_MUL = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | 1)[:, None]
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_words: dict[bytes, int] = {}


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def digest_of(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def shingle_set(words: list[bytes], k: int) -> set:
    """The document's set itself, for confirming."""
    if not words:
        return set()
    return {tuple(words)} if len(words) < k else set(zip(*(words[i:] for i in range(k))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles."""
    import xxhash

    if len(_words) > 100_000:  # a cache only: hashes don't depend on it
        _words.clear()
    get, h = _words.get, np.empty(len(words), np.uint64)
    for i, w in enumerate(words):
        v = get(w)
        if v is None:
            v = _words[w] = xxhash.xxh64_intdigest(w)
        h[i] = v
    n = max(1, len(h) - k + 1)
    x = np.zeros(n, np.uint64)
    for j in range(min(k, len(h))):
        x = _mix(x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return np.unique(x)


def registers(hashes: np.ndarray) -> bytes:
    """SetSketch registers ``floor(1 - log_b(min))``, truncated to one byte."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(h), 512):
        np.minimum(low, (_MUL * h[a : a + 512] + _ADD).min(axis=1), out=low)
    with np.errstate(divide="ignore"):
        exp = -np.log1p(-(low.astype(np.float64) + 0.5) / 4294967296.0) / RATE
        k = np.floor(1 - np.log(exp) / np.log(BASE))
    return np.clip(k, 0, LIMIT).astype(np.uint8).tobytes()


def band_keys(sketch: bytes) -> np.ndarray:
    """A 64-bit bucket key for each band: its eight registers and its number."""
    return _mix(np.frombuffer(sketch, "<u8") + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)


def estimate(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood similarity from counts of larger and smaller registers."""
    u = (na / (na + nb))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, 201)[None, :] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p1, p2 = np.maximum(p(u - v * j), 1e-12), np.maximum(p(v - u * j), 1e-12)
    same = REGISTERS - more - less
    like = more[:, None] * np.log(p1) + less[:, None] * np.log(p2) + same[:, None] * np.log(np.maximum(1 - p1 - p2, 1e-12))
    return np.take_along_axis(j, like.argmax(axis=1)[:, None], axis=1)[:, 0]


# --- stages ------------------------------------------------------------------


def sketch(documents: DataFrame, k: int) -> DataFrame:
    """``(doc_id, cls, n_shingles, regs)`` of every document."""
    import pyarrow as pa

    def one(doc_id, text):
        words = words_of(text)
        if words:
            h = shingle_hashes(words, k)
            yield 600, (doc_id, digest_of(words), len(h), registers(h))
        else:
            yield 100, (doc_id, None, 0, None)

    schema = pa.schema([("doc_id", pa.int64()), ("cls", pa.binary()), ("n_shingles", pa.int64()), ("regs", pa.binary())])
    rows = arrow_rows(one, schema, ["doc_id", "text"])

    def run(batches):
        yield from rows(batches)
        _words.clear()  # an idle worker keeps its memory

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, cls binary, n_shingles long, regs binary")


def bands(reps: DataFrame) -> DataFrame:
    """``(key, node)``: a row for each band of each class."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            regs = b.column(b.schema.get_field_index("regs"))
            for a in range(0, b.num_rows, 2000):
                part = regs.slice(a, 2000)
                x = np.frombuffer(b"".join(part.to_pylist()), "<u8").reshape(len(part), BANDS)
                keys = _mix(x + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)).view(np.int64)
                node = np.repeat(b.column(b.schema.get_field_index("node")).slice(a, 2000).to_numpy(zero_copy_only=False), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(node)], names=["key", "node"])

    return reps.select("node", "regs").mapInArrow(run, "key long, node long")


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """``(a, b, cls_a, cls_b)`` of the pairs whose estimate may reach the threshold."""
    import pyarrow as pa

    side = lambda x: reps.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("regs").alias(f"regs_{x}"), F.col("cls").alias(f"cls_{x}"))
    n_a, n_b = F.col("n_a"), F.col("n_b")
    joined = pairs.join(side("a"), "a").join(side("b"), "b").filter(F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent)

    def run(batches):
        for b in batches:
            col = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
            matrix = lambda c: np.frombuffer(b"".join(col(c).to_pylist()), np.uint8).reshape(b.num_rows, REGISTERS)  # noqa: E731, B023
            if not b.num_rows:
                continue
            x, y = matrix("regs_a"), matrix("regs_b")
            j = estimate((x > y).sum(axis=1), (x < y).sum(axis=1), col("n_a").to_numpy().astype(float), col("n_b").to_numpy().astype(float))
            keep = pa.array(j >= percent / 100 - MARGIN)
            yield pa.RecordBatch.from_arrays([col(c).filter(keep) for c in ("a", "b", "cls_a", "cls_b")], names=["a", "b", "cls_a", "cls_b"])

    return joined.select("a", "b", "n_a", "n_b", "regs_a", "regs_b", "cls_a", "cls_b").mapInArrow(run, "a long, b long, cls_a binary, cls_b binary")


def _in_bitmap(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents whose id may be in ``ids``, by a bitmap of a fixed size.

    ``BITMAP_BITS`` bits (1 MB) are broadcast whatever the input; with very
    many ids it lets more rows through, which the join after it removes.
    """
    position = lambda c: F.pmod(F.xxhash64(c), F.lit(BITMAP_BITS)) + 1
    bits = ids.select(position(F.col("id")).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap"))
    d = documents.select("doc_id", "text", position(F.col("doc_id")).alias("p"))
    d = d.join(F.broadcast(bits), F.bitmap_bucket_number("p") == F.col("bucket"))
    at = F.bitmap_bit_position("p")
    byte = F.conv(F.hex(F.substring("bitmap", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return d.filter(F.getbit(byte.cast("int"), (at % 8).cast("int")) == 1).select("doc_id", "text")


def texts_of(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents in ``ids`` (column ``id``), as a table."""
    return materialize(_in_bitmap(documents.filter(F.col("doc_id").isNotNull()), ids).join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "near-texts")


def confirm(pairs: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """The links ``(a, b)`` among ``pairs``, decided on full sets of shingles."""
    import pyarrow as pa

    texts = texts_of(documents, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    held: dict = {}

    def known(text, cls):
        """The set, or nothing if another row of the same id has the class."""
        if cls not in held:
            if len(held) > 200:
                held.clear()
            words = words_of(text)
            held[cls] = shingle_set(words, k) if digest_of(words) == cls else None
            if held[cls] is None:
                return held.pop(cls)
        return held[cls]

    def one(a, b, cls_a, cls_b, text_a, text_b):
        x, y = known(text_a, cls_a), known(text_b, cls_b)
        if x and y:
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                yield 16, (a, b)

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    columns = ["a", "b", "cls_a", "cls_b", "text_a", "text_b"]
    links = materialize(both.select(*columns).mapInArrow(arrow_rows(one, schema, columns), "a long, b long"), "near-links")
    discard(texts)
    return links


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``(key, node, c, big)`` of buckets of three or more that hold several components.

    ``big`` is the component with most members there, so every pair across
    components has a member outside ``big``.
    """
    labelled = members.join(labels, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    # a row for each component of a bucket, then one for each bucket
    per = labelled.groupBy("key", "c").agg(F.count("*").alias("n"))
    per = per.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("comps"), F.max(F.struct("n", "c")).alias("top")).filter("size > 2 AND comps > 1")
    return labelled.join(per.select("key", F.col("top.c").alias("big")), "key")


def _groups(rest: DataFrame) -> DataFrame:
    """``(g, big, node, c)``: a node once for each group that it is compared in.

    Open buckets with the same largest component are one group, as a cluster's
    buckets hold much the same nodes.  Where that takes more than
    ``GROUP`` rows, each bucket stays a group of its own.
    """
    large = materialize(rest.groupBy("big").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("big", F.lit(True).alias("large")), "near-large")
    g = F.when(F.col("large"), F.concat(F.lit("k"), "key")).otherwise(F.concat(F.lit("c"), "big"))
    # grouped by its own key, so a large component isn't one task's
    return rest.join(large, "big", "left").groupBy(g.alias("g"), "node").agg(F.first("big").alias("big"), F.first("c").alias("c"))


def _packed(batches):
    """Tiles as compressed Arrow tables: texts of near copies shrink a lot together."""
    import pyarrow as pa

    for b in batches:
        for n in range(b.num_rows):
            rows = b.column(2)[n].values
            table = pa.Table.from_struct_array(rows) if hasattr(pa.Table, "from_struct_array") else pa.Table.from_pylist(rows.to_pylist())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(table)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(n, 1), b.column(1).slice(n, 1), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["g", "part", "rows"])


def _unpacked(blob: bytes) -> list[dict]:
    import pyarrow as pa

    with pa.ipc.open_stream(blob) as r:
        return r.read_all().to_pylist()


def _tiles(rows: DataFrame, parts: str) -> DataFrame:
    """``(g, part, rows)``: the rows of each group in tiles, by hash of the node.

    Rows meet by their tile alone, so a large group is spread over its tiles.
    """
    part = F.pmod(F.xxhash64("node"), F.col(parts)).cast("int")
    tile = F.concat_ws(":", part, "g").alias("tile")
    grouped = rows.withColumn("part", part).groupBy(tile).agg(F.first("g").alias("g"), F.first("part").alias("part"), F.collect_list(F.struct("node", "c", "outside", "n_shingles", "regs", "cls", "text")).alias("rows"))
    return grouped.select("g", "part", "rows").mapInArrow(_packed, "g string, part int, rows binary")


def across(rest: DataFrame, reps: DataFrame, documents: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components of the buckets still open.

    A group's nodes outside its largest component are compared with all of its
    nodes, in tiles of about ``TILE`` nodes or ``TILE_BYTES`` of text.  A pair
    that shares a band is estimated in numpy; what is likely is confirmed on
    full sets in the same task, and only links that join two of the task's
    components leave it.
    """
    import pyarrow as pa

    nodes = materialize(_groups(rest), "near-groups")
    texts = texts_of(documents, nodes.select(F.col("node").alias("id")).distinct())
    rows = nodes.join(reps, "node").join(texts.withColumnRenamed("doc_id", "node"), "node").withColumn("outside", F.col("c") != F.col("big"))
    rows = materialize(rows.withColumn("bytes", F.octet_length("text")), "near-open")
    tiles_for = lambda x: F.greatest(F.ceil(F.sum(x) / TILE), F.ceil(F.sum(x * F.col("bytes")) / TILE_BYTES)).cast("int")
    counts = rows.groupBy("g").agg(tiles_for(F.col("outside").cast("int")).alias("nx"), tiles_for(F.lit(1)).alias("ny")).filter("nx > 0")
    counts = materialize(counts, "near-counts")
    dealt = rows.join(counts, "g")
    x = _tiles(dealt.filter("outside"), "nx").withColumnsRenamed({"part": "px", "rows": "rows_x"})
    y = _tiles(dealt, "ny").withColumnsRenamed({"part": "py", "rows": "rows_y"})
    # a tile meets the others of its group one task each
    pairs = counts.select("g", "ny", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("px"))
    pairs = pairs.select("g", "px", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("py"))
    met = pairs.join(x, ["g", "px"]).join(y, ["g", "py"])

    def links(xs, ys):
        regs = np.frombuffer(b"".join(m["regs"] for m in ys), np.uint8).reshape(len(ys), REGISTERS)
        bands_y = regs.view("<u8")
        ids, comps, sizes, outside = (np.array([m[c] for m in ys]) for c in ("node", "c", "n_shingles", "outside"))
        joined: dict = {}  # components that links of this task have joined
        sets: dict = {}

        def root(c):
            while joined.get(c, c) != c:
                c = joined[c]
            return c

        def members(m):
            """The set, or nothing if the text is another row's of the same id."""
            if m["cls"] not in sets:
                words = words_of(m["text"])
                if digest_of(words) != m["cls"]:
                    return None
                sets[m["cls"]] = shingle_set(words, k)
            return sets[m["cls"]]

        for m in xs:
            n = m["n_shingles"]
            # two nodes outside the largest component meet from one side only
            at = np.flatnonzero((comps != m["c"]) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n)) & ~(outside & (ids < m["node"])))
            own = np.frombuffer(m["regs"], np.uint8)
            at = at[(bands_y[at] == own.view("<u8")).any(axis=1)]
            if not len(at):
                continue
            other = regs[at]
            j = estimate((own > other).sum(axis=1), (own < other).sum(axis=1), np.full(len(at), float(n)), sizes[at].astype(float))
            for i in at[j >= percent / 100 - MARGIN]:
                a, b = root(m["c"]), root(ys[i]["c"])
                if a == b:
                    continue
                p, q = members(m), members(ys[i])
                if p and q:
                    both = len(p & q)
                    if 100 * both >= percent * (len(p) + len(q) - both):
                        joined[max(a, b)] = min(a, b)
                        yield m["c"], ys[i]["c"]

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                out = list(links(_unpacked(batch.column(0)[n].as_py()), _unpacked(batch.column(1)[n].as_py())))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["a", "b"])

    found = materialize(met.select("rows_x", "rows_y").mapInArrow(run, "a long, b long"), "near-across")
    discard(nodes, texts, rows, counts)
    return found


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for every document."""
    all_rows = materialize(sketch(documents, k), "near-sketch")
    first = F.min(F.struct("doc_id", "n_shingles", "regs")).alias("r")
    reps = materialize(all_rows.filter("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(first).select("cls", F.col("r.doc_id").alias("node"), "r.n_shingles", "r.regs"), "near-reps")

    keyed = bands(reps)
    shared = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("_last")).filter("hub < _last").drop("_last")
    members = materialize(keyed.join(shared, "key"), "near-members")
    star = materialize(members.filter("node > hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-star")
    maybe = materialize(likely(star, reps, percent), "near-likely")
    links = confirm(maybe, documents, k, percent)
    labels = connected_components(links)
    discard(star, maybe, links)

    # components that open buckets join; the links that made them need not be met again
    rest = materialize(_open_buckets(members, labels), "near-rest")
    discard(members)
    joins = connected_components(across(rest, reps, documents, k, percent))
    discard(rest)
    label = reps.select("cls", "node").join(labels, "node", "left").select("cls", F.coalesce("component", "node").alias("_c"))
    node = label.join(joins.select(F.col("node").alias("_c"), F.col("component").alias("_top")), "_c", "left").select("cls", F.coalesce("_top", "_c").alias("_c"))
    out = all_rows.select("doc_id", "cls", "n_shingles").join(node, "cls", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_c", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = materialize(out, "near-result")
    discard(all_rows, reps)
    return out


def op6_setsketch(documents: DataFrame) -> DataFrame:
    """Near duplicates by two-word shingles at 80 percent."""
    return near_duplicates(documents, k=2, percent=80)


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [ws[1]]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w
), e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb
      FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * i >= 80 * (na + nb - i)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT doc_id AS v, doc_id AS r FROM s UNION SELECT x.b, reach.r FROM reach JOIN both_ways x ON x.a = reach.v AND reach.r < x.b),
m AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(m.r, s.doc_id) AS component_id, least(m.r, s.doc_id) = s.doc_id AS kept
FROM s JOIN m ON m.v = s.doc_id
"""
