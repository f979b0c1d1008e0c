"""Temperature mixing of sources, realised as budgeted block permutations.

Source shares p of all tokens are raised to an exponent a and normalised:
weight = p^a / sum(p^a).  The exponent is bisected (six halvings a pass over
the table of sources) to the smallest departure from natural shares that meets
a target entropy, or to the flattest mix whose repetition stays within a
limit.  With a budget of B tokens a source is read B * weight / tokens times.

Every source is permuted by a hash; a document's place is the number of
tokens before it.  Whole epochs take every document, the last one takes those
before the budget's remainder, and each epoch starts elsewhere in the
permutation.  A place's fraction of the source's budget is its block, so every
block of ``block_tokens`` holds all sources at their weights; ``order_key``
permutes a block.

SQL functions only.  Places come from prefix sums over hash buckets of about
``BUCKET`` rows and a hierarchy above them, so a source with a third of all
rows is spread over its many buckets.

Defined results: a null source is a source of its own; null and empty texts
have no tokens and are taken once in every whole epoch; a source without
tokens is read once; equal hashes go by tokens; repeated rows are rows of
their own; an empty table gives no rows; extra columns are kept, and those named like
the result's are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

MAX_REPEATS = 2.0
BLOCK_TOKENS = 1 << 20
BUCKET = 32
RADIX = 7
LEVELS = 3
HALVINGS = 6
PASSES = 5


def token_count(text: Column) -> Column:
    """Tokens as runs of characters that aren't white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _at(sources: DataFrame, exponents: list[float]) -> dict[float, tuple]:
    """For each exponent: sum p^a, sum p^a ln p^a, max and min of p^(a-1)."""
    t = sources.filter("tokens > 0").select("share", F.explode(F.array(*map(F.lit, exponents))).alias("a"))
    w = F.pow("share", "a")
    ratio = F.pow("share", F.col("a") - 1)
    rows = t.groupBy("a").agg(F.sum(w).alias("z"), F.sum(w * F.log(w)).alias("zl"), F.max(ratio).alias("top"), F.min(ratio).alias("low")).collect()
    return {r.a: (r.z, r.zl, r.top, r.low) for r in rows}


def bisect_exponent(sources: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent in [0, 1].

    ``entropy`` (in nats): the largest exponent whose weights have at least
    it.  ``max_repeats``: the smallest one at which no source is read more
    often, for ``budget`` times all tokens (None: just enough that no source
    is read less than once).  A limit that even the natural shares (or, for
    entropy, equal shares) can't meet gives that end.
    """

    def meets(s: tuple) -> bool:
        z, zl, top, low = s
        if entropy is not None:
            return math.log(z) - zl / z >= entropy
        return (top / low if budget is None else budget * top / z) <= max_repeats + 1e-12

    lo, hi = 0.0, 1.0
    found = _at(sources, [0.0, 1.0])
    if not found:
        return 1.0
    # entropy falls with the exponent and so does repetition
    if entropy is not None and (meets(found[1.0]) or not meets(found[0.0])):
        return 1.0 if meets(found[1.0]) else 0.0
    if entropy is None and (meets(found[0.0]) or not meets(found[1.0])):
        return 0.0 if meets(found[0.0]) else 1.0
    for _ in range(PASSES):
        n = 1 << HALVINGS
        grid = [lo + (hi - lo) * i / n for i in range(1, n)]
        values = _at(sources, grid)
        for _ in range(HALVINGS):
            mid = min(grid, key=lambda g: abs(g - (lo + hi) / 2))
            ok = meets(values[mid])
            lo, hi = (mid, hi) if ok == (entropy is not None) else (lo, mid)
    return lo if entropy is not None else hi


def _prefix(t: DataFrame, key: str, level: int) -> DataFrame:
    """``t`` (source, ``key``, tokens) with ``before``: the tokens of smaller keys of its source."""
    if level == 0:
        w = Window.partitionBy("_s").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        return t.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    t = t.withColumn("_up", F.shiftright(key, RADIX))
    ups = _prefix(t.groupBy("_s", "_up").agg(F.sum("tokens").alias("tokens")).withColumnRenamed("_up", f"_k{level}"), f"_k{level}", level - 1)
    w = Window.partitionBy("_s", "_up").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    own = t.withColumn("_in", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    ups = ups.select("_s", F.col(f"_k{level}").alias("_up"), F.col("before").alias("_base"))
    return own.join(ups, ["_s", "_up"]).withColumn("before", F.col("_in") + F.col("_base")).drop("_up", "_in", "_base")


def source_table(documents: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None) -> DataFrame:
    """A row for each source: documents, tokens, share, weight, repeats and budgeted tokens.

    ``documents`` has ``_s`` and ``_tokens``.  ``budget`` is in multiples of
    all tokens; None reads no source less than once.
    """
    counts = materialize(documents.groupBy("_s").agg(F.count("*").alias("docs"), F.sum("_tokens").alias("tokens")), "mix-sources")
    total = counts.agg(F.sum("tokens")).first()[0] or 0
    shares = counts.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = bisect_exponent(shares, entropy, None if entropy is not None else max_repeats, budget)
    z, _, _, low = _at(shares, [a]).get(a, (1.0, 0.0, 1.0, 1.0))
    times = budget if budget is not None else z / low
    weight = F.when(F.col("tokens") > 0, F.pow("share", F.lit(a)) / F.lit(z)).otherwise(0.0)
    repeats = F.when(F.col("tokens") > 0, F.lit(times) * weight / F.col("share")).otherwise(1.0)
    out = shares.select("_s", "docs", "tokens", "share", F.lit(a).alias("exponent"), weight.alias("weight"), repeats.alias("repeats"))
    whole = F.floor(F.col("repeats") + 1e-9)
    out = out.withColumns({"whole": whole, "rest": F.greatest(F.col("repeats") - whole, F.lit(0.0)) * F.col("tokens")})
    bits = F.greatest(F.ceil(F.log2(F.greatest(F.col("docs"), F.lit(1)) / BUCKET)), F.lit(0)).cast("int")
    out = out.withColumns({"bits": bits, "budget": F.col("repeats") * F.col("tokens"), "blocks": F.lit(max(1, math.ceil(times * total / BLOCK_TOKENS)))})
    return materialize(out, "mix-weights")


def mix(documents: DataFrame, entropy: float | None = None, max_repeats: float | None = MAX_REPEATS, budget: float | None = None, seed: int = 1, details: bool = True) -> DataFrame:
    """``documents`` repeated to target weights.

    With ``details`` epoch, block, order_key, tokens, weight and exponent are
    added, in place of input columns of these names; row order is given by
    (``block``, ``order_key``).  Without, the columns stay as they are and
    the rows are ranges of that order, sorted, one a partition.
    """
    columns = documents.columns
    row = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_row")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_s")
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1).alias("_h")
    d = documents.select(key, token_count(F.col("text")).alias("_tokens"), place, row)
    sources = source_table(d.select("_s", "_tokens"), entropy, max_repeats, budget)
    # the table of sources is small; Spark broadcasts it if its size allows
    d = d.join(sources.select("_s", F.col("tokens").alias("_n"), "whole", "rest", "bits", "budget", "blocks", "weight", "exponent"), "_s")
    d = d.withColumn("_bucket", F.expr("CASE WHEN bits = 0 THEN 0L ELSE shiftrightunsigned(_h, 63 - bits) END"))
    buckets = _prefix(materialize(d.groupBy("_s", "_bucket").agg(F.sum("_tokens").alias("tokens")), "mix-buckets"), "_bucket", LEVELS)
    w = Window.partitionBy("_s", "_bucket").orderBy("_h", "_tokens").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_tokens").over(w), F.lit(0)))
    d = d.join(materialize(buckets.select("_s", "_bucket", "before"), "mix-prefix"), ["_s", "_bucket"])
    d = d.withColumn("_at", F.col("before") + F.col("_in"))
    d = d.withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int"))))
    # each epoch starts at another place of the source's permutation
    n = F.greatest(F.col("_n"), F.lit(1))
    start = F.floor(n * F.expr("_epoch * 0.6180339887498949D % 1"))
    d = d.withColumn("_place", F.pmod(F.col("_at") + start, n))
    d = d.filter((F.col("_epoch") < F.col("whole")) | (F.col("_place") < F.col("rest")))
    part = (F.col("_epoch") * n + F.col("_place")) / F.greatest(F.col("budget"), F.lit(1.0))
    added = {
        "epoch": F.col("_epoch").cast("long"),
        "block": F.least(F.floor(part * F.col("blocks")), F.col("blocks") - 1).cast("long"),
        "order_key": F.xxhash64(F.lit(seed), "_epoch", "_h"),
        "tokens": F.col("_tokens"),
        "weight": F.col("weight"),
        "exponent": F.col("exponent"),
    }
    if not details:
        # rows of a block lie together, in its order, for what reads them next
        order = d.select(added["block"].alias("_block"), added["order_key"].alias("_key"), "_row")
        return order.repartitionByRange("_block", "_key").sortWithinPartitions("_block", "_key").select("_row.*")
    return d.select(*(F.col("_row").getField(c).alias(c) for c in columns if c not in added), *(c.alias(k) for k, c in added.items()))


def op1_mixing(documents: DataFrame) -> DataFrame:
    """The mix of all documents with at most two readings of any source and none left out."""
    return mix(documents.select("doc_id", "text", "source")).drop("text")
