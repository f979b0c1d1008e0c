"""Byte-level convolutional network in numpy as a quality classifier.

A byte filter looks at ``WIDTH`` bytes every ``STRIDE`` bytes.  The input is
one-hot, so a convolution is a sum of table rows, one table per position; one
more input channel marks bytes of words that repeat the word before them.
ReLU responses are averaged over overlapping chunks of ``CHUNK`` windows
(half a chunk apart) that cover the whole document; learned units over the
chunks are max-pooled over the document and combined into one probability.

Training takes a bounded sample (at most ``TRAIN_ROWS`` labelled rows of at
most ``TRAIN_CHARS`` characters, smallest hash first) to the driver and is
deterministic.  Scoring is one narrow pass over whole texts; long ones are
convolved in pieces of ``PIECE`` windows, so memory stays bounded.

Defined results: a null or empty text is one window of padding and gets that
window's score; without labelled rows, or with a single class, every score is
the share of label 1 (0.5 without rows); rows without a label or text don't
train; repeated rows get equal scores; extra columns are kept by ``classify``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


WIDTH = 8
STRIDE = 4
FILTERS = 16
UNITS = 12
CHUNK = 64
PIECE = 1 << 16
TRAIN_ROWS = 3000
TRAIN_CHARS = 100_000
EPOCHS = 8
BATCH = 32
THRESHOLD = 0.3
PAD = 256

_WORD = np.ones(PAD + 1, bool)
_WORD[[9, 10, 11, 12, 13, 32, PAD]] = False


def windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Padded byte ids, their repetition channel and the number of windows."""
    n = max(1, -(-max(len(raw) - WIDTH, 0) // STRIDE) + 1)
    x = np.full((n - 1) * STRIDE + WIDTH, PAD, np.int16)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    m = np.zeros(len(x), np.float32)
    words = raw.split()
    if len(words) > 1:
        w = _WORD[x]
        starts = np.flatnonzero(w & ~np.r_[False, w[:-1]])
        again = np.fromiter(map(bytes.__eq__, words[1:], words), np.float32, len(words) - 1)
        spans = np.diff(np.r_[starts, len(x)])
        m[starts[0] :] = np.repeat(np.r_[np.float32(0), again], spans)
    return x, m, n


class Net:
    """``table`` (WIDTH, 257, F), ``repeat`` (F), ``bias`` (F); ``mix`` (F, U), ``shift`` (U); ``dense`` (U), ``out`` (1)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        n = lambda s, *shape: r.normal(0, s, shape).astype(np.float32)
        self.table = n(0.3, WIDTH, PAD + 1, FILTERS)
        self.repeat = n(0.5, FILTERS)
        self.bias = np.zeros(FILTERS, np.float32)
        self.mix = n(0.5, FILTERS, UNITS)
        self.shift = np.zeros(UNITS, np.float32)
        self.dense = n(0.5, UNITS)
        self.out = np.zeros(1, np.float32)
        self.constant: float | None = None

    def params(self) -> list[np.ndarray]:
        return [self.table, self.repeat, self.bias, self.mix, self.shift, self.dense, self.out]

    def respond(self, x: np.ndarray, m: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Responses of all filters at the windows that start at ``at``; their repetition."""
        z = self.table[0].take(x[at], axis=0)
        for k in range(1, WIDTH):
            z += self.table[k].take(x[at + k], axis=0)
        rep = m[at] + m[at + WIDTH - 1]
        z += rep[:, None] * self.repeat
        z += self.bias
        return np.maximum(z, 0, out=z), rep

    def chunk_means(self, x: np.ndarray, m: np.ndarray, n: int) -> np.ndarray:
        """Mean response of each overlapping chunk of one document."""
        half = CHUNK // 2
        sums = []
        for a in range(0, n, PIECE):
            z, _ = self.respond(x, m, np.arange(a, min(n, a + PIECE)) * STRIDE)
            sums.append(np.add.reduceat(z, np.arange(0, len(z), half), axis=0))
        s = np.concatenate(sums)
        count = np.full(len(s), half, np.float32)
        count[-1] = n - half * (len(s) - 1)
        return s / count[:, None] if len(s) == 1 else (s[:-1] + s[1:]) / (count[:-1] + count[1:])[:, None]

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        c = self.chunk_means(*windows((text or "").encode("utf-8", "surrogatepass")))
        top = np.maximum(c @ self.mix + self.shift, 0).max(axis=0)
        z = float(top.astype(np.float64) @ self.dense.astype(np.float64)) + float(self.out[0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _gradients(net: Net, batch: list, y: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Gradients of the weighted mean log loss over a few documents."""
    grads = [np.zeros_like(p) for p in net.params()]
    half = CHUNK // 2
    for (x, m, n), label, w in zip(batch, y, weight):
        at = np.arange(n) * STRIDE
        z, rep = net.respond(x, m, at)
        s = np.add.reduceat(z, np.arange(0, n, half), axis=0)
        count = np.full(len(s), half, np.float32)
        count[-1] = n - half * (len(s) - 1)
        per = count if len(s) == 1 else count[:-1] + count[1:]
        c = (s if len(s) == 1 else s[:-1] + s[1:]) / per[:, None]
        pre = np.maximum(c @ net.mix + net.shift, 0)
        arg = pre.argmax(axis=0)
        top = pre[arg, np.arange(UNITS)]
        p = 1 / (1 + np.exp(-np.clip(top @ net.dense + net.out[0], -30, 30)))
        g = np.float32((p - label) * w / len(batch))
        grads[5] += g * top
        grads[6] += g
        d = g * net.dense * (top > 0)
        grads[3] += c[arg].T * d
        grads[4] += d
        dc = np.zeros_like(c)
        np.add.at(dc, arg, (net.mix * d).T)
        dc /= per[:, None]
        ds = np.zeros_like(s)
        ds[: len(dc)] += dc
        if len(s) > 1:
            ds[1:] += dc
        live = np.flatnonzero(np.repeat((ds != 0).any(axis=1), count.astype(int)))
        if not len(live):
            continue
        dz = ds[live // half] * (z[live] > 0)
        grads[1] += rep[live] @ dz
        grads[2] += dz.sum(axis=0)
        for k in range(WIDTH):
            b = x[live * STRIDE + k]
            o = np.argsort(b, kind="stable")
            bs = b[o]
            first = np.flatnonzero(np.r_[True, bs[1:] != bs[:-1]])
            grads[0][k][bs[first]] += np.add.reduceat(dz[o], first, axis=0)
    return grads


def train(texts: list[str], labels: list[int], epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> Net:
    """Adam on the log loss with both classes weighted alike, in a fixed order."""
    net = Net(seed)
    y = np.asarray(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.constant = float(y.mean()) if len(y) else 0.5
        return net
    docs = [windows(t.encode("utf-8", "surrogatepass")) for t in texts]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    shuffle = np.random.default_rng(seed)
    params = net.params()
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = shuffle.permutation(len(docs))
        lr = rate * (1 - epoch / epochs) + 1e-4
        for a in range(0, len(order), BATCH):
            step += 1
            pick = order[a : a + BATCH]
            for q, g, u, v in zip(params, _gradients(net, [docs[i] for i in pick], y[pick], weight[pick]), m1, m2):
                u += 0.1 * (g - u)
                v += 0.001 * (g * g - v)
                q -= lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


# --- operators ---------------------------------------------------------------


def bucket_of(doc_id) -> "F.Column":
    """``crc32`` of the id as text, modulo 5; 0 is held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def sample(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> list[tuple[str, int]]:
    """At most ``rows`` labelled texts of at most ``chars`` characters for training, smallest hash of the id first.

    The limits are the documented bounds of the fit; scoring has none.  The
    sample's ids (a few KB) select the texts, so labels don't meet documents in
    a large join.
    """
    hashed = F.xxhash64(F.lit(11), F.col("doc_id"))
    ids = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (bucket_of("doc_id") != 0))
        .select("doc_id", F.col("quality").cast("int").alias("_y"))
        .orderBy(hashed, "doc_id", "_y")
        .limit(rows)
    )
    found = documents.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.length("text") <= chars)).join(F.broadcast(ids), "doc_id")
    got = found.orderBy(hashed, "text", "_y").limit(rows).select("text", "_y").collect()
    return [(r[0], r[1]) for r in got]


def classify(documents: DataFrame, net: Net, columns: list[str] | None = None, name: str = "score") -> DataFrame:
    """``documents`` (or its ``columns``) with ``name``, the probability of label 1.

    An input column of that name is replaced.  The network (about 130 KB) is
    pickled with the task; the other columns pass through Arrow batches.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType

    kept = [c for c in (documents.columns if columns is None else columns) if c != name]
    source = documents.select(*(F.col(f"`{c}`") for c in kept), F.col("text").alias("_score_text"))
    schema = StructType([source.schema[c] for c in kept] + [StructField(name, DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            texts = b.column(b.num_columns - 1)
            scores = pa.array([net.score(texts[i].as_py()) for i in range(b.num_rows)], pa.float64())
            cols = [b.column(i).cast(arrow.field(i).type) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays([*cols, scores], schema=arrow)

    return source.mapInArrow(run, schema)


def fit(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Net:
    got = sample(documents, labels, rows, chars)
    return train([t for t, _ in got], [y for _, y in got])


def op7_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score every document; labels of the held-out fifth are never seen."""
    scored = classify(documents, fit(documents, labels), columns=["doc_id"])
    return scored.select(
        "doc_id",
        (F.coalesce(bucket_of("doc_id"), F.lit(-1)) == 0).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
