"""Hierarchical multi-length packing of tokenised documents.

Each task packs its own documents as they stream by; nothing is shuffled and
memory is bounded by the pools (``POOL`` pieces a tier).  A document's whole
1024-token windows leave at once; its remainder is routed to the smallest
context tier (256, 512 or 1024) that holds it.  A tier is packed best-fit,
gaps of long windows are filled from shorter tiers (the last filler is cut to
fit), so every window is exactly full.  What is left at a task's end is cut
into windows whose lengths are powers of two, which need no padding either.
Full windows of all tiers are dealt to step groups of equal token counts.

Defined results: a null or empty text is the end id alone; a null doc_id stays
null; repeated rows are packed each on their own; very long texts are encoded
in parts cut where the tokenizer cuts anyway; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame

LENGTH = 1024
TIERS = (256, 512, 1024)
END_ID = 0
POOL = 512
STEP_TOKENS = 8192
CACHE = 100_000
LONG_TEXT = 1 << 20

_BESIDE_SPACE = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


class Encoder:
    """Ids of the byte-level BPE file, with a cache of space-delimited units.

    A single space between two non-space characters always begins a new
    pre-token, so a text's ids are the concatenation of its units' ids.  Units
    with characters beyond U+024F, texts with special tokens and texts with
    other white space next to a space go through the tokenizer as they are.
    """

    def __init__(self, vocabulary: str = "byte_bpe_50k"):
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.path = public_tokenizers.path(f"{vocabulary}.json")
        self._full = None
        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.cache: dict[str, bytes] = {}

    @property
    def full(self):
        """The tokenizer itself, loaded when a text needs it."""
        if self._full is None:
            from tokenizers import Tokenizer

            self._full = Tokenizer.from_file(self.path)
        return self._full

    def _unit(self, unit: str) -> bytes:
        if unit.isascii() or max(unit) < "ɐ":
            ids = self.fast.encode_ordinary(unit)
        else:
            ids = self.full.encode(unit, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def _units(self, parts: list[str]) -> bytes:
        """Ids of parts that each follow a space."""
        get, out = self.cache.get, []
        for p in parts:
            ids = get(p)
            if ids is None:
                ids = self._unit(" " + p)
                if len(p) <= 32 and "\n" not in p:
                    if len(self.cache) >= CACHE:
                        self.cache.clear()
                    self.cache[p] = ids
            out.append(ids)
        return b"".join(out)

    def _part(self, text: str) -> bytes:
        if _BESIDE_SPACE.search(text) or text.startswith(" ") or text.endswith(" "):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        return self._unit(head) + self._units(rest)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4")
        out, at = [], 0
        while at < len(text):
            end = at + LONG_TEXT
            if end < len(text):
                cut = _SAFE.search(text, end)
                end = cut.start() if cut else len(text)
            out.append(self._part(text[at:end]))
            at = end
        return np.frombuffer(b"".join(out), "<u4")


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str = "byte_bpe_50k") -> Encoder:
    """One encoder a worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


class Piece:
    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc, self.start, self.ids[:n], self.total), Piece(self.doc, self.start + n, self.ids[n:], self.total)


class Pool:
    """Pieces by length, for best fit."""

    def __init__(self):
        self.keys: list[tuple[int, int]] = []
        self.items: dict[int, Piece] = {}
        self.n = 0

    def __len__(self) -> int:
        return len(self.keys)

    def add(self, piece: Piece) -> None:
        insort(self.keys, (len(piece), self.n))
        self.items[self.n] = piece
        self.n += 1

    def best(self, room: int) -> Piece | None:
        """The longest piece of at most ``room``."""
        i = bisect_right(self.keys, (room, 1 << 62)) - 1
        return self.items.pop(self.keys.pop(i)[1]) if i >= 0 else None

    def longest(self) -> Piece | None:
        return self.items.pop(self.keys.pop()[1]) if self.keys else None


class Packer:
    """Yields ``(sequence, tier, step group, [pieces])`` as windows fill."""

    def __init__(self, tiers=TIERS, pool: int = POOL, step_tokens: int = STEP_TOKENS):
        self.tiers, self.limit, self.step_tokens = tiers, pool, step_tokens
        self.pools = [Pool() for _ in tiers]
        self.sequences = self.groups = 0
        self.open: dict[int, int] = {}

    def _emit(self, pieces: list[Piece]):
        length = sum(map(len, pieces))
        # first open group with room; lengths are powers of two, so groups fill exactly
        group = next((g for g, room in self.open.items() if room >= length), None)
        if group is None:
            group, self.groups = self.groups, self.groups + 1
            self.open[group] = self.step_tokens
        self.open[group] -= length
        if not self.open[group]:
            del self.open[group]
        self.sequences += 1
        return self.sequences - 1, length, group, pieces

    def _route(self, piece: Piece) -> None:
        if len(piece):
            self.pools[next(t for t, size in enumerate(self.tiers) if len(piece) <= size)].add(piece)

    def _fill(self, tier: int, seed: Piece):
        """One window of ``tier``: the seed, then best fits from its own and shorter tiers."""
        pieces, room = [seed], self.tiers[tier] - len(seed)
        while room:
            fit = None
            for t in range(tier, -1, -1):
                fit = self.pools[t].best(room)
                if fit is not None:
                    break
            if fit is None:
                whole = next((p for p in (self.pools[t].longest() for t in range(tier + 1)) if p is not None), None)
                if whole is None:
                    return pieces, room
                fit, rest = whole.cut(room)
                self._route(rest)
            pieces.append(fit)
            room -= len(fit)
        return pieces, 0

    def add(self, doc, ids: np.ndarray):
        """Pack one document; yields the windows that became full."""
        top = self.tiers[-1]
        total = len(ids)
        whole = total - total % top
        for at in range(0, whole, top):
            yield self._emit([Piece(doc, at, ids[at : at + top], total)])
        self._route(Piece(doc, whole, ids[whole:], total))
        for t, pool in enumerate(self.pools):
            if len(pool) > self.limit:
                # long windows draw on the shorter tiers while those hold enough
                pieces, _ = self._fill(t, pool.longest())
                yield self._emit(pieces)

    def finish(self):
        """Pack what is left: full windows, then lengths that are powers of two."""
        rest: list[Piece] = []
        for t in range(len(self.tiers) - 1, -1, -1):
            while len(self.pools[t]):
                pieces, room = self._fill(t, self.pools[t].longest())
                if room:
                    rest += pieces
                else:
                    yield self._emit(pieces)
        left = sum(map(len, rest))
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            pieces, room = [], size
            while room:
                piece = rest.pop(0)
                if len(piece) > room:
                    piece, after = piece.cut(room)
                    rest.insert(0, after)
                pieces.append(piece)
                room -= len(piece)
            left -= size
            yield self._emit(pieces)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier long, step_group long"


def pack(documents: DataFrame, vocabulary: str = "byte_bpe_50k", with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from and where it went, with its ids if asked for.

    ``sequence_id`` and ``step_group`` number a task's windows and groups above
    the task's number times 2^32.
    """
    import pyarrow as pa

    fields = [(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * with_ids)
    types = SCHEMA + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        enc, packer = encoder(vocabulary), Packer()
        base = TaskContext.get().partitionId() << 32
        rows: list[tuple] = []
        tokens: list[np.ndarray] = []

        def put(window):
            sequence, _, group, pieces = window
            offset = 0
            tier = sum(map(len, pieces))
            for p in pieces:
                rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids.tobytes()), p.total, base + sequence, offset, tier, base + group))
                if with_ids:
                    tokens.append(p.ids)
                offset += len(p)

        def flush():
            cols = [pa.array(list(c), pa.int64()) for c in zip(*rows)]
            if with_ids:
                at = np.cumsum([0, *map(len, tokens)], dtype=np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(tokens).astype(np.int32))))
            rows.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays(cols, schema=schema)

        end = np.array([END_ID], "<u4")
        for b in batches:
            docs, texts = b.column(b.schema.get_field_index("doc_id")), b.column(b.schema.get_field_index("text"))
            for i in range(b.num_rows):
                ids = np.concatenate([enc.encode(texts[i].as_py()), end])
                for window in packer.add(docs[i].as_py(), ids):
                    put(window)
                    if len(rows) >= 4000:
                        yield flush()
        for window in packer.finish():
            put(window)
        if rows:
            yield flush()
        enc.cache.clear()  # an idle worker keeps its memory

    return documents.select("doc_id", "text").mapInArrow(run, types)


def op8_packing(documents: DataFrame) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return pack(documents)
