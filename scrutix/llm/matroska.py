"""Matroska as a columnar media type: EBML elements, clusters, lacing and cues.

``store`` writes one Matroska file per row (8-bit PCM, one audio track);
``packet_table`` parses files into one row per packet with timestamp, track
and byte range; ``features`` reads the stored samples back through those byte
ranges.  All three are one narrow pass (no shuffle) in bounded memory: rows
are handled one at a time and sent on in batches of a few MB.

Defined results: a null text is an empty one; an empty text still stores one
64-byte run of zeros; null or malformed media gives ``status`` other than
``ok`` and the packets found before the fault; repeated rows give repeated
results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame

from .common import arrow_rows

UNIT = 64
RATE = 8000
FRAME = 1024
LACE = 8
CLUSTER_MS = 16_384

# Fixed values of the Matroska format: element ids.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP_SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK = 0x2AD7B1, 0xE7, 0xA3, 0xA1
TRACK_NUMBER, TRACK_TYPE, CODEC_ID, SAMPLE_RATE, CHANNELS, BIT_DEPTH = 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264
CUE_TIME, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xB3, 0xF7, 0xF1, 0xF0
REFERENCE_BLOCK, BLOCK_DURATION, DEFAULT_DURATION = 0xFB, 0x9B, 0x23E383
ENCODINGS, ENCODING, COMPRESSION, COMPRESSION_ALGORITHM, COMPRESSION_SETTINGS, ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS, ENCODINGS, ENCODING, COMPRESSION}


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 length and the bytes, zero-padded to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % UNIT if raw else UNIT)


# --- writing -----------------------------------------------------------------


def vint(value: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer (all-ones is left for 'unknown')."""
    n = width or 1
    while value >= (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def signed_vint(value: int) -> bytes:
    """An EBML-lacing size difference."""
    n = 1
    while not -(1 << (7 * n - 1)) < value < (1 << (7 * n - 1)):
        n += 1
    return (value + (1 << (7 * n - 1)) - 1 | 1 << (7 * n)).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: int) -> tuple[int, bytes]:
    """Flag bits and body of a block; mode 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if len(frames) == 1 or mode == 0:
        return 0, frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif mode == 3:
        head += vint(sizes[0]) + b"".join(signed_vint(b - a) for a, b in zip(sizes, sizes[1:-1]))
    return mode << 1, head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """A Matroska file that holds ``payload`` as 8-bit mono samples."""
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(0x4D80, b"scrutix") + element(0x5741, b"scrutix") + element(0x4489, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLE_RATE, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(0x73C5, 1) + uint(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    parts, cues, at = [info, tracks], [], len(info) + len(tracks)
    span = CLUSTER_MS * RATE // 1000
    for c, start in enumerate(range(0, len(payload), span)):
        base = start * 1000 // RATE
        body = [uint(TIMESTAMP, base)]
        cues.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at) + uint(CUE_RELATIVE, len(body[0])))))
        for k, b in enumerate(range(start, min(start + span, len(payload)), FRAME * LACE)):
            frames = [payload[i : i + FRAME] for i in range(b, min(b + FRAME * LACE, start + span, len(payload)), FRAME)]
            mode = 2 if len(frames[0]) == len(frames[-1]) else (3 if (c + k) % 2 == 0 else 1)
            flags, data = lace(frames, mode)
            body.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - base, 0x80 | flags) + data))
        parts.append(element(CLUSTER, b"".join(body)))
        at += len(parts[-1])
    parts.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(parts))


# --- reading -----------------------------------------------------------------


class Malformed(ValueError):
    """The bytes aren't a well-formed Matroska file."""


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """Value (-1: unknown size) and position after a variable-length integer."""
    if at >= len(data) or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise Malformed(f"cut off at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << (7 * n)) - 1
    return (-1 if value == (1 << (7 * n)) - 1 else value), at + n


def block_frames(data: bytes, at: int, end: int) -> tuple[int, int, bool, list[tuple[int, int]]]:
    """Track, relative time, keyframe flag and byte ranges of a block's frames."""
    track, at = read_vint(data, at, False)
    if at + 3 > end:
        raise Malformed("short block")
    rel, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    mode = flags >> 1 & 3
    if mode == 0:
        return track, rel, bool(flags & 0x80), [(at, end - at)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == 2:
        if (end - at) % n:
            raise Malformed("fixed lacing doesn't divide the block")
        sizes = [(end - at) // n] * n
    else:
        for k in range(n - 1):
            if mode == 1:
                size = 0
                while True:
                    size, at = size + data[at], at + 1
                    if data[at - 1] != 255:
                        break
            elif k == 0:
                size, at = read_vint(data, at, False)
            else:
                start = at
                value, at = read_vint(data, at, False)
                width = at - start
                value = (1 << (7 * width)) - 1 if value < 0 else value
                size = sizes[-1] + value - ((1 << (7 * width - 1)) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed("lace sizes exceed the block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, rel, bool(flags & 0x80), out


def demux(data: bytes) -> dict:
    """Tracks, packets and cues of a file.

    Packets are ``(track, timestamp_ns, offset, size, keyframe, cluster, lace,
    block)``: ``cluster`` is its position in the segment, ``block`` the
    block's position in the cluster.  Cues are ``(time_ns, track, cluster,
    block)``, the last None if the file doesn't say; ``bad_cues`` counts those
    that point at no packet of their track and time.
    """
    out: dict = {"tracks": {}, "packets": [], "cues": [], "bad_cues": 0, "scale": 1_000_000, "status": "ok"}
    try:
        if data[:4] != EBML.to_bytes(4, "big"):
            raise Malformed("no EBML header")
        _walk(data, 0, len(data), out)
    except (Malformed, IndexError, struct.error) as e:
        out["status"] = f"malformed: {e}"
    _finish(out)
    return out


def _finish(out: dict) -> None:
    """Times in nanoseconds, frames of a lace one after the other, and cues held against packets."""
    packets, shift = [], 0
    for track, ticks, offset, size, key, cluster, k, block, frames, duration in out["packets"]:
        t = out["tracks"].get(track, {})
        shift = 0 if k == 0 else shift
        packets.append((track, ticks * out["scale"] + shift, offset, size, key, cluster, k, block))
        if duration is not None:
            shift += duration * out["scale"] // frames
        elif t.get("duration"):
            shift += t["duration"]
        elif t.get("rate") and t.get("codec", "").startswith("A_PCM"):
            # uncompressed samples last as long as their number says
            shift += int(size * 8e9 / (t["rate"] * t.get("channels", 1) * t.get("bits", 8)))
    out["packets"] = packets
    out["cues"] = [(time * out["scale"], *where) for time, *where in out["cues"]]
    places = {(p[0], p[5], x, p[1]) for p in packets if p[6] == 0 for x in (p[7], None)}
    out["bad_cues"] = sum((track, cluster, block, time) not in places for time, track, cluster, block in out["cues"])


def frame_of(data: bytes, packet: tuple, tracks: dict) -> bytes:
    """A packet's frame with its track's encodings undone."""
    raw = data[packet[2] : packet[2] + packet[3]]
    for algorithm, settings in tracks.get(packet[0], {}).get("encodings", ()):
        if algorithm == 3:
            raw = settings + raw  # stripped headers
        elif algorithm == 0:
            try:
                raw = zlib.decompress(raw)
            except zlib.error as e:
                raise Malformed(f"frame at {packet[2]}: {e}") from e
        else:
            raise Malformed(f"unknown encoding {algorithm}")
    return raw


def _walk(data: bytes, at: int, end: int, out: dict) -> None:
    """Visit every element; ``stack`` holds (end, is a cluster of unknown size)."""
    stack = [(end, False)]
    track: dict = {}
    cue: dict = {}
    group: dict = {}
    segment = cluster = inside = ticks = 0
    number = lambda body: int.from_bytes(body, "big")
    while True:
        while at >= stack[-1][0]:
            if len(stack) == 1:
                return
            stack.pop()
        start = at
        ident, at = read_vint(data, at, True)
        size, at = read_vint(data, at, False)
        if stack[-1][1] and ident in (CLUSTER, CUES, INFO, TRACKS):
            stack.pop()  # a cluster of unknown size ends where a sibling starts
        stop = stack[-1][0] if size < 0 else at + size
        if stop > stack[-1][0] and ident in MASTERS:
            out["status"] = f"malformed: element {ident:X} at {start} is cut off"
            stop = stack[-1][0]  # what is there is still read
        if stop > stack[-1][0]:
            raise Malformed(f"element {ident:X} at {start} is longer than its parent")
        if ident in MASTERS:
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                cluster, inside = start - segment, at
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident == BLOCK_GROUP:
                group = {"first": len(out["packets"]), "start": start}
            elif ident == CUE_POINT:
                cue = {}
            elif ident == ENCODING:
                track.setdefault("encodings", []).insert(0, (0, b""))  # the last one applied is undone first
            stack.append((stop, ident == CLUSTER and size < 0))
            continue
        body = data[at:stop] if ident not in (SIMPLE_BLOCK, BLOCK) else b""
        if ident == TIMESTAMP_SCALE:
            out["scale"] = number(body)
        elif ident == TIMESTAMP:
            ticks = number(body)
        elif ident == TRACK_NUMBER:
            out["tracks"][number(body)] = track
        elif ident == CODEC_ID:
            track["codec"] = body.decode("ascii", "replace")
        elif ident == SAMPLE_RATE:
            track["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif ident in (CHANNELS, BIT_DEPTH, DEFAULT_DURATION):
            track[{CHANNELS: "channels", BIT_DEPTH: "bits", DEFAULT_DURATION: "duration"}[ident]] = number(body)
        elif ident == COMPRESSION_ALGORITHM and track.get("encodings"):
            track["encodings"][0] = (number(body), track["encodings"][0][1])
        elif ident == COMPRESSION_SETTINGS and track.get("encodings"):
            track["encodings"][0] = (track["encodings"][0][0], body)
        elif ident == ENCRYPTION and track.get("encodings"):
            track["encodings"][0] = (-1, b"")
        elif ident == CUE_TIME:
            cue["time"] = number(body)
        elif ident == CUE_TRACK:
            cue["track"] = number(body)
            out["cues"].append((cue.get("time", 0), cue["track"], cue.get("cluster"), None))
        elif ident in (CUE_CLUSTER, CUE_RELATIVE) and out["cues"]:
            time, number_of, where, block = out["cues"][-1]
            out["cues"][-1] = (time, number_of, number(body), block) if ident == CUE_CLUSTER else (time, number_of, where, number(body))
        elif ident in (SIMPLE_BLOCK, BLOCK):
            which, rel, key, frames = block_frames(data, at, stop)
            # in a group the flag's bit is reserved: references decide
            key, place = (key, start) if ident == SIMPLE_BLOCK else (not group.get("refers"), group.get("start", start))
            duration = group.get("duration") if ident == BLOCK else None
            out["packets"] += [(which, ticks + rel, o, s, key, cluster, k, place - inside, len(frames), duration) for k, (o, s) in enumerate(frames)]
        elif ident in (REFERENCE_BLOCK, BLOCK_DURATION) and group:
            group["refers"] = group.get("refers", False) or ident == REFERENCE_BLOCK
            if ident == BLOCK_DURATION:
                group["duration"] = number(body)
            n = group["first"]
            out["packets"][n:] = [(*p[:4], not group["refers"], *p[5:9], group.get("duration")) for p in out["packets"][n:]]
        at = stop


# --- operators ---------------------------------------------------------------


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_bytes, media)``: each text as a Matroska file."""
    import pyarrow as pa

    def one(key, text):
        n, payload = payload_of(text)
        media = mux(payload)
        yield len(media), (key, n, media)

    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
    return df.select(id_col, text_col).mapInArrow(arrow_rows(one, schema, [id_col, text_col]), f"`{id_col}` long, n_bytes long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per packet: track, timestamp, byte range, keyframe, cluster and whether a cue points at it."""
    import pyarrow as pa

    def one(key, data):
        found = demux(data or b"")
        cued = {(c[1], c[2], c[3]) for c in found["cues"]}
        for n, (track, ns, offset, size, keyframe, cluster, lace, block) in enumerate(found["packets"]):
            hit = lace == 0 and ((track, cluster, block) in cued or (track, cluster, None) in cued)
            yield 80, (key, n, track, ns, offset, size, keyframe, cluster, hit, found["status"])
        if not found["packets"]:
            yield 80, (key, None, None, None, None, None, None, None, None, found["status"])

    schema = pa.schema([(id_col, pa.int64())] + [(c, pa.int64()) for c in ("packet", "track", "timestamp_ns", "offset", "size")] + [("keyframe", pa.bool_()), ("cluster", pa.int64()), ("cued", pa.bool_()), ("status", pa.string())])
    return media.select(id_col, media_col).mapInArrow(arrow_rows(one, schema, [id_col, media_col]), f"`{id_col}` long, packet long, track long, timestamp_ns long, offset long, size long, keyframe boolean, cluster long, cued boolean, status string")


def features(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read the samples back through the packets' byte ranges and describe them.

    Columns: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (packets, clusters, cues, duration and
    sample statistics), n_packets, status.
    """
    import numpy as np
    import pyarrow as pa

    def one(key, n, data):
        data = data or b""
        found = demux(data)
        try:
            payload = b"".join(frame_of(data, p, found["tracks"]) for p in found["packets"])
        except Malformed as e:
            payload, found["status"] = b"", f"malformed: {e}"
        x = np.frombuffer(payload, np.uint8)
        signs = x >= 128
        stats = f"{x.mean():.6f}:{x.std():.6f}:{int(x.min())}:{int(x.max())}:{int((signs[1:] != signs[:-1]).sum())}" if len(x) else "-"
        last = found["packets"][-1] if found["packets"] else (0, 0, 0, 0)
        feature = f"{len(found['packets'])}:{len({p[5] for p in found['packets']})}:{len(found['cues'])}:{last[1]}:{stats}"
        yield 300, (key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found["packets"]), found["status"])

    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_packets", pa.int64()), ("status", pa.string())])
    return media.select(id_col, "n_bytes", "media").mapInArrow(arrow_rows(one, schema, [id_col, "n_bytes", "media"]), f"`{id_col}` long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, status string")


def op2_matroska(documents: DataFrame) -> DataFrame:
    """Store every whole text as Matroska and describe what is read back."""
    return features(store(documents))
