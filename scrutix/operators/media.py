r"""Provenance of media files: facts from container chunks, then findings and a score.

Walking chunks is byte work and runs over Arrow batches; what it returns is a
flat row of facts, and tool fingerprints, findings, score and risk are column
expressions on it.  A damaged file costs only its own row.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------

C2PA_UUID = bytes.fromhex("d8fec7104c164e808a2a6ce2ed758d5b")
PROVENANCE = r"c2pa|content\s*credentials|contentauth"
BOXES_WITHIN = frozenset((b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta", b"meta", b"ilst", b"edts"))
FILLER = frozenset((b"free", b"skip", b"junk", b"wide"))
TEXT, BIT, LEAF, HANDLER, INFLATED = 8192, 2048, 1024, 256, 65536
#: Tool: (pattern, confidence, category).
TOOLS = {
    "Stable Diffusion WebUI (A1111)": (r"Steps:\s*\d+,\s*Sampler|sd[-_]?metadata", "high", "synthetic_generation"),
    "ComfyUI": (r"ComfyUI|\"workflow\"\s*:", "high", "synthetic_generation"),
    "InvokeAI": (r"invokeai_metadata|invoke[-_]?ai", "high", "synthetic_generation"),
    "DALL-E / OpenAI": (r"dall[\-·]?e|\bopenai\b", "high", "synthetic_generation"),
    "Midjourney": (r"midjourney|--ar\s+\d", "high", "synthetic_generation"),
    "Adobe Firefly": (r"firefly|adobe\s*firefly", "high", "synthetic_generation"),
    "Google SynthID": (r"synthid|generative.?ai.?(provenance|watermark)", "high", "synthetic_generation"),
    "C2PA Content Credentials": (r"c2pa\.org|c2pa\.claim_generator|content\s*credentials|contentauth", "high", "provenance"),
    "Adobe Photoshop": (r"photoshop|adobe\s*xmp\s*core|xmp:CreatorTool", "medium", "editing_transcode"),
    "Runway": (r"runwayml|runway[\s\-_]*gen[\s\-_]*\d", "high", "synthetic_generation"),
    "Pika": (r"pika[\s\-_]*labs|pika[\s\-_]*\d", "high", "synthetic_generation"),
    "OpenAI Sora / ChatGPT (literal)": (r"\bsora\s*(?:by\s*openai|video)?\b|chatgpt[^a-z]*(?:video|image|media|generation)|gpt[\-_]?image|gpt[\-_]?vision|made\s+(?:with|by)\s+chatgpt|generated\s+(?:with|by)\s+chatgpt", "high", "synthetic_generation"),
    "Luma Dream Machine": (r"luma\s*ai|dream\s*machine", "high", "synthetic_generation"),
    "FFmpeg / libavformat pipeline": (r"Lavf\d|Lavc\d|Lavu\d|Lavd\d|libavformat|libavcodec|libavutil|libavdevice|libswscale|libswresample|ffmpeg", "medium", "editing_transcode"),
    "x264 software encoder": (r"(?:^|[^A-Za-z])x264|libx264", "low", "editing_transcode"),
    "x265 / HEVC software encoder": (r"(?:^|[^A-Za-z])x265|libx265", "low", "editing_transcode"),
}
CAPTURE = r"(?i)com\.apple\.|com\.android\.|mdir|mdta|geID|\xa9cpy|\xa9nam|\xa9ART|\xa9day|\xa9alb|\xa9cmt|\xa9too|\xa9wrt|\xa9enc|\xa9gen|\xa9grp"
CONFIDENCE = {"high": 0.32, "medium": 0.18, "low": 0.08}
CATEGORY = {"synthetic_generation": 1.0, "tamper_smuggling": 1.0, "editing_transcode": 0.7, "structural": 0.6, "provenance": 0.25}
LOWER = {"high": "medium", "medium": "low", "low": "low"}


def sniff(content: Column) -> Column:
    """Format by magic bytes."""
    h = F.hex(F.substring(content, 1, 12))
    brand = F.substring(h, 17, 8)
    return (
        F.when(F.coalesce(F.octet_length(content), F.lit(0)) < 12, "unknown")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("52494646") & (brand == "57454250"), "webp")
        .when(h.startswith("474946"), "gif")
        .when(F.substring(h, 9, 8) == "66747970", F.when(brand.isin("68656963", "68656978", "6D696631"), "heic").when(brand == "61766966", "avif").when(brand == "71742020", "mov").otherwise("mp4"))
        .otherwise("unknown")
    )


class Facts:
    """What a reader found."""

    def __init__(self):
        self.keys, self.said, self.tools = [], [], []
        self.brand, self.status = None, "ok"
        self.video = self.audio = self.trailing = 0
        self.c2pa = self.xmp = self.synthid = self.jumbf = False

    def packet(self, text: str) -> None:
        """An XMP packet and the markers in it."""
        self.xmp = True
        self.said.append(text)
        self.c2pa |= bool(re.search(PROVENANCE, text, re.I))
        self.synthid |= "synthid" in text.lower()

    def row(self) -> dict:
        return {"keys": self.keys, "decoded": "\n".join(self.said)[:TEXT], "tools": self.tools, "brand": self.brand, "video_tracks": self.video, "audio_tracks": self.audio, "trailing": self.trailing, "c2pa": self.c2pa, "xmp": self.xmp, "synthid": self.synthid, "jumbf": self.jumbf, "status": self.status}


def _latin(b: bytes) -> str:
    return b.decode("latin-1")


def _png(data: bytes, f: Facts) -> None:
    at = 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 12 + n > len(data):
            break
        kind, body, at = data[at + 4 : at + 8], data[at + 8 : at + 8 + n], at + 12 + n
        if kind == b"IEND":
            break
        if kind in (b"iCCP", b"eXIf"):
            f.keys.append(kind.decode())
        elif kind in (b"tEXt", b"iTXt", b"zTXt"):
            word, _, rest = body.partition(b"\0")
            name = _latin(word)
            if name:
                f.keys.append(name)
            if kind == b"tEXt":
                f.said.append(f"{name}={_latin(rest)}")
            elif kind == b"iTXt":
                fields = rest[2:].split(b"\0", 2)
                if len(fields) == 3 and fields[2]:
                    f.said.append(f"{name}={_latin(fields[2])}")
            else:
                try:
                    f.said.append(f"{name}={_latin(zlib.decompressobj().decompress(rest[1:], INFLATED))}")
                except zlib.error:
                    f.said.append(f"{name}=<compressed>")
    f.trailing = len(data) - at


def _jpeg(data: bytes, f: Facts) -> None:
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xD9:
            f.trailing = len(data) - at - 2
            return
        if marker == 0xDA:  # coded data runs to the next real marker
            m = re.compile(rb"\xff[^\x00]", re.S).search(data, at + 2)
            at = m.start() if m else len(data)
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        if n < 2 or at + 2 + n > len(data):
            return
        body, at = data[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            f.keys.append("JPEG comment")
            f.said.append(_latin(body))
            continue
        name, _, rest = body.partition(b"\0")
        if marker == 0xE1 and name == b"Exif":
            f.keys.append("EXIF (APP1)")
        elif marker == 0xE1 and name.startswith((b"http://ns.adobe.com/xap/", b"http://ns.adobe.com/xmp/")):
            f.keys.append("XMP packet")
            f.packet(_latin(rest))
        elif marker == 0xEB and name == b"JP":
            f.jumbf = f.c2pa = True
            f.keys.append("APP11 JUMBF (C2PA)")
            f.said.append(_latin(rest[:BIT]))
        elif marker == 0xED and name == b"Photoshop 3.0":
            f.keys.append("APP13 Photoshop IRB")
            f.tools.append("Adobe Photoshop")
            f.said.append(_latin(rest[:BIT]))
        elif marker == 0xE2:
            f.keys.append("APP2")


def _boxes(data: bytes, f: Facts) -> None:
    stack, last, buried = [(0, len(data), 0)], 0, None
    while stack:
        at, end, depth = stack.pop()
        if at + 8 > end:
            continue
        size, kind, head = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1:
            size, head = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        open_ended = size == 0
        size = end - at if open_ended else size
        if size < head or at + size > end:
            continue
        body, stop = data[at + head : at + size], at + size
        stack.append((stop, end, depth))
        last = max(last, stop)
        if kind in BOXES_WITHIN:
            if depth < 8:
                stack.append((at + head, stop, depth + 1))
            continue
        if depth == 0 and open_ended and kind in FILLER:
            buried = at + head
        if kind == b"ftyp":
            f.brand = _latin(body[:4]).strip()
            f.keys.append(f"ftyp:{f.brand or 'unknown'}")
        elif kind == b"uuid":
            if body[:16] == C2PA_UUID:
                f.c2pa = f.jumbf = True
                f.keys.append("uuid box C2PA")
                f.said.append(_latin(body[16 : 16 + BIT]))
            else:
                f.keys.append("uuid box")
        elif kind == b"hdlr":
            f.video += body[8:12] == b"vide"
            f.audio += body[8:12] == b"soun"
            f.said.append(_latin(body[:HANDLER]))
        elif kind != b"mdat" and kind not in FILLER:
            f.said.append(_latin(body[:LEAF]))
    if buried is not None:
        f.trailing = len(data) - buried
    elif last:
        f.trailing = len(data) - last


def _webp(data: bytes, f: Facts) -> None:
    declared = 8 + int.from_bytes(data[4:8], "little")
    end = declared if 12 <= declared <= len(data) else len(data)
    at = 12
    if len(data) < 30:
        f.status = "malformed"
        return
    while at + 8 <= end:
        kind, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            f.status = "malformed"
            break
        body, at = data[at + 8 : at + 8 + n], at + 8 + n + n % 2
        if kind == b"EXIF":
            f.keys.append("EXIF chunk")
            f.said.append(_latin(body[:BIT]))
        elif kind == b"XMP ":
            f.keys.append("XMP chunk")
            f.packet(_latin(body[:BIT]))
        elif kind == b"ICCP":
            f.keys.append("ICCP color profile")
    if 12 <= declared < len(data):
        f.trailing = len(data) - declared


def _gif(data: bytes, f: Facts) -> None:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        f.status = "malformed"
        return
    table = lambda flags: 3 << (flags & 7) + 1 if flags & 0x80 else 0

    def run(at: int) -> tuple[bytes, int]:
        """Sub-blocks up to the empty one."""
        parts = []
        while at < len(data):
            n, at = data[at], at + 1
            if not n:
                break
            parts.append(data[at : at + n])
            at += n
        return b"".join(parts), at

    at = 13 + table(data[10])
    while at < len(data):
        if data[at] == 0x3B:
            f.trailing = len(data) - at - 1
            return
        if data[at] == 0x21 and at + 2 < len(data):
            label = data[at + 1]
            body, at = run(at + 2)
            if label in (0xFE, 0xFF):
                f.keys.append("GIF comment" if label == 0xFE else "GIF application extension")
                f.said.append(_latin(body))
        elif data[at] == 0x2C and at + 9 < len(data):
            _, at = run(at + 11 + table(data[at + 9]))
        else:
            f.status = "malformed"
            return


READERS = {"png": _png, "jpeg": _jpeg, "webp": _webp, "gif": _gif, "mp4": _boxes, "mov": _boxes, "heic": _boxes, "avif": _boxes}
SCHEMA = "keys array<string>, decoded string, tools array<string>, brand string, video_tracks long, audio_tracks long, trailing long, c2pa boolean, xmp boolean, synthid boolean, jumbf boolean, status string"


def read_media(kind: str, data: bytes | None) -> dict:
    """Facts of one file; never raises."""
    f = Facts()
    if kind not in READERS:
        f.status = "unsupported" if data else "empty"
        return f.row()
    try:
        READERS[kind](data, f)
    except Exception as e:  # noqa: BLE001  a damaged file costs only its row
        f = Facts()
        f.status = f"parser_error: {type(e).__name__}"
    return f.row()


def with_facts(df: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``format`` and ``facts``."""
    import pandas as pd

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def read(kind, data):
        return pd.DataFrame([read_media(k, d) for k, d in zip(kind, data)], columns=names)

    read.__annotations__ = {"kind": pd.Series, "data": pd.Series, "return": pd.DataFrame}
    df = df.withColumn("format", sniff(F.col(content_col)))
    return df.withColumn("facts", F.pandas_udf(read, SCHEMA)("format", content_col))


def _finding(when: Column, marker, confidence: str, category: str) -> Column:
    marker = F.lit(marker) if isinstance(marker, str) else marker
    return F.when(when, F.struct(marker.alias("marker"), F.lit(confidence).alias("confidence"), F.lit(category).alias("category")))


def score_of(findings: Column, format_: Column, keys: Column, tools: Column, size: Column) -> Column:
    pick = lambda t, c: F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in t.items() for x in kv)), c), F.lit(1.0 if t is CATEGORY else 0.0))
    total = F.aggregate(findings, F.lit(0.0), lambda a, x: a + pick(CONFIDENCE, x["confidence"]) * pick(CATEGORY, x["category"]))
    total = total + F.when((format_ == "png") & (F.size(keys) == 0), 0.04).otherwise(0.0)
    total = total + F.when(format_.isin("mp4", "mov") & (F.size(tools) == 0) & (size > 0), 0.04).otherwise(0.0)
    return F.round(F.least(total, F.lit(1.0)), 3)


def analyze_media(df: DataFrame, content_col: str = "content") -> DataFrame:
    """``df`` with format, facts, tools, findings, score and risk."""
    df = with_facts(df, content_col)
    x = lambda c: F.col(f"facts.{c}")
    seen = F.array_contains(x("tools"), "Adobe Photoshop")
    hit = {t: x("decoded").rlike(f"(?i){p}") for t, (p, _, _) in TOOLS.items()}
    named = [F.when(seen, F.lit("Adobe Photoshop"))] + [F.when(h & ~seen if t == "Adobe Photoshop" else h, F.lit(t)) for t, h in hit.items()]
    df = df.withColumn("tools", F.filter(F.array(*named), lambda t: t.isNotNull()))
    has = lambda *t: F.arrays_overlap("tools", F.array(*map(F.lit, t)))
    video = F.col("format").isin("mp4", "mov")
    silent = video & (x("video_tracks") >= 1) & (x("audio_tracks") == 0)
    ffmpeg, capture = has("FFmpeg / libavformat pipeline"), x("decoded").rlike(CAPTURE)
    encoder = has("x264 software encoder", "x265 / HEVC software encoder")
    size = F.coalesce(F.octet_length(content_col), F.lit(0)).cast("long")
    items = [
        _finding(x("c2pa"), "C2PA manifest", "medium", "provenance"),
        _finding(x("synthid"), "SynthID marker", "high", "synthetic_generation"),
        _finding(x("xmp") & ~x("c2pa"), "XMP packet", "medium", "provenance"),
        _finding(x("trailing") > 1024, F.concat(x("trailing").cast("string"), F.lit(" bytes after the media's end")), "medium", "tamper_smuggling"),
        _finding(seen, "Fingerprint: Adobe Photoshop", "high", "editing_transcode"),
        *(_finding(h & ~seen if t == "Adobe Photoshop" else h, f"Fingerprint: {t}", TOOLS[t][1], TOOLS[t][2]) for t, h in hit.items()),
        _finding(silent & ffmpeg & ~capture, "Silent, written by FFmpeg, no capture metadata", "high", "synthetic_generation"),
        _finding(silent & ffmpeg & capture, "Silent and written by FFmpeg", "medium", "editing_transcode"),
        _finding(video & ~silent & ffmpeg & ~capture, "Written by FFmpeg, no capture metadata", "medium", "editing_transcode"),
        _finding(video & (x("brand") == "qt") & ffmpeg & ~capture, "QuickTime container written by FFmpeg", "low", "editing_transcode"),
        _finding(silent & encoder & ~ffmpeg, "Silent, software encoder", "low", "editing_transcode"),
        _finding(silent & ffmpeg, "No audio track", "medium", "structural"),
        _finding(silent & ~ffmpeg, "No audio track", "low", "structural"),
    ]
    df = df.withColumn("findings", F.filter(F.array(*items), lambda i: i.isNotNull()))
    score = score_of(F.col("findings"), F.col("format"), x("keys"), F.col("tools"), size)
    df = df.withColumns({"byte_size": size, "score": score})
    return df.withColumn("risk", F.when(F.col("score") >= 0.60, "high").when(F.col("score") >= 0.30, "moderate").otherwise("low"))


def fuse_vision(df: DataFrame) -> DataFrame:
    """Fold a judgement column ``vision`` (verdict, confidence) into findings and score.

    Only the verdict ``ai`` adds a finding, its confidence lowered a notch.
    """
    low = F.try_element_at(F.create_map(*(F.lit(v) for kv in LOWER.items() for v in kv)), F.col("vision.confidence"))
    extra = F.array(F.struct(F.lit("Vision model: looks generated").alias("marker"), F.coalesce(low, F.lit("low")).alias("confidence"), F.lit("synthetic_generation").alias("category")))
    says = F.lower("vision.verdict") == "ai"
    df = df.withColumn("findings", F.when(says, F.concat("findings", extra)).otherwise(F.col("findings")))
    df = df.withColumn("score", score_of(F.col("findings"), F.col("format"), F.col("facts.keys"), F.col("tools"), F.col("byte_size")))
    return df.withColumn("risk", F.when(F.col("score") >= 0.60, "high").when(F.col("score") >= 0.30, "moderate").otherwise("low"))
