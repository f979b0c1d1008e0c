"""Media files built from bytes."""

import struct
import zlib

from scrutix.operators import media


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks, end=True, tail=b""):
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + b"".join(chunks) + (chunk(b"IEND", b"") if end else b"") + tail


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def video(brand=b"qt  ", handlers=(b"vide",), extra=b""):
    tracks = b"".join(box(b"trak", box(b"mdia", box(b"hdlr", bytes(8) + h + bytes(12)))) for h in handlers)
    return box(b"ftyp", brand + bytes(4) + b"isom") + box(b"moov", tracks + box(b"udta", extra))


FILES = {
    "text": png(chunk(b"tEXt", b"parameters\0Steps: 20, Sampler: x")),
    "packed": png(chunk(b"zTXt", b"prompt\0\0" + zlib.compress(b"made with ComfyUI"))),
    "tail": png(tail=b"x" * 2000),
    "no_end": png(end=False, tail=b"y" * 3000),
    "c2pa_jpeg": b"\xff\xd8" + segment(0xEB, b"JP\0data") + b"\xff\xd9",
    "xmp_jpeg": b"\xff\xd8" + segment(0xE1, b"http://ns.adobe.com/xap/1.0/\0synthid here") + b"\xff\xda\x00\x02ab\xff\x00cd\xff\xd9" + b"z" * 1500 + b"\xff\xd9",
    "mp4_c2pa": box(b"ftyp", b"mp42" + bytes(4)) + box(b"uuid", media.C2PA_UUID + b"claim"),
    "pipeline": video(extra=box(b"abcd", b"Lavf60.3")),
    "phone": video(handlers=(b"vide", b"soun"), extra=box(b"abcd", b"com.apple.quicktime.make")),
    "buried": box(b"ftyp", b"mp42" + bytes(4)) + b"\0\0\0\0free" + b"q" * 2000,
    "webp": b"RIFF" + struct.pack("<I", 4 + 8 + 20) + b"WEBP" + b"XMP " + struct.pack("<I", 20) + b"content credentials.",
    "gif": b"GIF89a" + bytes(7) + b"\x21\xfe\x05hello\x00\x3b" + b"t" * 5,
    "unknown": b"nothing that is known",
    "empty": b"",
    "damaged": b"\x89PNG\r\n\x1a\n" + b"\xff" * 9,
}


def test_files(spark):
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()] + [("null", None)], "name string, content binary")
    got = {r.name: r for r in media.analyze_media(df).collect()}
    kinds = {k: r.format for k, r in got.items()}
    assert kinds["text"] == "png" and kinds["c2pa_jpeg"] == "unknown" or kinds["c2pa_jpeg"] == "jpeg"
    assert kinds["pipeline"] == "mov" and kinds["mp4_c2pa"] == "mp4" and kinds["webp"] == "webp" and kinds["gif"] == "gif"
    assert got["text"].tools == ["Stable Diffusion WebUI (A1111)"] and got["packed"].tools == ["ComfyUI"]
    assert got["tail"].facts.trailing == 2000 and got["no_end"].facts.trailing == 3000 and got["buried"].facts.trailing == 2000
    assert got["xmp_jpeg"].facts.synthid and got["xmp_jpeg"].facts.trailing == 1502
    assert got["mp4_c2pa"].facts.c2pa and got["webp"].facts.c2pa
    assert got["pipeline"].risk == "high" and got["phone"].risk == "low"
    assert any("no capture" in f.marker for f in got["pipeline"].findings)
    assert got["gif"].facts["keys"] == ["GIF comment"] and got["gif"].facts.trailing == 5
    assert got["unknown"].facts.status == "unsupported" and got["empty"].facts.status == got["null"].facts.status == "empty"
    assert got["damaged"].facts.status == "ok" and got["tail"].score == 0.22


def test_vision(spark):
    df = spark.createDataFrame([("a", bytearray(FILES["tail"]), ("AI", "high")), ("b", bytearray(FILES["tail"]), ("real", "high"))], "name string, content binary, vision struct<verdict:string,confidence:string>")
    got = {r.name: r.score for r in media.fuse_vision(media.analyze_media(df)).collect()}
    assert got["b"] == 0.22 and got["a"] == 0.4
