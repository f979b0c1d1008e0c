"""The ten operators against brute force, exact round trips and awkward tables."""

import hashlib
import itertools
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrutix.llm import chat, cnn, embeddings, mixing, packing, pii, setsketch, urls, warc
from scrutix.llm import matroska as mk
from scrutix.llm.common import materialize
from scrutix.llm.graph import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
LONG = "long words go on " * 20_000


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 1, 0.5, "k") for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and clashing extra columns."""
    rows = [(None, "no id here at all", "en", None, 1, 0.5, "k"), (1, None, None, "s", 1, 0.5, "k"), (2, "", "en", "s", 0, 0.5, "k"), (3, "one", "en", "s", 3, 0.5, "k"), (3, "one", "en", "s", 3, 0.5, "k"), (4, LONG, "en", "t", 1, 0.5, "k"), (5, "tab\tand 日本語 a@b.co", "en", "t", 1, 0.5, "k")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- 2 -----------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 63, 64, 8192, 8193, 200_000])
def test_matroska_round_trip(n):
    size, payload = mk.payload_of("é" * n)
    media = mk.mux(payload)
    found = mk.demux(media)
    assert found["status"] == "ok" and size == 2 * n and len(payload) % 64 == 0
    assert b"".join(media[p[2] : p[2] + p[3]] for p in found["packets"]) == payload
    starts = [p[1] for p in found["packets"]]
    assert starts == sorted(starts) and len({p[5] for p in found["packets"]}) == len(found["cues"])


@pytest.mark.parametrize("mode", [1, 2, 3])
def test_lacing_modes(mode):
    random.seed(mode)
    for _ in range(50):
        frames = [bytes([i]) * (300 if mode == 2 else random.choice([0, 1, 254, 255, 256, 700, 20_000])) for i in range(random.randint(2, 9))]
        flags, body = mk.lace(frames, mode)
        block = b"\x81" + struct.pack(">hB", -3, 0x80 | flags) + body
        track, rel, key, ranges = mk.block_frames(block, 0, len(block))
        assert (track, rel, key) == (1, -3, True) and [block[o : o + s] for o, s in ranges] == frames


def test_matroska_unknown_sizes_and_damage():
    payload = mk.payload_of("x" * 5000)[1]
    media = mk.mux(payload)
    at = media.index(mk.CLUSTER.to_bytes(4, "big"))
    n = 9 - media[at + 4].bit_length()
    live = media[: at + 4] + b"\x01" + b"\xff" * 7 + media[at + 4 + n :]
    segment = live.index(mk.SEGMENT.to_bytes(4, "big")) + 4
    width = 9 - live[segment].bit_length()
    live = live[:segment] + b"\x01" + b"\xff" * 7 + live[segment + width :]
    found = mk.demux(live)
    assert found["status"] == "ok" and b"".join(live[p[2] : p[2] + p[3]] for p in found["packets"]) == payload
    cut = mk.demux(media[: len(media) // 2])
    assert cut["status"].startswith("malformed")
    for junk in (b"", b"abc", media[:9], b"\x1a\x45\xdf\xa3\x00"):
        assert mk.demux(junk)["status"] != "ok"


def _file(tracks, clusters, cues=b""):
    """A file from track entries and clusters (of elements) of a test's own."""
    head = mk.element(mk.EBML, mk.element(0x4282, b"matroska"))
    parts = [mk.element(mk.INFO, mk.uint(mk.TIMESTAMP_SCALE, 1_000_000)), mk.element(mk.TRACKS, b"".join(mk.element(mk.TRACK_ENTRY, t) for t in tracks))]
    places = []
    for c in clusters:
        places.append(sum(map(len, parts)))
        parts.append(mk.element(mk.CLUSTER, c))
    parts.append(mk.element(mk.CUES, cues(places) if callable(cues) else cues))
    return head + mk.element(mk.SEGMENT, b"".join(parts))


def _block(track, rel, frames, mode=0, flags=0):
    laced, body = mk.lace(frames, mode)
    return mk.vint(track) + struct.pack(">hB", rel, flags | laced) + body


def test_matroska_tracks_groups_and_cues():
    audio = mk.uint(mk.TRACK_NUMBER, 1) + mk.element(mk.CODEC_ID, b"A_PCM/INT/LIT") + mk.element(mk.AUDIO, mk.element(mk.SAMPLE_RATE, struct.pack(">d", 8000)) + mk.uint(mk.CHANNELS, 2) + mk.uint(mk.BIT_DEPTH, 16))
    video = mk.uint(mk.TRACK_NUMBER, 2) + mk.element(mk.CODEC_ID, b"V_VP8") + mk.uint(mk.DEFAULT_DURATION, 40_000_000)
    stripped = mk.element(mk.COMPRESSION, mk.uint(mk.COMPRESSION_ALGORITHM, 3) + mk.element(mk.COMPRESSION_SETTINGS, b"HD"))
    text = mk.uint(mk.TRACK_NUMBER, 3) + mk.element(mk.CODEC_ID, b"S_TEXT") + mk.element(mk.ENCODINGS, mk.element(mk.ENCODING, stripped))
    zipped = mk.uint(mk.TRACK_NUMBER, 4) + mk.element(mk.ENCODINGS, mk.element(mk.ENCODING, mk.element(mk.COMPRESSION, mk.uint(mk.COMPRESSION_ALGORITHM, 0))))
    time = mk.uint(mk.TIMESTAMP, 500)
    blocks = [
        mk.element(mk.SIMPLE_BLOCK, _block(1, 0, [b"ab" * 16] * 3, 2, 0x80)),
        mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, _block(2, 10, [b"K", b"LL"], 3))),
        mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, _block(2, 90, [b"P"], flags=0x80)) + mk.element(mk.REFERENCE_BLOCK, b"\xff")),
        mk.element(mk.BLOCK_GROUP, mk.element(mk.REFERENCE_BLOCK, b"\xff") + mk.element(mk.BLOCK, _block(3, 100, [b"x", b"yy"], 1)) + mk.uint(mk.BLOCK_DURATION, 60)),
        mk.element(mk.SIMPLE_BLOCK, _block(4, 120, [zlib.compress(b"zz")])),
    ]
    at = [len(time) + sum(map(len, blocks[:n])) for n in range(len(blocks))]
    point = lambda t, track, cluster, block=None: mk.element(mk.CUE_POINT, mk.uint(mk.CUE_TIME, t) + mk.element(mk.CUE_POSITIONS, mk.uint(mk.CUE_TRACK, track) + mk.uint(mk.CUE_CLUSTER, cluster) + (b"" if block is None else mk.uint(mk.CUE_RELATIVE, block))))
    cues = lambda p: point(500, 1, p[0]) + point(510, 2, p[0], at[1]) + point(590, 2, p[0], at[1]) + point(500, 3, p[0])
    data = _file([audio, video, text, zipped], [time + b"".join(blocks)], cues)
    found = mk.demux(data)
    assert found["status"] == "ok" and found["bad_cues"] == 2  # a wrong time, a wrong track
    got = [(p[0], p[1] // 1000, p[4], p[6], mk.frame_of(data, p, found["tracks"])) for p in found["packets"]]
    assert got == [(1, 500_000 + 1_000 * n, True, n, b"ab" * 16) for n in range(3)] + [(2, 510_000, True, 0, b"K"), (2, 550_000, True, 1, b"LL"), (2, 590_000, False, 0, b"P"), (3, 600_000, False, 0, b"HDx"), (3, 630_000, False, 1, b"HDyy"), (4, 620_000, False, 0, b"zz")]
    assert mk.demux(mk.mux(mk.payload_of("x" * 300_000)[1]))["bad_cues"] == 0


def test_op2_on_odd_rows(spark, odd):
    rows = {(r.doc_id, r.n_bytes): r for r in mk.op2_matroska(odd).collect()}
    assert rows[(1, 0)].payload_bytes == 64 and rows[(1, 0)].payload_sha256 == hashlib.sha256(bytes(64)).hexdigest()
    raw = LONG.encode()
    padded = raw + bytes(-len(raw) % 64)
    assert rows[(4, len(raw))].payload_sha256 == hashlib.sha256(padded).hexdigest() and rows[(4, len(raw))].tail_crc32 == zlib.crc32(padded[-64:])
    assert mk.op2_matroska(empty(spark)).count() == 0
    packets = mk.packet_table(mk.store(odd))
    assert packets.filter("status <> 'ok'").count() == 0 and packets.filter("doc_id = 4").agg(F.sum("size")).first()[0] == len(padded)


# --- 3 -----------------------------------------------------------------------


def brute_url(url):
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", "", None, None
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for verdict, rule in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best and best[1], best and best[0]


def test_op3_against_brute_force(spark):
    cases = [None, "", "no scheme", "http://EXAMPLE.com/en/x?q#f", "http://www.example.com/en/1", "http://xexample.com/en/", "http://a.net/es/", "http://a.net/es", "http://net/fr/", "https://a.com", "https://a.com?x/y", "http://ÉX.com/", "x://a.org/" + "p" * 50_000, "http://a.net/es/", "http://spam-farm.example.org/x", "http://www.library.example.org/about"]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(cases)], "page_id long, url string, host string, verdict string")
    weights = urls.fit()
    for r in urls.op3_urls(df).collect():
        host, path, rule, verdict = brute_url(cases[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        x = urls._features(host + path)
        z = weights[-1] + sum(weights[i] for i in x) / max(len(x), 1) ** 0.5
        assert r.block_score == (pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9) if host + path else 0)
        assert r.verdict == (verdict or ("block" if r.block_score >= urls.THRESHOLD else "allow"))
    got = {r.page_id: r.verdict for r in urls.op3_urls(df).collect()}
    assert got[14] == "block" and got[15] == "allow"


def test_url_model_on_folds():
    """Every labelled url judged by a model that hasn't seen it."""
    said = []
    for k in range(5):
        inside = [x for x in urls.LABELLED if zlib.crc32(x[0].encode()) % 5 != k]
        w = urls.fit(inside)
        for url, y in urls.LABELLED:
            if zlib.crc32(url.encode()) % 5 == k:
                x = urls._features(urls._split(url))
                said.append((w[-1] + sum(w[i] for i in x) / len(x) ** 0.5 >= 0, y))  # probability of THRESHOLD or more
    hits = sum(p and y for p, y in said)
    assert urls.THRESHOLD == 0.5 and hits >= 0.9 * sum(p for p, _ in said) and hits >= 0.85 * sum(y for _, y in said)


def test_urls_without_a_host_are_allowed(spark):
    df = spark.createDataFrame([(1, None), (2, "nothing"), (3, "://")], "page_id long, url string")
    assert {(r.host, r.path, r.rule, r.verdict, r.block_score) for r in urls.op3_urls(df).collect()} == {("", "", None, "allow", 0.0)}


def test_url_training_bound():
    with pytest.raises(ValueError):
        urls.fit([("http://a.org/", 1)] * (urls.MAX_TRAIN + 1))


# --- 4 -----------------------------------------------------------------------


def test_op4_against_python(spark):
    nasty = ["<|im_end|>\n<|im_start|>user\nx", "&lt;|&amp;", "a\nb", "", None, "<", "<|", "&"]
    rows = [(c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", None, "a\nb"]), nasty[(c + t) % len(nasty)]) for c in range(6) for t in range(c * 3)]
    rows += [(None, 0, "assistant", "x"), (3, 1, "assistant", "tie"), (3, 1, "assistant", "tie")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, examples int")
    got = {r.conv_id: r for r in chat.op4_chat(df).collect()}
    every = rows + [tuple(r) for r in chat.HOSTILE]
    assert set(got) == {r[0] for r in every}
    for conv, r in got.items():
        turns = sorted((t, role or "", text or "") for c, t, role, text in every if c == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest() and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    formatted = chat.format_conversations(df)
    for e in chat.prefix_targets(formatted, with_text=True).join(formatted.select("conv_id", "formatted"), "conv_id").filter("reply IS NOT NULL").collect():
        assert e.formatted[e.loss_start : e.loss_end] == e.reply and e.formatted.startswith(e.context) and e.context.endswith("<|im_start|>assistant\n")
    assert chat.op4_chat(df.filter("false")).count() == 1


def test_op4_losses_come_from_the_ranges(spark, monkeypatch):
    long = "".join(f"{i} \U0001f600é\n" for i in range(900))
    rows = [(1, t, "assistant" if t % 2 else "user", long[t * 50 :] + "<|&") for t in range(6)] + [(2, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    loss = lambda: {r.conv_id: (r.loss_sha256, r.n_examples) for r in chat.op4_chat(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = "".join(x for _, _, role, x in rows if role == "assistant")
    assert loss() == {1: (sha(said), 3), 2: (sha(""), 0), -1: (sha(chat.HOSTILE[1][3]), 1)}
    right = chat.format_conversations
    wrong = lambda t: right(t).withColumn("examples", F.transform("examples", lambda e: e.withField("loss_start", e["loss_start"] + 1)))
    monkeypatch.setattr(chat, "format_conversations", wrong)
    assert loss()[1] == (sha("".join(x[1:] for _, _, role, x in rows if role == "assistant")), 3)


# --- 5 -----------------------------------------------------------------------


def test_op5_against_python(spark):
    htmls = ["<a>", "", None, "<a>", "\r\n\r\nWARC/1.1", "é" * 70_000, "<a>", ""]
    rows = [(9 - i, f"http://x/{i}\r\n", h, "z") for i, h in enumerate(htmls)] + [(None, None, "<a>", "z"), (50, "u", "<a>", "z"), (50, "u", "<a>", "z")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = warc.op5_warc(df).collect()
    assert len(got) == len(rows)
    first: dict = {}
    for p, _, h, _ in rows:
        first.setdefault(h or "", []).append((p is None, p or 0))
    for r in got:
        payload = next((h or "") for p, _, h, _ in rows if p == r.page_id and warc.digest_of((h or "").encode()) == r.payload_digest)
        smallest = min(first[payload])[1]
        assert r.payload_bytes == len(payload.encode())
        assert (r.record_type, r.refers_to) in ((("response", None),) if r.page_id == smallest else (("revisit", smallest),))
    assert sum(r.record_type == "response" for r in got) == len(first)
    assert warc.op5_warc(df.filter("false")).count() == 0


def test_deduplicate_keeps_revisits(spark):
    columns = ["page_id", "record_type", "payload_bytes", "payload_digest", "record_id", "refers_to", "refers_to_record"]
    seen = lambda a: sorted((tuple(r) for r in warc.read_headers(a).select(*columns).collect()), key=str)
    pages = spark.createDataFrame([(i, "u", "<a>" if i % 2 else f"<b{i}>") for i in range(8)], "page_id long, url string, html string")
    once = materialize(warc.deduplicate(warc.write_archives(pages)), "test-warc")
    assert seen(warc.deduplicate(once)) == seen(once) == seen(warc.deduplicate(once, min_bytes=100))
    d, lost = warc.digest_of(b"<a>"), warc.digest_of(b"gone")
    parts = [("revisit", 1, b"", 3, d, {"page_id": 5, "record_id": "<urn:x>"}), ("response", 5, b"<a>", 3, d, None), ("response", 6, b"<a>", 3, d, None), ("revisit", 2, b"", 4, lost, {"page_id": 9, "record_id": "<urn:gone>"}), ("revisit", 3, b"", 4, lost, None)]
    content = b"".join(warc.record(k, p, "u", x, n, g, to) for k, p, x, n, g, to in parts)
    fresh = warc.deduplicate(spark.createDataFrame([(0, 5, bytearray(content))], "archive long, n_records long, content binary"))
    got = {r.page_id: r for r in warc.read_headers(fresh).collect()}
    assert {p: (r.record_type, r.payload_bytes, r.refers_to) for p, r in got.items()} == {1: ("revisit", 3, 5), 5: ("response", 3, None), 6: ("revisit", 3, 5), 2: ("revisit", 4, 9), 3: ("revisit", 4, None)}
    assert got[1].refers_to_record == got[5].record_id and got[2].refers_to_record == "<urn:gone>"


# --- 6 -----------------------------------------------------------------------


def brute_near(texts, k, percent):
    words = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
    sets = [({tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k))))) if w else set() for w in words]
    comp = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((comp[i], comp[j]))
            comp = [a if c == b else c for c in comp]
    return [len(s) for s in sets], comp


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_against_brute_force(spark, k):
    r = random.Random(k)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(r.randrange(40)) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \t", "one", "ONE", "two words", "Two\tWords", "É", "é"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(r.randrange(9)):
                w[r.randrange(len(w))] = f"new{r.randrange(1000)}"
            texts += [" ".join(w)] * r.choice([1, 1, 3])
    sizes, comp = brute_near(texts, k, 80)
    for row in setsketch.near_duplicates(docs(spark, texts), k, 80).collect():
        assert (row.n_shingles, row.component_id, row.kept) == (sizes[row.doc_id], comp[row.doc_id], comp[row.doc_id] == row.doc_id)


@pytest.mark.parametrize("group", [1, 1 << 16])
def test_open_buckets_are_compared_exactly(spark, group):
    """A group of near copies around the threshold in small tiles, grouped by component and by bucket."""
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for _ in range(90):
        w = list(base)
        for _ in range(r.randrange(3, 12)):
            w[r.randrange(len(w))] = f"n{r.randrange(400)}"
        texts.append(" ".join(w))
    _, comp = brute_near(texts, 2, 80)
    old = setsketch.TILE, setsketch.GROUP
    setsketch.TILE, setsketch.GROUP = 16, group
    try:
        got = {x.doc_id: x.component_id for x in setsketch.near_duplicates(docs(spark, texts), 2, 80).collect()}
    finally:
        setsketch.TILE, setsketch.GROUP = old
    assert [got[i] for i in range(len(texts))] == comp


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = setsketch.near_duplicates(odd, 2, 80).collect()
    assert len(rows) == 7 and sum(r.doc_id is None and r.component_id is None and r.kept for r in rows) == 1
    assert setsketch.near_duplicates(empty(spark), 2, 80).count() == 0


def test_estimates_follow_similarity():
    for inter in (100, 400, 500):
        rng = np.random.default_rng(inter)
        h = rng.integers(0, 1 << 63, 1000 - inter + 500).astype(np.uint64)
        a, b = np.unique(h[:500]), np.unique(h[500 - inter : 1000 - inter])
        x, y = (np.frombuffer(setsketch.registers(s), np.uint8) for s in (a, b))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        got = setsketch.estimate(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(got - j) < 0.09
        both = np.frombuffer(setsketch.registers(np.union1d(a, b)), np.uint8)
        assert (both == np.maximum(x, y)).all()  # sketches merge by the larger register


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 140)] + [(1, 5), (5, 9), (9, 2), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 141)) and {got[i] for i in (1, 2, 5, 9)} == {1}


# --- 7 -----------------------------------------------------------------------


def test_network_learns_and_covers_the_document(spark):
    r = random.Random(5)
    clean = lambda: " ".join(r.choice("the house stood by a river and people walked there".split()) for _ in range(r.randrange(30, 200))) + "."
    junk = lambda: " ".join(w + r.choice(["$$$", "###", "%%%"]) for w in clean().split())
    texts, labels = [], []
    for _ in range(150):
        texts += [clean(), junk()]
        labels += [1, 0]
    net = cnn.train(texts, labels, epochs=4)
    right = sum((net.score(t) >= cnn.THRESHOLD) == bool(y) for t, y in [(clean(), 1) for _ in range(60)] + [(junk(), 0) for _ in range(60)])
    assert right >= 114
    assert net.score(clean() * 50 + junk() * 3) < net.score(clean() * 50)  # junk at the very end counts
    n = cnn.windows(b"x" * 1003)[2]
    assert (n - 1) * cnn.STRIDE + cnn.WIDTH >= 1003
    old, cnn.PIECE = cnn.PIECE, cnn.CHUNK * 2
    try:
        pieces = net.score(clean() * 40)
    finally:
        cnn.PIECE = old
    assert 0 <= pieces <= 1
    assert 0 <= net.score(None) == net.score("") <= 1
    assert cnn.train([], []).score("x") == 0.5 and cnn.train(["a"], [1]).score("x") == 1.0


def _score_by_hand(net, raw):
    """The network in plain loops: filters, means of overlapping chunks, units, the maximum, one probability."""
    n = max(1, -(-max(len(raw) - cnn.WIDTH, 0) // cnn.STRIDE) + 1)
    x = list(raw) + [cnn.PAD] * ((n - 1) * cnn.STRIDE + cnn.WIDTH - len(raw))
    again, word, last, at = [0.0] * len(x), [], None, 0
    for m in re.finditer(rb"[^\x09-\x0d\x20]+", raw):
        end = next((k.start() for k in re.finditer(rb"[^\x09-\x0d\x20]+", raw) if k.start() > m.start()), len(x))
        for i in range(m.start(), end):
            again[i] = float(m.group() == last)
        last = m.group()
    responses = []
    for w in range(n):
        z = net.bias.astype(float) + sum(net.table[k][x[w * cnn.STRIDE + k]].astype(float) for k in range(cnn.WIDTH))
        z = z + (again[w * cnn.STRIDE] + again[w * cnn.STRIDE + cnn.WIDTH - 1]) * net.repeat
        responses.append(np.maximum(z, 0))
    half = cnn.CHUNK // 2
    starts = range(0, max(1, n - half if n > half else 1), half)
    chunks = [np.mean(responses[s : s + cnn.CHUNK], axis=0) for s in starts]
    top = np.max([np.maximum(c @ net.mix + net.shift, 0) for c in chunks], axis=0)
    return 1 / (1 + np.exp(-(top @ net.dense + net.out[0])))


def test_network_against_plain_loops(monkeypatch):
    r = random.Random(9)
    net = cnn.Net(3)
    net.bias += 0.1
    for n in (0, 1, 7, 8, 9, 12, 260, 300, 1030, 5000):
        text = "".join(r.choice("ab é\n") for _ in range(n))
        assert net.score(text) == pytest.approx(_score_by_hand(net, text.encode()), abs=1e-5), n
        with monkeypatch.context() as m:
            m.setattr(cnn, "PIECE", cnn.CHUNK)
            assert net.score(text) == pytest.approx(_score_by_hand(net, text.encode()), abs=1e-5), n


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    documents, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    out = cnn.op7_quality(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in out) >= 0.9 * len(out)


def test_op7_on_odd_rows(spark, odd):
    labels = spark.createDataFrame([(3, 1, 0), (5, 0, None), (None, 1, 1), (4, None, 1)], "doc_id long, quality int, toxic int")
    rows = cnn.op7_quality(odd, labels).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert cnn.op7_quality(empty(spark), labels.filter("false")).count() == 0
    assert cnn.classify(odd, cnn.fit(odd, labels)).columns.count("score") == 1


# --- 8 -----------------------------------------------------------------------


def test_encoder_equals_the_tokenizer():
    e = packing.encoder()
    r = random.Random(8)
    alphabet = ["a", "B", " ", "\n", "é", "日", "'", "'s", "1", "!", "\t", "\x1c", " ", "word", "<|endoftext|>", "😀"]
    for _ in range(400):
        t = "".join(r.choice(alphabet) for _ in range(r.randrange(60)))
        assert e.encode(t).tolist() == e.full.encode(t, add_special_tokens=False).ids
    old, packing.LONG_TEXT = packing.LONG_TEXT, 100
    try:
        assert e.encode(LONG[:5000]).tolist() == e.full.encode(LONG[:5000], add_special_tokens=False).ids
    finally:
        packing.LONG_TEXT = old


def test_packing_is_whole_and_tight(spark, odd):
    r = random.Random(2)
    texts = [" ".join("w" + str(r.randrange(99)) for _ in range(r.choice([3, 80, 200, 700, 3000]))) for _ in range(300)]
    df = docs(spark, texts).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 1000))
    rows = packing.pack(df.repartition(3), with_ids=True).collect()
    e = packing.encoder()
    by: dict = {}
    seq: dict = {}
    for x in rows:
        by.setdefault(x.doc_id, []).append(x)
        seq.setdefault(x.sequence_id, []).append(x)
        assert x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) and len(x.ids) == x.length
    for i, t in enumerate(texts):
        pieces = sorted(by[i], key=lambda x: x.start)
        assert [k for x in pieces for k in x.ids] == [*e.full.encode(t, add_special_tokens=False).ids, 0]
        assert all(x.start == sum(y.length for y in pieces[:n]) for n, x in enumerate(pieces))
    assert by[1001][0].doc_tokens == 1 and len(by[1003]) == 2 and None in by
    groups: dict = {}
    for k, v in seq.items():
        v.sort(key=lambda x: x.offset)
        n = sum(x.length for x in v)
        assert n <= 1024 and n & (n - 1) == 0 and all(x.offset == sum(y.length for y in v[:i]) for i, x in enumerate(v))
        groups[v[0].step_group] = groups.get(v[0].step_group, 0) + n
    assert sum(g == packing.STEP_TOKENS for g in groups.values()) >= len(groups) - 3 and max(groups.values()) <= packing.STEP_TOKENS
    assert packing.pack(empty(spark)).count() == 0


# --- 9 -----------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    def ok(kind, x):
        d = re.sub("[^0-9]", "", x)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 16 <= len(d) <= 19 and pii._luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text or "") if ok(k, m.group())]


def test_op9_base_spans_against_brute_force(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aB9.@-+ 1()2345%_é\n") for _ in range(r.randrange(150))) for _ in range(600)]
    texts += [None, "", "1" * 20_000, "1 " * 10_000, "a" * 50_000, "a@b.c_x@d.e 1.2.3.4.5.6.7.8 +1 (743) 555-3824 4111 1111 1111 1111", 'call (555) 201-3344 or token = "2321bac4d15ec8f90433"']
    for row in pii.op9_pii(docs(spark, texts)).collect():
        want = base_spans(texts[row.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert row.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == tuple(sum(w[0] == k for w in want) for k in BASE)
        assert set(filter(None, joined.split(","))) <= set(row.spans.split(","))
    last = [x.split(":")[0] for x in row.spans.split(",")] if row.doc_id == len(texts) - 1 else None
    assert last is None or last == ["phone", "secret"]


def test_trees_agree_in_sql_and_python(spark):
    m = pii.model()
    rows = [e for e in pii.examples(held_out=True) if e[0] != "secret" or e[3] != "."][::2]  # a value holds dots
    texts = [left + span + right for _, left, span, right, _ in rows]
    found = {r.doc_id: r for r in pii.find_spans(docs(spark, texts)).collect()}
    for i, (g, left, span, right, _) in enumerate(rows):
        kind = pii.GENERATORS[g][0]
        got = {tuple(s) for s in found[i][f"added_{kind}"]}
        base = [tuple(s) for k in pii.BASE for s in found[i][f"base_{k}"]]
        here = (len(left), len(left) + len(span))
        wanted = m.probability(pii.features_of(g, left, span, right)) >= m.thresholds[kind]
        if not any(a < here[1] and here[0] < b for a, b in base):
            assert (here in got) == wanted or not wanted and not got, (rows[i], got)
        assert not any(a < y and x < b for a, b in base for x, y in got)


def test_held_out_personal_data():
    """Precision and recall a generator on words and spans that training hasn't seen."""
    m = pii.model()
    for g, (kind, _, _) in pii.GENERATORS.items():
        said = [(m.probability(pii.features_of(*e[:4])) >= m.thresholds[kind], e[4]) for e in pii.examples(held_out=True) if e[0] == g]
        hits = sum(p and y for p, y in said)
        assert hits >= 0.9 * sum(p for p, _ in said) and hits >= 0.8 * sum(y for _, y in said), g


def test_overlapping_candidates(spark):
    texts = ["pay with card 4000 1234 5678 9010 now", "call 555-201-3344 or ring 020 7946 0958", "iban DE89 3704 0044 0532 0130 00", "token=call555-201-3344x", "amex card 3782 822463 10005"]
    for r in pii.find_spans(docs(spark, texts)).collect():
        spans = sorted(tuple(s) for k in pii.KINDS for s in (*r[f"added_{k}"], *(r[f"base_{k}"] if k in pii.BASE else ())))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:])), (r.text, spans)
        if r.doc_id == 1:
            assert [tuple(s) for s in r.added_phone] == [(5, 17), (26, 39)]
        if r.doc_id == 4:
            assert [tuple(s) for s in r.added_card] == [(10, 27)]


def test_personal_data_with_clashing_names(spark):
    names = ["ssn_m", "_r", "_row", "_text", "b_email_m", "base_email", "email_words_g", "start", "_added"]
    df = spark.createDataFrame([(1, "a.b@c.de x", *("keep",) * len(names))], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    r = pii.redact(df)
    assert r.columns == df.columns and tuple(r.first()) == (1, "[EMAIL] x", *("keep",) * len(names))
    s = pii.find_spans(df)
    assert s.columns[: len(names) + 1] == [c for c in df.columns if c != "base_email"] and [tuple(x) for x in s.first().base_email] == [(0, 8)]
    assert pii.redact(df.filter("false")).count() == 0


def test_redaction_leaves_no_base_span(spark, odd):
    texts = ["a.b@c.de and 1.2.3.4", "clean text, 12 apples", None, 'password: "hunter2hunter2"']
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts)).collect()}
    assert out == {0: "[EMAIL] and [IP]", 1: texts[1], 2: None, 3: "[SECRET]"}
    assert pii.redact(odd).count() == 7 and pii.redact(odd).columns == odd.columns and pii.op9_pii(empty(spark)).count() == 0


def test_secrets_are_taken_whole(spark):
    values = [('"', "aB3_" * 75), ("", "aB3.xY7-" * 40), ("", "hunter22!rest"), ("", "p4ss(w0rd),[x]{y};z'é9"), ("", "9!" * 50_000), ("", "a1b2c3d4" + ")" * 50_000 + "e5"), ("", "a1b2c3d4e5" + "),;" * 50_000)]
    whole = [f"api_key={q}{v.rstrip('),;')}{q}" for q, v in values]
    texts = [f"config {w}{v[len(v.rstrip('),;')):]} end" for w, (_, v) in zip(whole, values)]
    for r in pii.find_spans(docs(spark, texts)).collect():
        assert [tuple(s) for s in r.added_secret] == [(7, 7 + len(whole[r.doc_id]))], r.doc_id
    for r in pii.redact(docs(spark, texts)).collect():
        assert r.text == texts[r.doc_id].replace(whole[r.doc_id], "[SECRET]"), r.doc_id


# --- 10 ----------------------------------------------------------------------


def test_op10_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(8, 20))
    rows = []
    for i in range(160):
        v = base[i % 8] + rng.normal(size=20) * rng.choice([0, 0.02, 0.1, 0.2, 1.0])
        rows.append((i, [float(x) for x in v * rng.choice([1e-3, 1, 50])], int(i % 3 == 0)))
    rows += [(200, None, 1), (201, [0.0] * 20, 1), (202, [float("nan")] * 20, 1), (203, rows[0][1], None), (204, rows[0][1], 1), (205, rows[0][1][:10], 1), (206, [None] * 20, 1), (207, [], 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, label int, kept int")
    kept = {r.vec_id: (r.label, np.array(r.embedding, float)) for r in df.collect() if r.label is not None and r.embedding and None not in r.embedding}
    kept = {k: (g, v) for k, (g, v) in kept.items() if np.isfinite(v).all() and v.any()}
    links: dict = {}
    comp = {r[0]: r[0] for r in rows}
    for (i, (g, a)), (j, (h, b)) in itertools.combinations(sorted(kept.items()), 2):
        if g == h and len(a) == len(b) and a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
            links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
            x, y = sorted((comp[i], comp[j]))
            comp = {k: x if c == y else c for k, c in comp.items()}
    assert sum(links.values()) > 100
    old, embeddings.TILE = embeddings.TILE, 8
    try:
        got = embeddings.op10_embeddings(df).collect()
    finally:
        embeddings.TILE = old
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (links.get(r.vec_id, 0), comp[r.vec_id], comp[r.vec_id] == r.vec_id)
    odd = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.n_links, r.component_id, r.kept) for r in embeddings.op10_embeddings(odd).collect()] == [(0, None, True)] * 2
    assert embeddings.op10_embeddings(odd.filter("false")).count() == 0


# --- 1 -----------------------------------------------------------------------


def test_mixing_against_brute_force(spark, odd):
    r = random.Random(3)
    rows = [(i, " ".join(["w"] * r.randrange(1, 30)), "en", "big" if i % 3 else f"s{i % 7}", 1, 0.5, "k") for i in range(900)]
    df = spark.createDataFrame(rows, DOCS)
    tokens: dict = {}
    for x in rows:
        tokens[x[3]] = tokens.get(x[3], 0) + len(x[1].split())
    out = mixing.mix(df, max_repeats=1.5).collect()
    a = out[0].exponent
    biggest, smallest = max(tokens.values()), min(tokens.values())
    assert (biggest / smallest) ** (1 - a) == pytest.approx(1.5, abs=1e-4)
    z = sum((n / sum(tokens.values())) ** a for n in tokens.values())
    for s, n in tokens.items():
        mine = [x for x in out if x.source == s]
        repeats = (biggest / n) ** (1 - a)
        assert mine[0].weight == pytest.approx((n / sum(tokens.values())) ** a / z, rel=1e-6)
        assert abs(sum(x.tokens for x in mine) - repeats * n) <= 30
        assert {x.doc_id for x in mine if x.epoch == 0} == {x[0] for x in rows if x[3] == s}
        assert len({(x.doc_id, x.epoch) for x in mine}) == len(mine)
    old, mixing.BLOCK_TOKENS = mixing.BLOCK_TOKENS, 1000
    try:
        blocks: dict = {}
        for x in mixing.mix(df, entropy=1.8, budget=1.0).collect():
            blocks.setdefault(x.block, []).append(x.tokens)
    finally:
        mixing.BLOCK_TOKENS = old
    sizes = [sum(v) for v in blocks.values()]
    assert max(sizes) < 1.6 * sum(sizes) / len(sizes)
    assert mixing.mix(odd, details=False).columns == odd.columns and mixing.mix(odd).filter("epoch = 0").count() == 7
    assert mixing.mix(empty(spark)).count() == 0


def test_entropy_target(spark):
    shares = spark.createDataFrame([("a", 1, 900, 0.9), ("b", 1, 90, 0.09), ("c", 1, 10, 0.01)], "_s string, docs long, tokens long, share double")
    a = mixing.bisect_exponent(shares, entropy=1.0)
    w = np.array([0.9, 0.09, 0.01]) ** a
    w /= w.sum()
    assert -(w * np.log(w)).sum() == pytest.approx(1.0, abs=1e-5)
    assert mixing.bisect_exponent(shares, entropy=9.0) == 0.0 and mixing.bisect_exponent(shares, entropy=0.0) == 1.0


def test_mix_without_details_is_in_block_order(spark):
    rows = [(i, "w " * 400, f"s{i % 3}") for i in range(9_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {}
    for r in mixing.mix(df).collect():
        want.setdefault(r.doc_id, []).append((r.block, r.order_key))
    out = materialize(mixing.mix(df, details=False), "test-mix")
    assert out.columns == df.columns and all(len(v) == 1 for v in want.values()) and len({v[0][0] for v in want.values()}) == 4
    files = {}
    for r in out.withColumn("f", F.input_file_name()).collect():
        files.setdefault(r.f, []).append(want[r.doc_id][0])
    assert all(v == sorted(v) for v in files.values()) and sum(map(len, files.values())) == len(rows)
    runs = sorted((min(v), max(v)) for v in files.values())
    assert all(a[1] <= b[0] for a, b in zip(runs, runs[1:]))


# --- awkward tables ----------------------------------------------------------


def test_mix_replaces_only_its_own_columns(spark):
    df = spark.createDataFrame([(1, "a b", "s", "mine", "x"), (2, None, "t", "mine", "x")], "doc_id long, text string, source string, epoch string, _h string")
    out = mixing.mix(df)
    assert {r._h for r in out.collect()} == {"x"} and dict(out.dtypes)["epoch"] == "bigint"
    assert {r.epoch for r in mixing.mix(df, details=False).collect()} == {"mine"}


def test_op4_long_texts_and_a_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", f"turn {t} <|") for t in range(4000)] + [(2, 0, "assistant", LONG)]
    got = {r.conv_id: r for r in chat.op4_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2):
        said = "".join(x for c, _, role, x in rows if c == conv and role == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op10_labels_of_any_type(spark):
    rows = [(1, [1.0, 0.0], "a b"), (2, [1.0, 0.001], "a b"), (3, [1.0, 0.0], "c"), (4, [1.0, 0.0], None), (5, [2.0, 0.0], "a b"), (6, [1e-300, 0.0], "c")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.op10_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (1, 3), 4: (0, 4), 5: (2, 1), 6: (1, 3)}


def test_pairs_at_the_threshold(spark):
    """Cosines of exactly the threshold link, and the next double below doesn't."""
    a = np.zeros(40)
    a[0] = 25.0
    b = np.zeros(40)
    b[0], b[1:40:2] = 24.5, (25.0**2 - 24.5**2) ** 0.5 / 20**0.5
    r = np.linalg.qr(np.random.default_rng(1).normal(size=(40, 40)))[0]
    x, y = a[None] @ r, b[None] @ r
    for exact, want in ((lambda i, j: np.longdouble("0.98"), 1), (lambda i, j: np.longdouble("0.98") - np.longdouble("1e-17"), 0)):
        u, v = (m / np.sqrt((m * m).sum()) for m in (x, y))
        assert abs((u @ v.T)[0, 0] - 0.98) < 1e-9
        assert len(embeddings.links_of(u, v, np.longdouble("0.98"), exact)[0]) == want


def test_record_ids_are_unique(spark):
    df = spark.createDataFrame([(7, "u", "<a>")] * 50 + [(8, "u", "<a>")], "page_id long, url string, html string").repartition(4)
    once = materialize(warc.write_archives(df), "test-ids")
    fresh = warc.read_headers(materialize(warc.deduplicate(once), "test-ids")).collect()
    assert len({r.record_id for r in fresh}) == 51 and sum(r.record_type == "response" for r in fresh) == 1
    target = next(r.record_id for r in fresh if r.record_type == "response")
    assert {r.refers_to_record for r in fresh if r.record_type == "revisit"} == {target} and target not in {r.record_id for r in fresh if r.record_type == "revisit"}


def test_members_split_anywhere():
    parts = [warc.record("response", i, "u", bytes(random.Random(i).randrange(256) for _ in range(n)), n, warc.digest_of(b"")) for i, n in enumerate((0, 1, 5000, 40_000, 3))]
    old = warc.FEED
    try:
        for warc.FEED in (1, 7, 100, old):
            assert [len(b) for _, b in warc.records(b"".join(parts))] == [0, 1, 5000, 40_000, 3]
    finally:
        warc.FEED = old
    with pytest.raises(ValueError):
        list(warc.records(b"".join(parts)[:-20]))
