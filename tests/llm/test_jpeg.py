"""Progressive JPEG: exact round trips, pictures of other makes, and pixels against the plain transform."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import jpeg


def stored(payloads):
    media = jpeg.encode(payloads)
    pictures = [jpeg.Picture(m) for m in media]
    coef, start = jpeg.decode(pictures)
    return media, pictures, [coef[a:b] for a, b in zip(start, start[1:], strict=False)]


def test_payloads_come_back():
    rng = random.Random(1)
    payloads = [jpeg.padded(b""), *[jpeg.padded(bytes(rng.choice(s) for _ in range(n))) for n in (1, 575, 576, 577, 40_000) for s in (range(256), [128], [127, 128, 129, 130], [0, 255], range(97, 123))]]
    media, pictures, coefs = stored(payloads)
    for p, m, pic, c in zip(payloads, media, pictures, coefs, strict=True):
        assert jpeg.payload_of(pic, c) == p
        assert m[:2] == b"\xff\xd8" and m[-2:] == b"\xff\xd9" and jpeg.encode([p]) == [m]


def test_scans_accumulate():
    """After the first passes coefficients lack their lowest bits; refinements bring them."""
    _, [pic], [full] = stored([jpeg.padded(bytes(range(256)) * 9)])
    pic.scans = pic.scans[:7]
    part, _ = jpeg.decode([pic])
    low = slice(1, 6)
    assert (part[:, 0] == full[:, 0] >> 1 << 1).all() and (part[:, 6:] == full[:, 6:]).all()
    assert (part[:, low] == np.sign(full[:, low]) * (np.abs(full[:, low]) >> 1 << 1)).all()


class Writer:
    """Bit by bit, for a picture with end-of-band runs, long runs and no restarts, as other encoders write."""

    def __init__(self):
        self.bits = ""

    def code(self, table, symbol):
        self.bits += f"{int(table[1][symbol]):0{table[2][symbol]}b}"

    def raw(self, v, n):
        self.bits += f"{v:0{n}b}" if n else ""

    def done(self):
        b = self.bits + "1" * (-len(self.bits) % 8)
        return bytes(int(b[i : i + 8], 2) for i in range(0, len(b), 8)).replace(b"\xff", b"\xff\0")


def test_grey_picture_with_runs_of_ended_blocks():
    codes = jpeg.canonical({s: 8 for s in range(0, 250)})
    rng = random.Random(4)
    blocks = 12  # 4 x 3 blocks, of which the picture shows 27 x 20 pixels
    want = np.zeros((blocks, 64), int)
    for b in (0, 3, 4, 11):
        for _ in range(3):
            want[b, rng.randrange(1, 64)] = rng.choice([-9, -3, -2, -1, 1, 2, 5])
    want[:, 0] = [rng.randrange(-50, 50) for _ in range(blocks)]
    scans = []
    w, last = Writer(), 0
    for b in range(blocks):
        d = int(want[b, 0]) - last
        last = int(want[b, 0])
        n = abs(d).bit_length()
        w.code(codes, n)
        w.raw(d if d >= 0 else d + (1 << n) - 1, n)
    scans.append((0, 0, 0, 0, w.done()))
    w, ended = Writer(), 0

    def flush():
        nonlocal ended
        if ended:
            n = ended.bit_length() - 1
            w.code(codes, n << 4)
            w.raw(ended - (1 << n), n)
            ended = 0

    for b in range(blocks):  # first pass, one bit short
        run = 0
        v = np.sign(want[b]) * (np.abs(want[b]) >> 1)
        for k in range(1, 64):
            if not v[k]:
                run += 1
                continue
            flush()
            while run > 15:
                w.code(codes, 0xF0)
                run -= 16
            n = abs(int(v[k])).bit_length()
            w.code(codes, run << 4 | n)
            w.raw(int(v[k]) if v[k] > 0 else int(v[k]) + (1 << n) - 1, n)
            run = 0
        ended += run > 0
    flush()
    scans.append((1, 63, 0, 1, w.done()))
    w = Writer()
    for b in range(blocks):  # refinement: sixteen-zero runs, corrections, ended blocks one at a time
        run, held = 0, ""
        a = np.abs(want[b])
        final = max([k for k in range(1, 64) if a[k] == 1], default=0)
        for k in range(1, 64):
            if a[k] == 0:
                run += 1
                continue
            while run > 15 and k <= final:
                w.code(codes, 0xF0)
                w.bits += held
                run, held = run - 16, ""
            if a[k] > 1:
                held += str(a[k] & 1)
                continue
            w.code(codes, run << 4 | 1)
            w.bits += str(int(want[b, k] > 0)) + held
            run, held = 0, ""
        if run or held:
            w.code(codes, 0)
            w.bits += held
    scans.append((1, 63, 1, 0, w.done()))
    q = bytes(range(1, 65))
    data = b"\xff\xd8" + jpeg.piece(0xDB, b"\0" + q) + jpeg.piece(0xC2, struct.pack(">BHHB", 8, 20, 27, 1) + bytes((1, 0x11, 0))) + jpeg.piece(0xC4, b"\0" + codes[0] + b"\x10" + codes[0])
    for ss, se, ah, al, body in scans:
        data += jpeg.piece(0xDA, bytes((1, 1, 0, ss, se, ah << 4 | al))) + body
    pic = jpeg.Picture(data + b"\xff\xd9")
    coef, _ = jpeg.decode([pic])
    assert (coef == want).all()
    rgb = jpeg.pixels(pic, coef)
    assert rgb.shape == (20, 27, 3)
    natural = np.zeros((blocks, 64))
    natural[:, jpeg.ZIGZAG] = want * np.arange(1, 65)
    cos = np.array([[(np.sqrt(0.125) if u == 0 else 0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)])
    for b in range(blocks):
        plain = np.clip(cos.T @ natural[b].reshape(8, 8) @ cos + 128, 0, 255)
        part = rgb[b // 4 * 8 : b // 4 * 8 + 8, b % 4 * 8 : b % 4 * 8 + 8, 0]
        assert np.abs(plain[: part.shape[0], : part.shape[1]] - part).max() <= 1


def test_chroma_is_doubled():
    _, [pic], [coef] = stored([jpeg.padded(bytes(random.Random(2).choices(range(120, 136), k=700)))])
    rgb = jpeg.pixels(pic, coef).astype(int)
    assert rgb.shape == (pic.height, pic.width, 3)
    coef = coef.copy()
    coef[np.arange(len(coef)) % 6 < 4] = 0  # flat luma: what is left is chroma, equal in each 2 x 2
    rgb = jpeg.pixels(pic, coef)
    assert (rgb[::2, ::2] == rgb[1::2, ::2]).all() and (rgb[::2, ::2] == rgb[::2, 1::2]).all()


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-3:].tolist() == [55, 62, 63] and sorted(jpeg.ZIGZAG) == list(range(64))


@pytest.mark.parametrize("records", ["10000", "2"])
def test_rows(spark, records):
    rows = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "é日本" * 200), (4, "x" * 200_000), (5, "\0\n")]
    docs = spark.createDataFrame([(*r, "m") for r in rows], "doc_id long, text string, media string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", records)
    got = jpeg.round_trip(docs).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, t in rows:
        raw = (t or "").encode()
        body = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        want[i] = (i, len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]))
    assert sorted(str(tuple(r)[:5]) for r in got) == sorted(str(want[i]) for i, _ in rows)
    assert len({r.media_sha256 for r in got if r.doc_id in (1, 2)}) == 1 == len({r.feature for r in got if r.doc_id == 3})
    assert jpeg.round_trip(docs.limit(0)).count() == 0
    full = jpeg.load(jpeg.store(docs), payload=True, tensor=True).select("text", "payload", "tensor", F.col("shape")).collect()
    for r in full:
        assert bytes(r.payload).rstrip(b"\xff") == (r.text or "").encode() and len(r.tensor) == np.prod(r.shape)
    assert jpeg.load(spark.createDataFrame([(None,)], "media binary")).first().feature is None
