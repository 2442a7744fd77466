import hashlib
import random
import zlib

import numpy as np
import pytest

from pagevault.llm import jpeg, media

from cases import clashing, documents, odd_texts, words


def scalar_decode(data):
    """A plain decoder, bit by bit, that knows one image at a time."""
    image = jpeg.parse(data, jpeg.Bits(np.frombuffer(data, dtype=np.uint8)).marks, 0)
    arrays = [np.zeros((c.wide * c.high, 64), dtype=int) for c in image.components]
    for scan in image.scans:
        raw, parts, i = data[scan.start : scan.end], [bytearray()], 0
        while i < len(raw):
            if raw[i] == 0xFF and 0xD0 <= raw[i + 1] <= 0xD7:
                parts.append(bytearray())
            else:
                parts[-1].append(raw[i])
            i += 2 if raw[i] == 0xFF else 1
        own = [image.components[c] for c in scan.components]
        which, rows, unit = jpeg.scan_rows(tuple((c.wide, c.high, c.own_wide, c.own_high, c.across, c.down, 0) for c in own))
        length = scan.restart * unit if scan.restart else len(rows)
        for n, part in enumerate(parts):
            bits = "".join(f"{b:08b}" for b in part)
            at, run, last = 0, 0, [0] * len(own)

            def take(k):
                nonlocal at
                at += k
                return int(bits[at - k : at] or "0", 2)

            def symbol(table):
                codes, sizes = table.codes
                for size in range(1, 17):
                    for s in table.symbols:
                        if sizes[s] == size and int(bits[at : at + size], 2) == codes[s]:
                            take(size)
                            return s

            def value(size):
                v = take(size)
                return v if size == 0 or v >> (size - 1) else v - (1 << size) + 1

            for j in range(n * length, min(len(rows), (n + 1) * length)):
                c, block = int(which[j]), arrays[scan.components[int(which[j])]][rows[j]]
                if scan.low == 0:
                    if scan.before:
                        block[0] |= take(1) << scan.shift
                    else:
                        last[c] += value(symbol(scan.tables[c][0]))
                        block[0] = last[c] << scan.shift
                    continue
                k, table = scan.low, scan.tables[0][1]
                history = block != 0
                correct = lambda k: take(1) * (1 if block[k] > 0 else -1) << scan.shift  # noqa: E731,B023
                while k <= scan.high:
                    if run:
                        run -= 1
                        if scan.before:
                            for m in range(k, scan.high + 1):
                                if history[m]:
                                    block[m] += correct(m)
                        break
                    s = symbol(table)
                    zeros, size = s >> 4, s & 15
                    if size == 0 and zeros < 15:
                        run = (1 << zeros) + take(zeros)
                        continue
                    if not scan.before:
                        k += zeros
                        if size:
                            block[k] = value(size) << scan.shift
                        k += 1
                        continue
                    new = (1 if take(1) else -1) << scan.shift if size else 0
                    while k <= scan.high:
                        if history[k]:
                            block[k] += correct(k)
                        elif zeros == 0:
                            block[k] = new
                            break
                        else:
                            zeros -= 1
                        k += 1
                    k += 1
    return image, arrays


def payloads():
    rng = random.Random(3)
    return [b" " * 192, bytes(rng.randrange(256) for _ in range(576)), b"\xff" * 192, b"\x00" * 384, b"text of some kind, again and again. " * 64, bytes([101, 102, 100] * 64), bytes(rng.choice([101, 101, 101, 102, 130]) for _ in range(192 * 9))]


def test_round_trip_and_scalar_decoder():
    data = payloads()
    files = media.store(data, [b""] * len(data))
    images, coefficients = jpeg.decode(files)
    assert [media.payload(i, coefficients) for i in images] == data
    for file, image in zip(files, images):
        _, arrays = scalar_decode(file)
        for c, own in zip(image.components, arrays):
            assert (coefficients[c.base : c.base + len(own)] == own).all()


def test_images_do_not_depend_on_their_neighbours():
    data = payloads()
    files = media.store(data, [b""] * len(data))
    assert [media.store([d], [b""])[0] for d in data] == files
    for file, image_all in zip(files, jpeg.decode(files)[0]):
        images, own = jpeg.decode([file])
        _, every = jpeg.decode(files)
        assert (jpeg.rgb(images[0], own) == jpeg.rgb(image_all, every)).all()


def test_inverse_transform_and_colours():
    row = np.zeros((2, 64), dtype=np.int32)
    row[0, 0], row[1, 1] = 80, 100
    got = jpeg.samples(row).astype(int)
    assert (got[0] == 138).all()  # a mean of 80 / 8
    x = np.arange(8)
    want = 128 + 100 * np.sqrt(0.5) / 4 * np.cos((2 * x + 1) * np.pi / 16)
    assert np.abs(got[1] - np.rint(want)[None, :]).max() <= 1
    image = jpeg.Image(16, 16, [jpeg.Component(1, 2, 2, 0, 2, 2, 2, 2, 0), jpeg.Component(2, 1, 1, 0, 1, 1, 1, 1, 4), jpeg.Component(3, 1, 1, 0, 1, 1, 1, 1, 5)], steps={0: np.ones(64, dtype=int)})
    blocks = np.concatenate([np.full((4, 8, 8), 100), np.full((1, 8, 8), 128), np.full((1, 8, 8), 178)]).astype(np.uint8)
    rgb = jpeg.rgb(image, np.zeros((6, 64)), blocks)
    assert rgb.shape == (16, 16, 3) and rgb[0, 0].tolist() == [170, 64, 100]


def test_zigzag():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and jpeg.ZIGZAG[-1] == 63


@pytest.mark.parametrize("runs", [False, True])
def test_general_scans(runs):
    """One interval for a whole scan, and end-of-band runs over several blocks."""
    dc, ac = jpeg.own_tables()
    ac = jpeg.table_for({s: 1.0 for s in [*ac.symbols, 0x10, 0x20, 0x30]})
    rng = np.random.default_rng(5)
    v = rng.choice([0, 0, 0, 1, -1, 2, -3, 9], size=(9, 64))
    if runs:
        v[2:7, 1:] = 0
    code, size = ac.codes
    bits = ""
    put = lambda s: f"{int(code[s]):0{int(size[s])}b}"
    waiting = 0
    for block in v:
        coefficients = block[1:]
        last = np.flatnonzero(coefficients).max(initial=-1)
        if last < 0 and runs:
            waiting += 1
            continue
        if waiting:
            n = waiting.bit_length() - 1
            bits += put(n << 4) + (f"{waiting - (1 << n):0{n}b}" if n else "")
            waiting = 0
        zeros = 0
        for x in coefficients[: last + 1]:
            if x == 0:
                zeros += 1
                continue
            bits += put(0xF0) * (zeros // 16)
            s, extra = jpeg.magnitude(np.array([x]))
            bits += put((zeros % 16) << 4 | int(s[0])) + f"{int(extra[0]):0{int(s[0])}b}"
            zeros = 0
        if last < 62:
            bits += put(0)
    bits += "1" * (-len(bits) % 8)
    body = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    frame = bytes([8, 0, 20, 0, 20, 1, 7, 0x11, 0])  # 3 by 3 blocks, cut off
    file = b"\xff\xd8" + jpeg.segment(0xDB, bytes([0]) + bytes([1] * 64)) + jpeg.segment(0xC4, bytes([0x10]) + ac.lengths + ac.symbols) + jpeg.segment(0xC2, frame) + jpeg.segment(0xDA, bytes([1, 7, 0, 1, 63, 0])) + body + b"\xff\xd9"
    images, got = jpeg.decode([file])
    assert (got[:, 1:] == v[:, 1:]).all() and jpeg.rgb(images[0], got).shape == (20, 20, 3)
    with pytest.raises(ValueError):
        jpeg.decode([b"no image at all"])


def test_query_contract(spark):
    texts = odd_texts()
    rows = {r.doc_id: r for r in media.store_texts(clashing(documents(spark, texts)), with_media=True, with_rgb=True).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        data = raw + b" " * (-len(raw) % 192 if raw else 192)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest()) and len(r.rgb) == 3 * r.width * r.height
    assert rows[9].asDict() | {"doc_id": 0} == rows[10].asDict() | {"doc_id": 0}
    assert media.store_texts(documents(spark, []) if False else documents(spark, ["x"]).limit(0)).count() == 0
    column = spark.createDataFrame([(1, bytearray(rows[6].media)), (2, None)], "doc_id long, media binary")
    back = {r.doc_id: r for r in media.decode_column(column).collect()}
    assert back[1].rgb == rows[6].rgb and back[2].rgb is None


def test_broken_files_give_errors_beside_whole_ones(spark):
    rng = random.Random(14)
    good = media.store([media.filled(words(rng, n).encode()) for n in (20, 400)], [b"bytes=1", b"bytes=2"])
    bad = [b"", b"\xff\xd8", b"no image", good[0][: len(good[0]) // 2], good[1][:-2], good[1][:30]]
    for _ in range(25):
        data = bytearray(good[0])
        for _ in range(3):
            data[rng.randrange(len(data))] = rng.randrange(256)
        bad.append(bytes(data))
    files = [good[0], *bad, good[1], None]
    rows = {r.doc_id: r for r in media.decode_column(spark.createDataFrame([(i, f) for i, f in enumerate(files)], "doc_id long, media binary").coalesce(1)).collect()}
    assert len(rows) == len(files) and rows[len(files) - 1][1:] == (None, None, None, None)
    for i, f in ((0, good[0]), (len(files) - 2, good[1])):
        images, coefficients = jpeg.decode([f])
        assert rows[i].error is None and bytes(rows[i].rgb) == jpeg.rgb(images[0], coefficients).tobytes()
    assert all((r.error is None) != (r.rgb is None) for i, r in rows.items() if i < len(files) - 1) and all(rows[i].error for i in range(1, 5))
    assert [bytes(r.rgb or b"") for r in media.store_texts(documents(spark, ["x", "x"]), with_rgb=True).collect()][0]
