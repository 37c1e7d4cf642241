"""The media column's features against a plain reader of JPEG files, bit by bit."""

import struct

from tidewright.llm import media


def _plain(data):
    """Width, height and rounded luminance of each block's DC term, by a sequential baseline decoder."""
    at, quant, huff, interval = 2, {}, {}, 0
    while True:
        marker, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            quant[body[0] & 15] = list(body[1:65])
        elif marker == 0xC4:
            codes, code, k = {}, 0, 17
            for length in range(1, 17):
                for _ in range(body[length]):
                    codes[format(code, f"0{length}b")] = body[k]
                    code, k = code + 1, k + 1
                code *= 2
            huff[body[0]] = codes
        elif marker == 0xC0:
            height, width = struct.unpack(">HH", body[1:5])
            tables = {body[6 + 3 * i]: body[8 + 3 * i] for i in range(body[5])}
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            break
    parts, now = [], bytearray()
    while data[at] != 0xFF or data[at + 1] != 0xD9:
        if data[at] != 0xFF:
            now.append(data[at])
        elif data[at + 1] == 0:
            now.append(0xFF)
            at += 1
        else:
            parts.append(bytes(now))
            now = bytearray()
            at += 1
        at += 1
    parts.append(bytes(now))
    units, pixels = -(-width // 8) * -(-height // 8), []
    for part in parts:
        bits = "".join(format(b, "08b") for b in part)
        place, before = 0, {c: 0 for c, _, _ in order}

        def symbol(codes):
            nonlocal place
            for n in range(1, 17):
                if bits[place : place + n] in codes:
                    place += n
                    return codes[bits[place - n : place]]
            raise AssertionError

        def extra(size):
            nonlocal place
            v = int(bits[place : place + size] or "0", 2)
            place += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(interval, units)):
            units -= 1
            for c, dc, ac in order:
                before[c] += extra(symbol(huff[dc]))
                if c == order[0][0]:
                    pixels.append(max(0, min(255, round(before[c] * quant[tables[c]][0] / 8) + 128)))
                k = 1
                while k < 64:
                    s = symbol(huff[16 + ac])
                    if not s:
                        break
                    k += (s >> 4) + 1
                    extra(s & 15)
    return width, height, pixels


def test_features_equal_a_plain_reader(spark):
    texts = ["", "short", "naïve ümlaut " * 40, "".join(chr(32 + i % 90) for i in range(2000)), "x" * 5000]
    files = media.to_media(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.feature for r in media.read_media(files).collect()}
    for r in files.collect():
        width, height, pixels = _plain(bytes(r.media))
        n = len(pixels)
        spread = []
        for k in range(64):  # the mean of a stretch, pixels at its borders in part
            a, b = k * n / 64, (k + 1) * n / 64
            spread.append(sum(p * max(0.0, min(b, i + 1) - max(a, i)) for i, p in enumerate(pixels)) / (b - a))
        mean = sum(spread) / 64
        kind, bits = got[r.doc_id].split(":")
        assert kind == f"{width}x{height}" and n == width * height // 64
        assert all(abs(m - mean) < 1e-6 or (m > mean) == (b == "1") for m, b in zip(spread, format(int(bits, 16), "064b"), strict=True))


def test_long_payloads_are_coded_in_parts(monkeypatch):
    data = bytes(range(256)) * 12
    whole = media.encode_batch([data, data[:192]], [len(data), 3])
    monkeypatch.setattr(media, "LANES", 3)
    assert media.encode_batch([data, data[:192]], [len(data), 3]) == whole
    assert [media.payload_of(*x) for x in media.decode_batch(whole)] == [data, data[:192]]
