"""Media columns: byte payloads as baseline JPEG images, read back as DC-only luminance thumbnails.

Writing. Every byte of the payload is one flat 8 x 8 block: its quantised DC coefficient is ``byte - 128`` with a DC
quantiser of 8, and all AC coefficients are zero. So the image is eight times as wide and high as the payload laid out
in rows of 64 samples, and its 1/8-scale DC thumbnail *is* the payload. Each row of blocks is a restart interval. A
payload of over ``ROWS`` rows becomes several images, one after the other (JPEG sides end at 65,535).

Reading. ``images`` walks the markers (SOI, DQT, SOF0, DHT, DRI, SOS, RSTn, EOI); ``thumbnail`` Huffman-decodes the scan and
reconstructs the DC-only luminance. All restart intervals advance together, one coefficient a step, in numpy, so
Python's work does not grow with the number of samples. The reader takes any one-component baseline image with restart
intervals or without; AC coefficients are decoded and skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import read, text_of

COLUMNS = 64
ROWS = 8000
#: Code lengths of our DC table by category (bits of the difference), shortest for the differences that text has.
DC_COUNTS, DC_SYMBOLS = (0, 1, 4, 2, 2), (6, 5, 4, 3, 7, 0, 2, 1, 8)
AC_COUNTS, AC_SYMBOLS = (1,), (0,)  # the end of block only, one bit


def huffman_codes(counts, symbols) -> dict[int, tuple[int, int]]:
    """Symbol to (code, bits), as the standard derives codes from a DHT segment."""
    codes, code, k = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            codes[symbols[k]] = (code, bits)
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def huffman_lookup(counts, symbols) -> np.ndarray:
    """For each 16-bit prefix: bits << 8 | symbol; zero where no code fits."""
    table = np.zeros(1 << 16, np.int32)
    for symbol, (code, bits) in huffman_codes(counts, symbols).items():
        table[code << (16 - bits) : (code + 1) << (16 - bits)] = bits << 8 | symbol
    return table


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _header(rows: int) -> bytes:
    pad = lambda counts: bytes(counts) + bytes(16 - len(counts))
    return b"".join((
        b"\xff\xd8",
        segment(0xDB, b"\0" + bytes([8] + [1] * 63)),
        segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, COLUMNS * 8, 1, 1, 0x11, 0)),
        segment(0xC4, b"\x00" + pad(DC_COUNTS) + bytes(DC_SYMBOLS)),
        segment(0xC4, b"\x10" + pad(AC_COUNTS) + bytes(AC_SYMBOLS)),
        segment(0xDD, struct.pack(">H", COLUMNS)),
        segment(0xDA, b"\x01\x01\x00\x00\x3f\x00"),
    ))


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: the block's whole bit string (DC code, magnitude, end of block) and its length."""
    codes, out = huffman_codes(DC_COUNTS, DC_SYMBOLS), []
    for d in range(-255, 256):
        n = abs(d).bit_length()
        code, bits = codes[n]
        out.append((((code << n | (d if d >= 0 else d + (1 << n) - 1)) << 1), bits + n + 1))
    return tuple(np.array(x, np.int64) for x in zip(*out, strict=True))


BLOCK_CODE, BLOCK_BITS = _code_tables()


def encode_scans(samples: np.ndarray) -> list[bytes]:
    """The entropy-coded bytes, with stuffing, of each row of ``samples`` (uint8, rows x 64)."""
    x = samples.astype(np.int64) - 128
    step = np.diff(x, axis=1, prepend=0) + 255
    code, bits = BLOCK_CODE[step], BLOCK_BITS[step]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) // 8
    first = np.concatenate([[0], np.cumsum(size)])
    start = (ends - bits + first[:-1, None] * 8).ravel()
    word = (code << (32 - bits)).ravel() >> (start & 7)  # at most 17 + 7 bits, from the top of 32
    at = start >> 3
    out = np.zeros(first[-1] + 4, np.uint8)
    for k in range(3):
        # The bits of different blocks never overlap, so sums are unions.
        out[: first[-1] + 1] += np.bincount(at + k, (word >> (24 - 8 * k)) & 255, first[-1] + 1)[: first[-1] + 1].astype(np.uint8)
    spare = first[1:] * 8 - (first[:-1] * 8 + ends[:, -1])
    out[first[1:] - 1] |= ((1 << spare) - 1).astype(np.uint8)
    data, cuts = out[: first[-1]], first
    stuffed = np.flatnonzero(data == 255)
    if len(stuffed):
        data = np.insert(data, stuffed + 1, 0)
        cuts = first + np.searchsorted(stuffed, first)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


RESTART = [bytes([0xFF, 0xD0 + k]) for k in range(8)]


def write_many(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload (of a positive multiple of 64 bytes); rows of all are coded together."""
    scans = encode_scans(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, COLUMNS))
    out, at = [], 0
    for p in payloads:
        parts, rows = [], len(p) // COLUMNS
        for top in range(0, rows, ROWS):
            n = min(ROWS, rows - top)
            parts.append(_header(n))
            for k, scan in enumerate(scans[at + top : at + top + n]):
                parts += [scan, RESTART[k % 8]] if k + 1 < n else [scan, b"\xff\xd9"]
        at += rows
        out.append(b"".join(parts))
    return out


def images(media: bytes) -> Iterator[dict]:
    """The images of a stored form: height, width, quantisers, Huffman tables, restart interval and scan segments."""
    at = 0
    while at < len(media):
        if media[at : at + 2] != b"\xff\xd8":
            raise ValueError("no start of image")
        image, at = {"dht": {}, "dqt": {}, "dri": 0}, at + 2
        while True:
            marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
            if media[at] != 255:
                raise ValueError("no marker")
            body, at = media[at + 4 : at + 2 + size], at + 2 + size
            if marker == 0xDB:
                while body:
                    if body[0] >> 4:
                        raise ValueError("baseline quantisers have 8 bits")
                    image["dqt"][body[0]], body = body[1:65], body[65:]
            elif marker == 0xC0:
                image["height"], image["width"], parts = struct.unpack(">HHB", body[1:6])
                if parts != 1:
                    raise ValueError("one component only")
                image["q"] = body[8]
            elif 0xC1 <= marker <= 0xCF and marker != 0xC4:
                raise ValueError("not baseline")
            elif marker == 0xC4:
                while body:
                    counts, n = tuple(body[1:17]), sum(body[1:17])
                    image["dht"][body[0]], body = (counts, tuple(body[17 : 17 + n])), body[17 + n :]
            elif marker == 0xDD:
                image["dri"] = int.from_bytes(body, "big")
            elif marker == 0xDA:
                image["dc"], image["ac"] = image["dht"][body[2] >> 4], image["dht"][0x10 | body[2] & 15]
                break
        end = media.index(b"\xff\xd9", at)
        image["scan"], at = media[at:end], end + 2
        yield image


def scan_segments(scans: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All scans' bytes without markers and stuffing, the offset of each restart interval, and intervals per scan."""
    data = np.frombuffer(b"\xff\xd7".join(scans) + b"\xff\xd7", np.uint8)
    mark = np.flatnonzero(data == 255)
    after = data[mark + 1]
    restart, stuffed = mark[(after & 0xF8) == 0xD0], mark[after == 0] + 1
    keep = np.ones(len(data), bool)
    keep[restart], keep[restart + 1], keep[stuffed] = False, False, False
    shift = np.cumsum(~keep)
    lasts = np.cumsum([len(s) + 2 for s in scans]) - 2
    ends = restart - shift[restart] + 1
    per_scan = np.diff(np.searchsorted(restart, lasts), prepend=-1)
    return data[keep], np.concatenate([[0], ends[:-1]]), per_scan


def dc_lanes(data: np.ndarray, starts: np.ndarray, blocks: np.ndarray, dc, ac) -> np.ndarray:
    """Quantised DC values, lanes x blocks: all restart intervals are decoded side by side."""
    dc_table, ac_table = huffman_lookup(*dc), huffman_lookup(*ac)
    eob_only = ac[1] == (0,)
    d = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.int64)
    # 32 bits from each byte on: one gather gives code and magnitude of a coefficient.
    view = d[:-4] << 32 | d[1:-3] << 24 | d[2:-2] << 16 | d[3:-1] << 8 | d[4:]
    at, value = starts.astype(np.int64) * 8, np.zeros(len(starts), np.int64)
    out = np.zeros((len(starts), int(blocks.max(initial=0))), np.int64)
    last = len(view) - 1
    for k in range(out.shape[1]):
        live = blocks > k
        bits = view[np.minimum(at >> 3, last)] << (at & 7)
        hit = dc_table[(bits >> 24) & 0xFFFF]
        size, n = hit & 255, hit >> 8
        raw = (bits >> (40 - n - size)) & ((1 << size) - 1)
        value = value + np.where(live, raw - np.where((size > 0) & (raw < 1 << np.maximum(size - 1, 0)), (1 << size) - 1, 0), 0)
        out[:, k] = value
        at = at + np.where(live, n + size, 0)
        if eob_only:
            at = at + live
            continue
        todo, index = live.copy(), np.ones(len(at), np.int64)
        while todo.any():
            bits = view[np.minimum(at >> 3, last)] << (at & 7)
            hit = ac_table[(bits >> 24) & 0xFFFF]
            symbol, n = hit & 255, hit >> 8
            at = at + np.where(todo, n + (symbol & 15), 0)
            index = index + np.where(symbol == 0, 64, (symbol >> 4) + 1)
            todo &= index < 64
    return out


def thumbnails(many: list[dict]) -> list[np.ndarray]:
    """The DC-only luminance (uint8, one sample a block) of images that have the same tables and whole-row intervals."""
    done: list = [None] * len(many)
    groups: dict = {}
    for k, x in enumerate(many):
        groups.setdefault((x["dc"], x["ac"]), []).append(k)
    for (dc, ac), ks in groups.items():
        data, starts, per_scan = scan_segments([many[k]["scan"] for k in ks])
        wide = [(many[k]["width"] + 7) // 8 for k in ks]
        high = [(many[k]["height"] + 7) // 8 for k in ks]
        blocks = np.concatenate([np.minimum(i := many[k]["dri"] or w * h, w * h - i * np.arange(n)) for k, w, h, n in zip(ks, wide, high, per_scan, strict=True)])
        lanes, first = dc_lanes(data, starts, blocks, dc, ac), 0
        for k, w, h, n in zip(ks, wide, high, per_scan, strict=True):
            part, b = lanes[first : first + n], blocks[first : first + n]
            flat = part[np.arange(part.shape[1])[None, :] < b[:, None]] if n else part.ravel()
            scaled = flat * many[k]["dqt"][many[k]["q"]][0] / 8 + 128
            done[k] = np.clip(np.rint(scaled), 0, 255).astype(np.uint8).reshape(h, w)
            first += n
    return done


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: the thumbnail's mean over 8 x 9 cells, each compared with the next; 16 hex digits."""
    rows = np.linspace(0, thumb.shape[0], 9).astype(int)
    cols = np.linspace(0, thumb.shape[1], 10).astype(int)
    total = np.zeros((thumb.shape[0] + 1, 10), np.int64)
    total[1:] = np.cumsum(np.add.reduceat(np.pad(thumb.astype(np.int64), ((0, 0), (0, 1))), cols, axis=1), axis=0)
    cells = (total[rows[1:]] - total[rows[:-1]])[:, :9]
    area = np.diff(rows)[:, None] * np.diff(cols)[None, :]
    mean = cells / np.maximum(area, 1)
    return f"{int(''.join('01'[int(x)] for x in (mean[:, 1:] > mean[:, :-1]).ravel()), 2):016x}"


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, images long, width long, height long"


def media_columns(docs: DataFrame, keep_media: bool = False, block_bytes: int = 1 << 21) -> DataFrame:
    """Store each text as JPEG and describe what is read back; with ``keep_media`` the column ``media`` has the images.

    A null or empty text is 64 zero bytes. Equal texts give equal values. Very long texts take several images, coded
    ``block_bytes`` at a time or one document alone. A null doc_id stays null; repeated rows stay; other columns are
    ignored; no rows give no rows. ``feature``: size of all images and the difference hash of each image's thumbnail, joined by dots.
    """

    def rows(docs: list[tuple]) -> pa.RecordBatch:
        raw = [text.encode() for _, text in docs]
        media = write_many([x + bytes(-len(x) % 64 if x else 64) for x in raw])
        parsed = [list(images(m)) for m in media]
        thumbs, at, out = thumbnails([i for p in parsed for i in p]), 0, []
        for (doc_id, _), x, m, p in zip(docs, raw, media, parsed, strict=True):
            own = thumbs[at : at + len(p)]
            at += len(p)
            back = b"".join(t.tobytes() for t in own)
            width, height = p[0]["width"], sum(i["height"] for i in p)
            out.append((doc_id, len(x), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(m), hashlib.sha256(m).hexdigest(), f"{width}x{height}:{'.'.join(map(thumbnail_hash, own))}", len(p), width, height) + (m,) * keep_media)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], schema=fields)

    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = SCHEMA + ", media binary" * keep_media
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part.append((doc_id, text.as_py()))
                size += len(part[-1][1])
                if size >= block_bytes:
                    yield rows(part)
                    part, size = [], 0
            if part:
                yield rows(part)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, schema)


def op9_jpeg_media(spark, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"))
