"""Media columns: baseline JPEG with DC-only luminance thumbnails.

Writing: each payload byte is one flat 8 x 8 block of a grayscale baseline JPEG, 24 blocks wide. With a DC
quantizer of 8, a flat block of value v has the DC coefficient v - 128 exactly, so the DC-only thumbnail is the payload, without loss. A
restart interval spans 64 blocks. A JPEG has at most 65535 lines; a longer payload is stored as several frames, one
JPEG after another, each with its own markers.

Reading: markers are parsed (SOF0, DQT, DHT, DRI, SOS, RSTn); the entropy-coded data is unstuffed and cut at the
restart markers; and the Huffman codes of all intervals of all frames with the same tables are decoded in lock-step,
one block at a time, in numpy. AC coefficients are decoded only to be skipped. Colour scans go through a scalar
decoder that keeps the luminance.

Cases: a null text is the empty payload, which is padded to 576 bytes. Equal texts have equal values. An
empty table gives no row. Columns other than doc_id and text are not read. Texts are stored whole.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from stratadoc.llm.shared import slices_by_bytes, texts_of

UNIT, ACROSS, INTERVAL = 576, 24, 64
FRAME_BYTES = UNIT * (65535 // (8 * ACROSS))
DC_STEP = 8
#: Code length of each size category of the DC differences of text bytes, and of the end-of-block code.
DC_LENGTHS = {6: 2, 3: 3, 4: 3, 5: 3, 7: 3, 2: 4, 0: 5, 1: 5, 8: 6}
AC_LENGTHS = {0x00: 1}
SLICE_BYTES = 2 << 20
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary, width int, height int, thumb_hash string"
DIGEST_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length), by length and then in the order given."""
    codes, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        codes[symbol] = (code, n)
        code, last = code + 1, n
    return codes


def marker(code: int, body: bytes) -> bytes:
    return bytes([0xFF, code]) + (len(body) + 2).to_bytes(2, "big") + body


def table_body(kind: int, lengths: dict[int, int]) -> bytes:
    ordered = sorted(lengths.items(), key=lambda x: x[1])
    return bytes([kind]) + bytes(sum(n == k for _, n in ordered) for k in range(1, 17)) + bytes(s for s, _ in ordered)


def frame_header(lines: int) -> bytes:
    """Everything before the entropy-coded data of a frame of that many block lines."""
    return b"".join([
        b"\xff\xd8",
        marker(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0"),
        marker(0xDB, b"\0" + bytes([DC_STEP] + [1] * 63)),
        marker(0xC0, b"\x08" + (8 * lines).to_bytes(2, "big") + (8 * ACROSS).to_bytes(2, "big") + b"\x01\x01\x11\0"),
        marker(0xC4, table_body(0x00, DC_LENGTHS)),
        marker(0xC4, table_body(0x10, AC_LENGTHS)),
        marker(0xDD, INTERVAL.to_bytes(2, "big")),
        marker(0xDA, b"\x01\x01\0\0\x3f\0"),
    ])


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) of a whole block by its DC difference + 255: DC code, extra bits, end of block."""
    dc, (eob, eob_n) = canonical(DC_LENGTHS), canonical(AC_LENGTHS)[0]
    values, sizes = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code, n = dc[size]
        extra = diff if diff >= 0 else diff + (1 << size) - 1
        values[diff + 255] = ((code << size | extra) << eob_n) | eob
        sizes[diff + 255] = n + size + eob_n
    return values, sizes


BLOCK_BITS, BLOCK_SIZES = block_codes()


def encode_frames(samples: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The JPEGs of consecutive payloads (multiples of 576, of at most FRAME_BYTES), in whole-array steps."""
    rows = samples.reshape(-1, INTERVAL).astype(np.int64)
    before = np.concatenate([np.full((len(rows), 1), 128), rows[:, :-1]], axis=1)
    diffs = rows - before + 255
    bits, sizes = BLOCK_BITS[diffs], BLOCK_SIZES[diffs]
    ends = np.cumsum(sizes, axis=1)
    n_bytes = (ends[:, -1] + 7) >> 3
    base = np.cumsum(n_bytes) - n_bytes
    out = np.zeros(int(n_bytes.sum()) + 3, np.uint8)
    at = (base * 8)[:, None] + ends - sizes
    # one block of every interval at a time: their bytes never meet, so a plain indexed OR is right
    for k in range(INTERVAL):
        place, value = at[:, k] >> 3, bits[:, k] << (24 - sizes[:, k] - (at[:, k] & 7)).astype(np.uint32)
        out[place] |= (value >> 16).astype(np.uint8)
        out[place + 1] |= (value >> 8).astype(np.uint8)
        out[place + 2] |= value.astype(np.uint8)
    last = base + n_bytes - 1
    out[last] |= ((1 << (-ends[:, -1] & 7)) - 1).astype(np.uint8)
    out = out[:-3]
    # after each 0xFF a zero is stuffed; between intervals of a frame stands a restart marker
    per_frame = lengths // INTERVAL
    frame_of = np.repeat(np.arange(len(lengths)), per_frame)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(per_frame) - per_frame, per_frame)
    heads = [frame_header(int(n) // ACROSS) for n in lengths]
    lead = np.where(within == 0, np.array([len(h) for h in heads])[frame_of] + 2 * (frame_of > 0), 2)
    is_ff = out == 0xFF
    stuffed = np.cumsum(is_ff) - is_ff
    place = np.arange(len(out)) + stuffed + np.repeat(np.cumsum(lead), n_bytes)
    total = len(out) + int(is_ff.sum()) + int(lead.sum()) + 2
    whole = np.zeros(total, np.uint8)
    whole[place] = out
    begins = place[base]
    inner = within > 0
    whole[begins[inner] - 2] = 0xFF
    whole[begins[inner] - 1] = 0xD0 + (within[inner] - 1) % 8
    first = begins[~inner]
    ends_at = np.concatenate([first[1:] - np.array([len(h) for h in heads])[1:], [total]])
    whole[ends_at - 2], whole[ends_at - 1] = 0xFF, 0xD9
    raw = whole.tobytes()
    return [head + raw[a:b] for head, a, b in zip(heads, first.tolist(), ends_at.tolist(), strict=True)]


# --- reading -------------------------------------------------------------------------------------------


@dataclass
class Frame:
    """What the markers of one JPEG say, and where its entropy-coded data lies."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, h, v, quantizer
    quantizers: dict[int, int] = field(default_factory=dict)  # DC step
    tables: dict[int, bytes] = field(default_factory=dict)  # class and place -> lengths and symbols
    interval: int = 0
    scan: list[tuple[int, int, int]] = field(default_factory=list)  # component id, DC table, AC table
    start: int = 0


def parse_markers(data: bytes, at: int = 0) -> Frame:
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    frame, at = Frame(), at + 2
    while True:
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        code = data[at + 1]
        if code == 0xFF:
            at += 1
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if code == 0xC0:
            if body[0] != 8:
                raise ValueError("samples are not of 8 bits")
            frame.height, frame.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame.components = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])]
        elif 0xC1 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG is read")
        elif code == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                frame.quantizers[body[k] & 15] = int.from_bytes(body[k + 1 : k + 2 + wide], "big")
                k += 1 + 64 * (1 + wide)
        elif code == 0xC4:
            k = 0
            while k < len(body):
                n = sum(body[k + 1 : k + 17])
                frame.tables[body[k]] = body[k + 1 : k + 17 + n]
                k += 17 + n
        elif code == 0xDD:
            frame.interval = int.from_bytes(body[:2], "big")
        elif code == 0xDA:
            frame.scan = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            frame.start = at
            return frame
        elif code == 0xD9:
            raise ValueError("the image ends before its scan")


_lookups: dict[bytes, np.ndarray] = {}


def lookup(table: bytes) -> np.ndarray:
    """For each 16-bit prefix: code length << 8 | symbol; 0 where no code fits."""
    if table not in _lookups:
        out, code, k = np.zeros(1 << 16, np.int64), 0, 16
        for n in range(1, 17):
            for _ in range(table[n - 1]):
                out[code << (16 - n) : (code + 1) << (16 - n)] = n << 8 | table[k]
                code, k = code + 1, k + 1
            code <<= 1
        if len(_lookups) > 64:
            _lookups.clear()
        _lookups[table] = out
    return _lookups[table]


def entropy_segments(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes without stuffing and markers, start of each interval in them, data index of each end of image).

    data: entropy-coded data of several frames, each up to and including its end-of-image marker.
    """
    ff = np.flatnonzero(data[:-1] == 0xFF)
    after = data[ff + 1]
    drop = np.zeros(len(data), bool)
    drop[ff[after == 0] + 1] = True
    marks = ff[(after >= 0xD0) & (after <= 0xD9)]
    drop[marks] = drop[marks + 1] = True
    kept = np.cumsum(~drop)
    starts = np.concatenate([[0], kept[marks + 1][:-1]])
    return data[~drop], starts, marks[data[marks + 1] == 0xD9]


def decode_gray(frames: list[Frame], pieces: list[np.ndarray]) -> list[np.ndarray]:
    """DC values (dequantized / 8 + 128, as the thumbnail's samples) of grayscale frames with equal tables."""
    dc, ac = (lookup(frames[0].tables[k << 4 | frames[0].scan[0][1 + k]]) for k in (0, 1))
    blocks = np.array([-(-f.width // 8) * -(-f.height // 8) for f in frames])
    every = np.array([f.interval or n for f, n in zip(frames, blocks, strict=True)])
    lanes = -(-blocks // every)
    data, starts, _ = entropy_segments(np.concatenate(pieces))
    if len(starts) != lanes.sum():
        raise ValueError("restart markers are missing")
    words = np.concatenate([data, np.full(8, 0xFF, np.uint8)]).astype(np.uint32)
    words = words[:-3] << 24 | words[1:-2] << 16 | words[2:-1] << 8 | words[3:]
    lane_frame = np.repeat(np.arange(len(frames)), lanes)
    within = np.arange(len(starts)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    count = np.minimum(every[lane_frame], blocks[lane_frame] - within * every[lane_frame])
    order = np.argsort(-count, kind="stable")
    left = count[order]
    at = (np.concatenate([[0], np.cumsum(blocks)[:-1]])[lane_frame] + within * every[lane_frame])[order]
    bit = starts[order] * 8
    value = np.zeros(len(bit), np.int64)
    out = np.zeros(int(blocks.sum()), np.int64)

    def peek(p: np.ndarray) -> np.ndarray:
        """32 bits from the byte of each place on, with the bits before the place shifted out."""
        return words[p >> 3] << (p & 7).astype(np.uint32)

    for k in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -k, side="left"))
        p = bit[:live]
        w = peek(p)
        found = dc[w >> 16]
        n, size = found >> 8, found & 0xFF
        if not n.all():
            raise ValueError("a code is not in the DC table")
        p = p + n
        extra = np.where(size > 0, (peek(p) >> 16).astype(np.int64) >> (16 - size), 0)
        extra -= np.where((size > 0) & (extra < (1 << size >> 1)), (1 << size) - 1, 0)
        value[:live] += extra
        out[at[:live] + k] = value[:live]
        p = p + size
        found = ac[peek(p) >> 16]
        p = p + (found >> 8)
        more = np.flatnonzero(found & 0xFF)
        done = np.zeros(len(more), np.int64)  # AC coefficients passed
        while len(more):
            symbol = found[more] & 0xFF
            p[more] += symbol & 15
            done = done + (symbol >> 4) + 1
            going = done < 63
            more, done = more[going], done[going]
            found[more] = ac[peek(p[more]) >> 16]
            p[more] += found[more] >> 8
            going = (found[more] & 0xFF) > 0
            more, done = more[going], done[going]
        bit[:live] = p
    steps = np.repeat([f.quantizers[f.components[0][3]] for f in frames], blocks)
    samples = np.clip((out * steps + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return np.split(samples, np.cumsum(blocks)[:-1])


def decode_scalar(frame: Frame, data: bytes) -> np.ndarray:
    """The luminance thumbnail of any baseline scan, one code at a time; for colour images."""
    most_h, most_v = max(c[1] for c in frame.components), max(c[2] for c in frame.components)
    across, down = -(-frame.width // (8 * most_h)), -(-frame.height // (8 * most_v))
    luma = frame.components[0]
    out = np.zeros((down * luma[2], across * luma[1]), np.int64)
    clean, starts, _ = entropy_segments(np.frombuffer(data, np.uint8))
    bits = clean.tobytes() + b"\xff" * 8
    peek = lambda p: int.from_bytes(bits[p >> 3 : (p >> 3) + 3], "big") >> (8 - (p & 7)) & 0xFFFF
    place, value, lane = 0, defaultdict(int), 0
    for mcu in range(across * down):
        if frame.interval and mcu % frame.interval == 0:
            place, lane = int(starts[lane]) * 8, lane + 1
            value.clear()
        for name, dc_at, ac_at in frame.scan:
            dc, ac = lookup(frame.tables[dc_at]), lookup(frame.tables[16 | ac_at])
            component = next(c for c in frame.components if c[0] == name)
            for v in range(component[2]):
                for h in range(component[1]):
                    found = int(dc[peek(place)])
                    size = found & 0xFF
                    place += found >> 8
                    extra = peek(place) >> (16 - size) if size else 0
                    value[name] += extra - ((1 << size) - 1 if size and extra < 1 << (size - 1) else 0)
                    place, k = place + size, 1
                    while k < 64:
                        found = int(ac[peek(place)])
                        place += (found >> 8) + (found & 15)
                        if not found & 0xFF:
                            break
                        k += ((found & 0xFF) >> 4) + 1
                    if component is luma:
                        out[mcu // across * luma[2] + v, mcu % across * luma[1] + h] = value[name]
    out = out[: -(-frame.height // 8), : -(-frame.width // 8)]
    return np.clip((out * frame.quantizers[luma[3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)


def thumbnails(images: list[bytes]) -> list[list[tuple[int, int, np.ndarray]]]:
    """For each stored value (JPEGs one after another): (width, height, DC-only luminance samples) per frame."""
    alike: dict[tuple, list[tuple[int, int, Frame, np.ndarray]]] = defaultdict(list)
    out: list[list] = []
    for i, raw in enumerate(images):
        at, k = 0, 0
        found: list = []
        while at < len(raw):
            frame = parse_markers(raw, at)
            end = raw.index(b"\xff\xd9", frame.start) + 2
            found.append(None)
            if len(frame.components) == 1:
                name, dc_at, ac_at = frame.scan[0]
                key = (frame.tables[dc_at], frame.tables[16 | ac_at])
                alike[key].append((i, k, frame, np.frombuffer(raw, np.uint8, end - frame.start, frame.start)))
            else:
                found[k] = (frame.width, frame.height, decode_scalar(frame, raw[frame.start : end]).ravel())
            at, k = end, k + 1
        out.append(found)
    for members in alike.values():
        for (i, k, frame, _), samples in zip(members, decode_gray([m[2] for m in members], [m[3] for m in members]), strict=True):
            out[i][k] = (frame.width, frame.height, samples)
    return out


def difference_hash(samples: np.ndarray, width: int) -> str:
    """64 bits, as hex: an 8 x 9 grid of means over the thumbnail, each compared with its right neighbour."""
    rows = max(1, len(samples) // width)
    grid = samples[: rows * width].reshape(rows, width).astype(np.int64)
    sums = np.zeros((rows + 1, width + 1), np.int64)
    sums[1:, 1:] = grid.cumsum(0).cumsum(1)
    y, x = np.arange(9) * rows // 8, np.arange(10) * width // 9
    y0, y1, x0, x1 = y[:-1], np.maximum(y[1:], y[:-1] + 1), x[:-1], np.maximum(x[1:], x[:-1] + 1)
    y0, y1 = np.minimum(y0, rows - 1), np.minimum(y1, rows)
    total = sums[y1][:, x1] - sums[y0][:, x1] - sums[y1][:, x0] + sums[y0][:, x0]
    mean = total / ((y1 - y0)[:, None] * (x1 - x0)[None, :])
    return np.packbits((mean[:, 1:] > mean[:, :-1]).ravel()).tobytes().hex()


# --- columns -------------------------------------------------------------------------------------------


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def store_media(docs: DataFrame) -> DataFrame:
    """Rows of MEDIA_SCHEMA: each text's payload as JPEG, with its dimensions and the thumbnail's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in texts_of(batch.column(1))]
            for a, b in slices_by_bytes([len(t) + UNIT for t in texts], SLICE_BYTES):
                payloads = [padded(t) for t in texts[a:b]]
                pieces = [p[k : k + FRAME_BYTES] for p in payloads for k in range(0, len(p), FRAME_BYTES)]
                images: list[bytes] = []
                for c, d in slices_by_bytes([len(p) for p in pieces], SLICE_BYTES):
                    images += encode_frames(np.frombuffer(b"".join(pieces[c:d]), np.uint8), np.array([len(p) for p in pieces[c:d]]))
                media, at = [], 0
                for p in payloads:
                    n = -(-len(p) // FRAME_BYTES)
                    media.append(b"".join(images[at : at + n]))
                    at += n
                hashes = [difference_hash(np.frombuffer(p, np.uint8), ACROSS) for p in payloads]
                heights = [len(p) // ACROSS * 8 for p in payloads]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(t) for t in texts[a:b]], pa.int64()), pa.array(media, pa.binary()), pa.array([8 * ACROSS] * (b - a), pa.int32()), pa.array(heights, pa.int32()), pa.array(hashes)], names=["doc_id", "n_bytes", "media", "width", "height", "thumb_hash"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, MEDIA_SCHEMA)


def read_media(media: DataFrame) -> DataFrame:
    """The contract's rows, computed from the stored JPEGs alone (and n_bytes, which they do not hold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2)
            sizes = [len(v.as_buffer()) for v in stored]
            for a, b in slices_by_bytes(sizes, SLICE_BYTES):
                images = [v.as_py() for v in stored.slice(a, b - a)]
                columns: list[list] = [[], [], [], [], [], []]
                for image, frames in zip(images, thumbnails(images), strict=True):
                    samples = np.concatenate([s for _, _, s in frames])
                    payload = samples.tobytes()
                    width, height = frames[0][0], sum(f[1] for f in frames)
                    feature = f"{width}x{height}:{difference_hash(samples, -(-width // 8))}"
                    for column, value in zip(columns, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *made], names=[c.split()[0] for c in DIGEST_SCHEMA.split(", ")])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)


def media_digests(docs: DataFrame) -> DataFrame:
    return read_media(store_media(docs))
