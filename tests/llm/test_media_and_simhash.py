"""JPEG media columns by exact round trip; SimHash links and components against all pairs."""

import hashlib
import io
import zlib
from collections import Counter

import numpy as np
import pytest

SMALL = "/root/testdata/sf0.001"


def pad(t):
    b = t.encode()
    return b + b"\xff" * (-len(b) % 576 if b else 576)


def test_frames_round_trip():
    from stratadoc.llm import media_jpeg as M

    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 576 * k, np.uint8).tobytes() for k in (1, 2, 7)] + [b"\xff" * 576, b"\0\xff" * 576, b"\0" * 1152]
    images = M.encode_frames(np.frombuffer(b"".join(payloads), np.uint8), np.array([len(p) for p in payloads]))
    for image, payload, frames in zip(images, payloads, M.thumbnails(images)):
        ((width, height, samples),) = frames
        assert samples.tobytes() == payload and width * height == 64 * len(payload) and image.endswith(b"\xff\xd9")
        assert M.decode_scalar(M.parse_markers(image), image[M.parse_markers(image).start :]).tobytes() == payload


def plain_jpeg(blocks, across, interval=0, colour=False):
    """A baseline encoder of our own for given quantized blocks [DC, AC1, ...], with several AC symbols."""
    from stratadoc.llm import media_jpeg as M

    dc = M.canonical({k: 4 for k in range(12)})
    ac = M.canonical({s: 5 for s in (0x00, 0xF0, 0x01, 0x11, 0x22, 0x53)})
    bits, out, pred = "", b"", [0, 0, 0]

    def flush():
        nonlocal bits, out
        bits += "1" * (-len(bits) % 8)
        out += bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0")
        bits = ""

    def number(v):
        n = abs(v).bit_length()
        return n, format(v if v >= 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    step = 3 if colour else 1
    for i, block in enumerate(blocks):
        if interval and i and i % (interval * step) == 0:
            flush()
            out += bytes([0xFF, 0xD0 + (i // (interval * step) - 1) % 8])
            pred = [0, 0, 0]
        n, extra = number(block[0] - pred[i % step])
        pred[i % step] = block[0]
        bits += format(dc[n][0], f"0{dc[n][1]}b") + extra
        run = 0
        coefficients = list(block[1:])
        while coefficients and not coefficients[-1]:
            coefficients.pop()
        for v in coefficients:
            if not v:
                run += 1
                continue
            n, extra = number(v)
            code = ac[run << 4 | n]
            bits += format(code[0], f"0{code[1]}b") + extra
            run = 0
        if len(coefficients) < 63:
            bits += format(ac[0][0], f"0{ac[0][1]}b")
    flush()
    n = 3 if colour else 1
    lines = len(blocks) // n // across
    head = b"\xff\xd8" + M.marker(0xFE, b"comment") + M.marker(0xDB, b"\0" + bytes([4] * 64))
    head += M.marker(0xC0, b"\x08" + (8 * lines).to_bytes(2, "big") + (8 * across).to_bytes(2, "big") + bytes([n]) + b"".join(bytes([k + 1, 0x11, 0]) for k in range(n)))
    head += M.marker(0xC4, M.table_body(0, {k: 4 for k in range(12)}) + M.table_body(0x10, {s: 5 for s in (0x00, 0xF0, 0x01, 0x11, 0x22, 0x53)}))
    head += (M.marker(0xDD, interval.to_bytes(2, "big")) if interval else b"") + M.marker(0xDA, bytes([n]) + b"".join(bytes([k + 1, 0]) for k in range(n)) + b"\0\x3f\0")
    return head + out + b"\xff\xd9"


@pytest.mark.parametrize("interval,colour", [(0, False), (3, False), (0, True), (2, True)])
def test_general_scans(interval, colour):
    from stratadoc.llm import media_jpeg as M

    rng = np.random.default_rng(interval)
    blocks = []
    for _ in range(24):
        block = [int(rng.integers(-200, 200))] + [0] * 63
        for place, value in zip((1, 3, 6, 12), (1, -1, 3, 5)):  # runs 0, 1, 2, 5
            if rng.random() < 0.6:
                block[place] = value
            else:
                break
        blocks.append(block)
    image = plain_jpeg(blocks, 4, interval, colour)
    ((width, _, samples),) = M.thumbnails([image])[0]
    luma = [b[0] for b in (blocks[::3] if colour else blocks)]
    assert width == 32 and samples.tolist() == [min(255, max(0, (v * 4 + 4) // 8 + 128)) for v in luma]


def test_long_payloads_take_several_frames():
    from stratadoc.llm import media_jpeg as M

    payload = bytes(range(256)) * 1800
    pieces = [payload[k : k + M.FRAME_BYTES] for k in range(0, len(payload), M.FRAME_BYTES)]
    image = b"".join(M.encode_frames(np.frombuffer(payload, np.uint8), np.array([len(p) for p in pieces])))
    (frames,) = M.thumbnails([image])
    assert len(frames) == len(pieces) > 1 and b"".join(s.tobytes() for _, _, s in frames) == payload


def test_media_query(spark):
    from stratadoc.llm.media_jpeg import media_digests, store_media

    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    odd = [(-1, None), (None, ""), (-2, "é" * 288), (-3, "\xff" * 300_000), (-4, "same"), (-4, "same"), (-5, "same")]
    df = df.union(spark.createDataFrame(odd, df.schema))
    want = Counter()
    for r in df.collect():
        p = pad(r.text or "")
        want[(r.doc_id, len((r.text or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))] += 1
    got = media_digests(df).collect()
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in got if r.doc_id in (-4, -5)}) == 1
    stored = {(r.doc_id, r.n_bytes): f"{r.width}x{r.height}:{r.thumb_hash}" for r in store_media(df).collect()}
    assert all(stored[(r.doc_id, r.n_bytes)] == r.feature for r in got)
    assert media_digests(spark.createDataFrame([], df.schema)).count() == 0


def brute_print(text):
    import xxhash

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h)) if h else 0


def brute_components(prints):
    """smallest id of each print's component, all pairs compared."""
    values = sorted(set(prints))
    a = np.array(values, np.uint64)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            parent[find(i)] = find(int(j))
    return {v: find(i) for i, v in enumerate(values)}


def planted_prints(seed, n=3000):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, n, np.uint64)
    near = a[: n // 3].copy()
    for k in range(3):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    ball = np.uint64(0x1234_5678_9ABC_DEF0) ^ (np.uint64(1) << rng.integers(0, 24, n // 3).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 24, n // 3).astype(np.uint64))
    return np.unique(np.concatenate([a, near, ball, [np.uint64(0), np.uint64(7), np.uint64(15)]]))


def test_gray_index_finds_all_components():
    from stratadoc.llm.simhash_dedup import GrayIndex, gray_rank

    assert gray_rank(np.array([0, 1, 3, 2, 6, 7, 5, 4], np.uint64)).tolist() == list(range(8))
    for seed in range(3):
        fps = planted_prints(seed)
        roots = GrayIndex(fps).components()
        brute = brute_components([int(x) for x in fps])
        pairs = {(int(r), brute[int(f)]) for r, f in zip(roots, fps)}
        assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


@pytest.mark.parametrize("hot", [4096, 20])
def test_links_and_components(spark, hot):
    from stratadoc.llm.simhash_dedup import components_of

    fps = planted_prints(5)
    df = spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(fps.view(np.int64))], "doc_id long, fp long")
    brute = brute_components([int(x) for x in fps])
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(brute[int(f)], i)
    got = {r.fp: r.component_id for r in components_of(spark, df, hot).collect()}
    assert got == {int(s): first[brute[int(f)]] for s, f in zip(fps.view(np.int64), fps)}


def test_chain_of_links(spark):
    from stratadoc.llm.simhash_dedup import components_of

    fps = [(1 << (k * 1)) - 1 for k in range(64)]  # a chain by one bit from end to end
    df = spark.createDataFrame([(100 - i, f if f < 1 << 63 else f - (1 << 64)) for i, f in enumerate(fps)], "doc_id long, fp long")
    assert {r.component_id for r in components_of(spark, df).collect()} == {37}


def test_near_duplicates(spark):
    from stratadoc.llm.simhash_dedup import near_duplicates

    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    long = " ".join(f"w{i}" for i in range(4000))
    odd = [(5000, None), (5001, ""), (5002, " \t"), (5003, "one"), (5004, "One"), (5005, "two words"), (5006, long), (5007, long + " tail"), (None, "one"), (None, "alone here now ok"), (5003, "one")]
    df = df.union(spark.createDataFrame(odd, df.schema))
    rows = [(r.doc_id, brute_print(r.text)) for r in df.collect()]
    brute = brute_components([f for _, f in rows])
    first = {}
    for i, f in rows:
        if i is not None:
            first[brute[f]] = min(i, first.get(brute[f], i))
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in near_duplicates(spark, df).collect())
    assert got == Counter((i, f"{f:016x}", first.get(brute[f])) for i, f in rows)
    assert near_duplicates(spark, spark.createDataFrame([], df.schema)).count() == 0
