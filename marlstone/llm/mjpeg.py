"""Motion-JPEG in AVI: writing payloads without loss, reading them back, finding shots.

A payload becomes grey frames of 16 x 12 samples of 8 bits. Each frame is a JPEG of
the lossless process (T.81, Annex H: a start of frame SOF3, the left or upper sample
as prediction, Huffman-coded differences); the frames are the ``00dc`` chunks of an AVI
file with an ``idx1`` index. Reading parses the RIFF lists and the index, decodes each
frame on its own and cuts shots where the histograms of neighbouring frames differ by
more than is usual around. Only frames of this size, process and code table are read; any
other JPEG is an error. Frames of many files are coded and decoded side by side in
numpy: one step for each sample of a frame, over all frames at once.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.shingles import raw_bytes, text_slices
from marlstone.llm.storage import small_batches

WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
RATE = 25
#: Bits of the Huffman code of each size category of differences, 0 to 8: 4 bits for the rarer, 3 for the commoner.
_CODE_BITS = [3, 4, 4, 3, 3, 3, 3, 3, 4]
#: Histogram bins; frames on either side whose differences say what is usual; deviations that make a cut.
HIST_BINS, AROUND, DEVIATIONS = 16, 4, 2.0
SLICE = 600_000


def _huffman() -> tuple[list[int], list[int], bytes]:
    """Canonical codes of the categories, their lengths, and the DHT segment that states them."""
    order = sorted(range(9), key=lambda s: (_CODE_BITS[s], s))
    codes, code, bits = [0] * 9, 0, _CODE_BITS[order[0]]
    for s in order:
        code <<= _CODE_BITS[s] - bits
        bits = _CODE_BITS[s]
        codes[s] = code
        code += 1
    counts = bytes(sum(1 for b in _CODE_BITS if b == n) for n in range(1, 17))
    body = b"\x00" + counts + bytes(order)
    return codes, _CODE_BITS, b"\xff\xc4" + struct.pack(">H", len(body) + 2) + body


_CODES, _BITS, _DHT = _huffman()
#: What precedes the coded samples of every frame: SOI, DHT, SOF3 (8 bits, one component), SOS (predictor 1).
_HEAD = (
    b"\xff\xd8" + _DHT + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
    + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0x00, 1, 0, 0)
)


def _difference_codes() -> tuple[np.ndarray, np.ndarray]:
    """For a difference d (at d + 255): its bits and their number; a negative one has its category's bits of d - 1."""
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        code[d + 255] = (_CODES[s] << s) | extra
        length[d + 255] = _BITS[s] + s
    return code, length


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """For the next 12 bits: the difference and the bits it takes."""
    difference, taken = np.zeros(4096, np.int16), np.zeros(4096, np.int64)
    codes, lengths = _difference_codes()
    for d in range(-255, 256):
        n = int(lengths[d + 255])
        low = int(codes[d + 255]) << (12 - n)
        difference[low : low + (1 << (12 - n))], taken[low : low + (1 << (12 - n))] = d, n
    return difference, taken


_D_CODE, _D_BITS = _difference_codes()
_L_DIFF, _L_BITS = _lookup()


def encode_frames(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """JPEG streams of frames (n x FRAME, 8 bits), end to end, and their offsets."""
    n = len(samples)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    grid = samples.reshape(n, HEIGHT, WIDTH).astype(np.int16)
    diff = np.empty_like(grid)
    diff[:, :, 1:] = grid[:, :, 1:] - grid[:, :, :-1]
    diff[:, 1:, 0] = grid[:, 1:, 0] - grid[:, :-1, 0]
    diff[:, 0, 0] = grid[:, 0, 0] - 128
    at = diff.reshape(n, FRAME) + np.int16(255)
    bits = _D_BITS[at]
    ends = np.cumsum(bits, axis=1)
    sizes = (ends[:, -1] + 7) // 8
    base = np.cumsum(sizes) - sizes
    pos = (ends - bits + base[:, None] * 8).ravel()
    shift = (24 - bits.ravel() - (pos & 7)).astype(np.uint32)
    value = _D_CODE[at].ravel() << shift
    byte = pos >> 3
    total = int(sizes.sum())
    body = np.zeros(total + 3, np.uint8)
    first = np.ones(len(byte), bool)
    first[1:] = byte[1:] != byte[:-1]
    begins = np.flatnonzero(first)
    joined = np.bitwise_or.reduceat(value, begins)
    places = byte[begins]
    for k in range(3):  # places are distinct, so each layer is one assignment
        body[places + k] |= ((joined >> np.uint32(16 - 8 * k)) & np.uint32(255)).astype(np.uint8)
    last = base + sizes - 1
    body[last] |= ((1 << ((-ends[:, -1]) % 8)) - 1).astype(np.uint8)  # the last byte is filled with ones
    body = body[:total]
    stuffed = np.flatnonzero(body == 255)
    grown = np.searchsorted(stuffed, np.append(base, total))
    body = np.insert(body, stuffed + 1, 0)
    starts = base + grown[:-1]
    sizes = sizes + np.diff(grown)
    whole = sizes + len(_HEAD) + 2
    offsets = np.append(0, np.cumsum(whole))
    out = np.empty(int(offsets[-1]), np.uint8)
    out[offsets[:-1, None] + np.arange(len(_HEAD))] = np.frombuffer(_HEAD, np.uint8)
    shift_to = np.repeat(offsets[:-1] + len(_HEAD) - starts, sizes)
    out[np.arange(len(body)) + shift_to] = body
    out[offsets[1:] - 2], out[offsets[1:] - 1] = 0xFF, 0xD9
    return out, offsets


def decode_frames(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Samples (n x FRAME) of the JPEG streams at the given places of ``data``."""
    n = len(starts)
    if not n:
        return np.zeros((0, FRAME), np.uint8)
    head = np.frombuffer(_HEAD, np.uint8)
    if (stops - starts < len(_HEAD) + 2).any() or (data[starts[:, None] + np.arange(len(_HEAD))] != head).any():
        raise ValueError("a frame is no lossless JPEG of the expected size and tables")
    sizes = stops - starts - len(_HEAD) - 2
    flat_start = np.cumsum(sizes) - sizes
    body = data[np.arange(int(sizes.sum())) + np.repeat(starts + len(_HEAD) - flat_start, sizes)]
    stuffing = np.zeros(len(body), bool)
    stuffing[1:] = (body[1:] == 0) & (body[:-1] == 255)
    gone = np.append(0, np.cumsum(stuffing))
    base = flat_start - gone[flat_start]
    body = np.append(body[~stuffing], np.zeros(4, np.uint8)).astype(np.uint32)
    words = (body[:-2] << np.uint32(16)) | (body[1:-1] << np.uint32(8)) | body[2:]
    pos = base * 8
    diffs = np.empty((FRAME, n), np.int16)
    for k in range(FRAME):
        at = (words[pos >> 3] >> (12 - (pos & 7)).astype(np.uint32)) & np.uint32(4095)
        diffs[k] = _L_DIFF[at]
        pos = pos + _L_BITS[at]
    grid = diffs.reshape(HEIGHT, WIDTH, n)
    grid[0, 0] += 128
    grid[:, 0] = np.cumsum(grid[:, 0], axis=0, dtype=np.int16)
    return np.cumsum(grid, axis=1, dtype=np.int16).astype(np.uint8).reshape(FRAME, n).T


def avi_head(frames: int, movi: int) -> bytes:
    """The RIFF header up to the first chunk of ``movi``; ``movi``: bytes of its chunks."""
    avih = struct.pack("<14I", 1_000_000 // RATE, FRAME * RATE, 0, 0x10, frames, 0, 1, FRAME * 2, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, frames, FRAME * 2, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    strl = b"strl" + b"strh" + struct.pack("<I", len(strh)) + strh + b"strf" + struct.pack("<I", len(strf)) + strf
    hdrl = b"hdrl" + b"avih" + struct.pack("<I", len(avih)) + avih + b"LIST" + struct.pack("<I", len(strl)) + strl
    rest = 4 + 8 + len(hdrl) + 8 + 4 + movi + 8 + 16 * frames
    return b"RIFF" + struct.pack("<I", rest) + b"AVI LIST" + struct.pack("<I", len(hdrl)) + hdrl + b"LIST" + struct.pack("<I", 4 + movi) + b"movi"


def write_avis(payloads: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """An AVI file for each run of ``counts`` frames of ``payloads`` (all frames x FRAME)."""
    data, offsets = encode_frames(payloads)
    sizes = np.diff(offsets)
    out, f = [], 0
    for count in counts.tolist():
        own = sizes[f : f + count]
        padded = own + (own & 1)
        chunks = np.zeros(int((padded + 8).sum()), np.uint8)
        at = np.cumsum(padded + 8) - padded - 8
        head = np.empty((count, 2), "<u4")
        head[:, 0], head[:, 1] = int.from_bytes(b"00dc", "little"), own
        chunks[at[:, None] + np.arange(8)] = head.view(np.uint8)
        body = data[offsets[f] : offsets[f + count]]
        chunks[np.arange(len(body)) + np.repeat(at + 8 - (offsets[f : f + count] - offsets[f]), own)] = body
        index = np.empty((count, 4), "<u4")
        index[:, 0], index[:, 1], index[:, 2], index[:, 3] = head[:, 0], 0x10, at + 4, own
        out.append(avi_head(count, len(chunks)) + chunks.tobytes() + b"idx1" + struct.pack("<I", 16 * count) + index.tobytes())
        f += count
    return out


def frame_places(avi: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the frames of an AVI file begin and end, from its index, whose offsets count from ``movi`` or from the file's start."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, movi, index = 12, min(len(avi), 8 + struct.unpack_from("<I", avi, 4)[0]), None, None
    while at + 8 <= end:
        kind, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        if kind == b"LIST" and avi[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            index = np.frombuffer(avi, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + (size & 1)
    if movi is None or index is None:
        raise ValueError("an AVI file without frames or index")
    rows = index[index[:, 0] == int.from_bytes(b"00dc", "little")].astype(np.int64)
    base = movi if not len(rows) or avi[movi + int(rows[0, 2]) :][:4] == b"00dc" else 0
    starts = rows[:, 2] + base + 8  # to the chunk behind its head
    return starts, starts + rows[:, 3]


def shot_starts(frames: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """First frame of each shot of each file.

    A frame begins a shot if the histogram differs from the frame before by more than the mean
    of the differences around it by ``DEVIATIONS`` standard deviations (those within
    ``AROUND`` frames, itself left out), is the largest there, and is over a tenth of the samples.
    """
    n = len(frames)
    bins = (frames >> 4).astype(np.int64) + np.arange(n)[:, None] * HIST_BINS
    hist = np.bincount(bins.ravel(), minlength=n * HIST_BINS).reshape(n, HIST_BINS)
    change = np.zeros(n)
    change[1:] = np.abs(hist[1:] - hist[:-1]).sum(axis=1)
    out, f = [], 0
    for count in counts.tolist():
        own = change[f + 1 : f + count]
        f += count
        if len(own) < 2:
            out.append(np.zeros(1, np.int64))
            continue
        wide = np.full((2 * AROUND, len(own)), np.nan)
        for k in range(1, AROUND + 1):
            wide[2 * k - 2, k:] = own[:-k] if k < len(own) else wide[2 * k - 2, k:]
            if k < len(own):
                wide[2 * k - 1, :-k] = own[k:]
        known = ~np.isnan(wide)
        filled = np.where(known, wide, 0)
        number = known.sum(axis=0)
        mean = filled.sum(axis=0) / number
        spread = np.sqrt(np.maximum(0, (filled**2).sum(axis=0) / number - mean**2))
        most = np.where(known, wide, -1).max(axis=0)
        cut = (own > mean + DEVIATIONS * spread) & (own >= most) & (own > FRAME / 10)
        out.append(np.append(0, np.flatnonzero(cut) + 1))
    return out


def payload_frames(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frames of the padded UTF-8 bytes of each text, frames of each text, unpadded sizes."""
    data, offsets = raw_bytes(column)
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // FRAME))
    out = np.full(int(counts.sum()) * FRAME, 32, np.uint8)
    starts = (np.cumsum(counts) - counts) * FRAME
    out[np.arange(len(data)) + np.repeat(starts - offsets[:-1], sizes)] = data
    return out.reshape(-1, FRAME), counts, sizes


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column(1).cast(pa.string())
        for start, stop in text_slices(column, SLICE):
            frames, counts, sizes = payload_frames(column.slice(start, stop - start))
            avis = pa.array(write_avis(frames, counts), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(sizes), avis], ["doc_id", "n_bytes", "avi"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "frames", "shots"]
    for whole in batches:
        column = whole.column(2)
        ends = np.frombuffer(column.buffers()[1], np.int32, count=len(column) + 1 + column.offset)[column.offset :] if len(column) else np.zeros(1, np.int32)
        start = 0
        while start < len(whole):
            stop = max(start + 1, int(np.searchsorted(ends, int(ends[start]) + 2 * SLICE, side="right")) - 1)
            batch = whole.slice(start, stop - start)
            start = stop
            yield _read_batch(batch, names)


def _read_batch(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    avis = batch.column(2).to_pylist()
    places = [frame_places(a) for a in avis]
    counts = np.array([len(p[0]) for p in places])
    base = np.cumsum([0, *(len(a) for a in avis)])
    frames = decode_frames(np.frombuffer(b"".join(avis), np.uint8), *(np.concatenate([p[k] + b for p, b in zip(places, base, strict=False)]) for k in (0, 1)))
    ends = np.cumsum(counts)
    payloads = [frames[e - c : e].tobytes() for c, e in zip(counts, ends, strict=True)]
    shots = shot_starts(frames, counts)
    columns = [
        batch.column(0), batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
        pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array([len(a) for a in avis], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a in avis]),
        pa.array(counts), pa.array([s.tolist() for s in shots], pa.list_(pa.int64())),
    ]
    return pa.RecordBatch.from_arrays(columns, names)


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, avi``: each whole text, in UTF-8 and padded by spaces to whole frames, as an AVI file.

    A null text counts as empty: one frame of spaces. Rows stand as they come, null ids
    too; other columns are ignored; an empty table has an empty result.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_write, f"doc_id {dict(source.dtypes)['doc_id']}, n_bytes long, avi binary")


def read_media(media: DataFrame) -> DataFrame:
    """Payload and file digests, number of frames and first frames of the shots of each AVI file of ``write_media``."""
    return media.mapInArrow(
        _read,
        f"doc_id {dict(media.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, frames long, shots array<long>",
    )


def clips(read: DataFrame) -> DataFrame:
    """A row for each shot: ``doc_id, clip, first_frame, frames, start_s, end_s``."""
    at = read.select("doc_id", F.col("frames").alias("_all"), "shots", F.posexplode("shots").alias("clip", "first_frame"))
    stop = F.coalesce(F.get("shots", F.col("clip") + 1), F.col("_all"))
    return at.select("doc_id", "clip", "first_frame", (stop - F.col("first_frame")).alias("frames"), (F.col("first_frame") / RATE).alias("start_s"), (stop / RATE).alias("end_s"))


def op3_avi_mjpeg_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as AVI files, read back, with their shots as the feature."""
    read = read_media(write_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    cuts = F.concat(F.lit("frames="), F.col("frames"), F.lit(";shots="), F.array_join(F.transform("shots", lambda x: x.cast("string")), ","))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", cuts.alias("feature"))
