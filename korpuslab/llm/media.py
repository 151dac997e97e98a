"""Media columns: ISO base media files walked box by box, payloads never decoded.

``probe_bytes`` reads the box tree and the sample tables of a file, or the runs of its
fragments, and gives for every track codec, duration and the byte ranges of its keyframes;
``media_columns`` does so for a binary column. ``wrap_payload`` and ``read_payload`` store a
byte string as an uncompressed 8-bit monochrome track and get it back through the sample
tables.

A null cell gives a null struct; an unreadable file gives a struct whose ``error`` says
why and whose other fields are null. Sizes a file claims are checked against its length
before anything is made from them, and equal sizes are never written out one by one, so a
damaged or hostile file costs no more than its own length. Edit lists and composition times
do not enter durations. Equal bytes give equal results, so repeated rows have repeated
answers; an empty text is one sample of zeros; long texts are long tracks. An empty table
gives an empty result. No row depends on another, so there is no shuffle and a lost task is
simply run again.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from korpuslab.llm.common import quoted


#: Boxes that hold boxes, with the bytes of fixed fields that come before them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
DEEPEST = 16
#: One sample is a picture of 8 x 8 bytes; a group of pictures is one chunk.
SIDE, SAMPLE, GROUP, RATE = 8, 64, 30, 30


class MediaError(ValueError):
    """The bytes are not a readable ISO media file."""


def walk(data: bytes | memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box, depth first: its path of types, and where its body starts and ends."""
    view, at = memoryview(data), start
    end = len(view) if end is None else end
    if len(path) > DEEPEST:
        raise MediaError("boxes are nested too deeply")
    while at < end:
        if end - at < 8:
            raise MediaError("a box header is cut short")
        size, kind = struct.unpack_from(">I4s", view, at)
        head = 8
        if size == 1:
            if end - at < 16:
                raise MediaError("a box header is cut short")
            (size,), head = struct.unpack_from(">Q", view, at + 8), 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            head += 16
        if size < head or at + size > end:
            raise MediaError(f"box {kind.decode('latin-1')} does not fit its parent")
        here, body = (*path, kind), at + head
        yield here, body, at + size
        if kind in CONTAINERS and body + CONTAINERS[kind] <= at + size:
            yield from walk(view, body + CONTAINERS[kind], at + size, here)
        at += size


def _numbers(view: memoryview, at: int, end: int, count: int, kind: str) -> np.ndarray:
    """``count`` big-endian numbers of a table, which must lie inside its box."""
    width = np.dtype(kind).itemsize
    if at + count * width > end:
        raise MediaError("a sample table is cut short")
    return np.frombuffer(view[at : at + count * width], dtype=kind).astype(np.int64)


def _header(view: memoryview, at: int, end: int) -> tuple[int, int]:
    """Time scale and duration of an mdhd or mvhd box."""
    wide = view[at] == 1
    if at + (32 if wide else 20) > end:
        raise MediaError("a media header is cut short")
    return struct.unpack_from(">IQ" if wide else ">II", view, at + (20 if wide else 12))


class Samples:
    """Sample sizes: one number for all, or one for each."""

    def __init__(self, count: int, same: int = 0, each: np.ndarray | None = None):
        self.count, self.same, self.each = count, same, each

    def total(self) -> int:
        return self.count * self.same if self.each is None else int(self.each.sum())

    def upto(self, at: np.ndarray) -> np.ndarray:
        """The bytes of the first ``at`` samples."""
        return at * self.same if self.each is None else np.append(0, np.cumsum(self.each))[at]

    def of(self, at: np.ndarray) -> np.ndarray:
        return np.full(len(at), self.same, np.int64) if self.each is None else self.each[at]


def _sizes(view: memoryview, boxes: dict[bytes, tuple[int, int]]) -> Samples:
    if b"stsz" in boxes:
        at, end = boxes[b"stsz"]
        same, count = struct.unpack_from(">II", view, at + 4)
        samples = Samples(count, same) if same else Samples(count, 0, _numbers(view, at + 12, end, count, ">u4"))
    elif b"stz2" in boxes:
        at, end = boxes[b"stz2"]
        width, count = view[at + 7], struct.unpack_from(">I", view, at + 8)[0]
        if width == 4:
            halves = _numbers(view, at + 12, end, (count + 1) // 2, ">u1")
            samples = Samples(count, 0, np.stack([halves >> 4, halves & 15], 1).ravel()[:count])
        else:
            samples = Samples(count, 0, _numbers(view, at + 12, end, count, {8: ">u1", 16: ">u2"}[width]))
    else:
        raise MediaError("a track has no sample sizes")
    if samples.total() > len(view):
        raise MediaError("samples reach past the end of the file")
    return samples


def _entries(view: memoryview, box: tuple[int, int], kind: str, fields: int = 1) -> np.ndarray:
    """The rows of a table box: a version, a count, and so many numbers each."""
    at, end = box
    return _numbers(view, at + 8, end, fields * struct.unpack_from(">I", view, at + 4)[0], kind).reshape(-1, fields)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(offset, size) of byte ranges, those that follow each other joined."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    at = np.flatnonzero(np.append(True, starts[1:] != (starts + sizes)[:-1]))
    return np.stack([starts[at], np.add.reduceat(sizes, at)], 1)


def _track(view: memoryview, boxes: dict[bytes, tuple[int, int]]) -> dict:
    """What the boxes of one trak say: its chunks as byte ranges in decoding order, and its keyframes."""
    for need in (b"mdhd", b"stsd", b"stsc"):
        if need not in boxes:
            raise MediaError(f"a track has no {need.decode()} box")
    scale, duration = _header(view, *boxes[b"mdhd"])
    at, end = boxes[b"stsd"]
    if at + 16 > end:
        raise MediaError("a sample description is cut short")
    codec = bytes(view[at + 12 : at + 16]).decode("latin-1").strip()
    handler = bytes(view[boxes[b"hdlr"][0] + 8 : boxes[b"hdlr"][0] + 12]).decode("latin-1") if b"hdlr" in boxes else ""
    number = struct.unpack_from(">I", view, boxes[b"tkhd"][0] + (20 if view[boxes[b"tkhd"][0]] == 1 else 12))[0] if b"tkhd" in boxes else 0

    samples = _sizes(view, boxes)
    if b"co64" in boxes:
        chunks = _entries(view, boxes[b"co64"], ">u8")[:, 0]
    elif b"stco" in boxes:
        chunks = _entries(view, boxes[b"stco"], ">u4")[:, 0]
    else:
        raise MediaError("a track has no chunk offsets")
    runs = _entries(view, boxes[b"stsc"], ">u4", 3)
    lasts = np.append(runs[1:, 0], len(chunks) + 1) if len(runs) else np.zeros(0, np.int64)
    if (lasts < runs[:, 0]).any() or (lasts > len(chunks) + 1).any() or (len(runs) and runs[0, 0] < 1):
        raise MediaError("the chunk table is out of order")
    per_chunk = np.repeat(runs[:, 1], lasts - runs[:, 0]) if len(runs) else np.zeros(0, np.int64)
    if len(per_chunk) != len(chunks) or per_chunk.sum() != samples.count:
        raise MediaError("chunks and samples do not add up")
    firsts = np.append(0, np.cumsum(per_chunk))  # the first sample of each chunk
    before = samples.upto(firsts)
    lengths = np.diff(before)
    if len(chunks) and (chunks.min() < 0 or lengths.max() > len(view) or (chunks > len(view) - lengths).any()):
        raise MediaError("samples reach past the end of the file")

    times = 0
    if b"stts" in boxes:
        steps = _entries(view, boxes[b"stts"], ">u4", 2)
        times = sum(a * b for a, b in steps.tolist())  # beyond 64 bits if the file says so
    if b"stss" in boxes:
        sync = _entries(view, boxes[b"stss"], ">u4")[:, 0] - 1
        if len(sync) and (sync.min() < 0 or sync.max() >= samples.count):
            raise MediaError("a keyframe number is out of range")
        chunk = np.searchsorted(firsts, sync, "right") - 1
        keys = np.stack([chunks[chunk] + samples.upto(sync) - before[chunk], samples.of(sync)], 1) if len(sync) else np.zeros((0, 2), np.int64)
    else:  # every sample is a keyframe: neighbouring ones make one range
        keys = _ranges(chunks[per_chunk > 0], lengths[per_chunk > 0])
    return {"number": number, "handler": handler, "codec": codec, "scale": scale, "duration": duration or times, "count": samples.count, "ranges": _ranges(chunks[lengths > 0], lengths[lengths > 0]), "keys": keys}


def _fragment(view: memoryview, start: int, boxes: list[tuple[bytes, int, int]], defaults: dict[int, tuple[int, int, int]], tracks: dict[int, dict], after: int) -> int:
    """Add the runs of one traf to its track; returns where its data ends.

    ``start`` is where the moof box begins; ``after`` where the data of the traf before ends.
    """
    head = next((at for kind, at, _ in boxes if kind == b"tfhd"), None)
    if head is None:
        raise MediaError("a track fragment has no header")
    flags, number = struct.unpack_from(">I", view, head)[0] & 0xFFFFFF, struct.unpack_from(">I", view, head + 4)[0]
    if number not in tracks:
        raise MediaError("a fragment belongs to no track")
    track, at = tracks[number], head + 8
    duration, size, sample_flags = defaults.get(number, (0, 0, 0))
    base = start if flags & 0x20000 else after
    for bit, kind in ((1, ">Q"), (2, ">I"), (8, ">I"), (0x10, ">I"), (0x20, ">I")):
        if flags & bit:
            value = struct.unpack_from(kind, view, at)[0]
            at += struct.calcsize(kind)
            base = value if bit == 1 else base
            duration, size, sample_flags = (value if bit == 8 else duration), (value if bit == 0x10 else size), (value if bit == 0x20 else sample_flags)
    place = base
    for kind, at, end in boxes:
        if kind != b"trun":
            continue
        flags, count = struct.unpack_from(">II", view, at)
        flags, at = flags & 0xFFFFFF, at + 8
        if flags & 1:
            place, at = base + struct.unpack_from(">i", view, at)[0], at + 4
        first = None
        if flags & 4:
            first, at = struct.unpack_from(">I", view, at)[0], at + 4
        given = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
        columns = dict(zip(given, _numbers(view, at, end, count * len(given), ">u4").reshape(-1, max(1, len(given))).T, strict=True)) if given else {}
        samples = Samples(count, 0, columns[0x200]) if 0x200 in columns else Samples(count, size)
        if not given and count > len(view):
            raise MediaError("a run has more samples than the file has bytes")
        if place < 0 or place + samples.total() > len(view):
            raise MediaError("samples reach past the end of the file")
        track["times"] += int(columns[0x100].sum()) if 0x100 in columns else count * duration
        track["count"] += count
        if samples.total():
            track["more"].append(np.array([[place, samples.total()]], np.int64))
        late = 0x10000  # the flag of a sample that is no keyframe
        if 0x400 in columns:
            sync = np.flatnonzero((columns[0x400] & late) == 0)
            if first is not None and count:
                sync = np.append([0] if not first & late else [], sync[sync > 0]).astype(np.int64)
        elif not sample_flags & late and (first is None or not first & late):
            sync = None
        else:
            sync = np.arange(0 if first is None or not first & late else 1, count) if not sample_flags & late else np.arange(int(first is not None and not first & late and count > 0))
        if sync is None:
            track["more_keys"].append(np.array([[place, samples.total()]], np.int64) if count else np.zeros((0, 2), np.int64))
        else:
            track["more_keys"].append(np.stack([place + samples.upto(sync), samples.of(sync)], 1))
        place += samples.total()
    return place


def tracks_of(data: bytes) -> list[dict]:
    """The tracks of a file with their byte ranges and keyframes, in file order; what fragments hold comes after the rest."""
    view = memoryview(data)
    found: list[dict[bytes, tuple[int, int]]] = []
    fragments: list[tuple[int, list]] = []
    extends: dict[int, tuple[int, int, int]] = {}
    kinds, opened = set(), 0
    #: Boxes of a track by where they belong; the same types deeper down (a handler of its metadata) are not the track's.
    own = {b"tkhd": (), b"mdhd": (b"mdia",), b"hdlr": (b"mdia",)} | {k: (b"mdia", b"minf", b"stbl") for k in (b"stsd", b"stts", b"stss", b"stsc", b"stsz", b"stz2", b"stco", b"co64")}
    try:
        for path, start, end in walk(view):
            kinds.add(path[0])
            if path == (b"moof",):
                opened = _box_start(view, start)
            elif path == (b"moof", b"traf"):
                fragments.append((opened, []))
            elif path[:2] == (b"moof", b"traf") and len(path) == 3:
                fragments[-1][1].append((path[-1], start, end))
            elif path == (b"moov", b"mvex", b"trex"):
                number, _, *values = struct.unpack_from(">5I", view, start + 4)
                extends[number] = tuple(values)
            elif path == (b"moov", b"trak"):
                found.append({})
            elif path[:2] == (b"moov", b"trak") and own.get(path[-1]) == path[2:-1]:
                found[-1].setdefault(path[-1], (start, end))
        if b"moov" not in kinds:
            raise MediaError("there is no moov box")
        tracks = [_track(view, boxes) | {"times": 0, "more": [], "more_keys": []} for boxes in found]
        by_number, last, after = {t["number"]: t for t in tracks}, None, 0
        for start, boxes in fragments:
            after = _fragment(view, start, boxes, extends, by_number, after if start == last else start)
            last = start
    except (struct.error, KeyError, IndexError, OverflowError) as error:
        raise MediaError(f"a sample table cannot be read: {error}") from error
    for t in tracks:
        if t["more"] or t["more_keys"]:
            t["ranges"] = np.concatenate([t["ranges"], *t["more"]])
            t["keys"] = np.concatenate([t["keys"], *t["more_keys"]])
            t["duration"] += t["times"]
    return tracks


def _box_start(view: memoryview, body: int) -> int:
    """Where a box whose body is known begins."""
    return body - (16 if body >= 16 and struct.unpack_from(">I", view, body - 16)[0] == 1 and bytes(view[body - 12 : body - 8]) == b"moof" else 8)


def _facts(track: dict) -> dict:
    return {
        "codec": track["codec"],
        "handler": track["handler"],
        "duration_s": track["duration"] / track["scale"] if track["scale"] else 0.0,
        "n_samples": track["count"],
        "keyframes": [{"offset": int(a), "size": int(b)} for a, b in track["keys"]],
    }


def probe_bytes(data: bytes) -> dict:
    """Codec, duration in seconds, sample count and keyframe ranges of the first track with samples, and of all ``tracks``."""
    tracks = tracks_of(data)
    if not tracks:
        raise MediaError("there is no track")
    first = next((t for t in tracks if t["count"]), tracks[0])
    return _facts(first) | {"n_tracks": len(tracks), "tracks": [_facts(t) for t in tracks]}


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    size = len(body) + 8
    return (struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)) + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def pad(payload: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of the sample size."""
    return payload.ljust(max(1, -(-len(payload) // SAMPLE)) * SAMPLE, b"\0")


def wrap_payload(payload: bytes) -> bytes:
    """An ISO media file whose only track holds the payload, a positive multiple of 64 bytes, as it is."""
    if not payload or len(payload) % SAMPLE:
        raise ValueError(f"a payload is a positive multiple of {SAMPLE} bytes")
    count = len(payload) // SAMPLE
    groups = -(-count // GROUP)
    whole, rest = divmod(count, GROUP)
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    # ISO/IEC 23001-17: one monochrome component of 8 bits, planar, untiled
    pixels = _box(b"cmpd", struct.pack(">IH", 1, 0)) + _full(b"uncC", struct.pack(">II", 0, 1), struct.pack(">HBBB", 0, 7, 0, 0), struct.pack(">BBBB", 0, 0, 0, 0), struct.pack(">IIIII", 0, 0, 0, 0, 0))
    entry = _box(b"uncv", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHII", SIDE, SIDE, 0x480000, 0x480000), bytes(4), struct.pack(">H", 1), bytes(32), struct.pack(">Hh", 8, -1), pixels)
    runs = [(1, GROUP, 1)] * bool(whole) + [(whole + 1, rest, 1)] * bool(rest)
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso6mp41")

    def movie(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        starts = np.arange(groups, dtype=np.int64) * (GROUP * SAMPLE) + first
        table = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, count, 1)),
            _full(b"stss", struct.pack(">I", groups), (np.arange(groups) * GROUP + 1).astype(">u4").tobytes()),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, count)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", groups), starts.astype(">u8" if wide else ">u4").tobytes()),
        )
        media = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, count, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"),
            _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), table),
        )
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, count), bytes(16), matrix, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, RATE, count, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2)), track)

    lead = 8 if len(payload) + 8 < 1 << 32 else 16
    length = len(movie(0))  # entries have the same width for every first offset below 4 GB
    length = len(movie(len(head) + length + lead))
    return b"".join((head, movie(len(head) + length + lead), _box(b"mdat", payload)))


def read_payload(data: bytes) -> tuple[bytes, dict]:
    """The samples of the first track, joined, and the track itself."""
    tracks = tracks_of(data)
    if not tracks:
        raise MediaError("there is no track")
    return b"".join(memoryview(data)[a : a + n] for a, n in tracks[0]["ranges"].tolist()), tracks[0]


def features_of(payload: bytes, track: dict) -> str:
    """A short text on stored samples: codec, length, keyframes, and the level and spread of the samples."""
    levels = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = levels[levels > 0] / max(1, len(payload))
    mean = float((levels * np.arange(256)).sum()) / max(1, len(payload))
    bits = abs(float((share * np.log2(share)).sum()))
    keys = zlib.crc32(track["keys"].astype(">i8").tobytes())
    return f"{track['codec']} {track['duration']}/{track['scale']} keys={len(track['keys'])}:{keys:08x} mean={mean:.4f} bits={bits:.4f}"


_TRACK = "codec:string,handler:string,duration_s:double,n_samples:bigint,keyframes:array<struct<offset:bigint,size:bigint>>"
MEDIA = f"struct<{_TRACK},n_tracks:int,tracks:array<struct<{_TRACK}>>,error:string>"


def media_columns(df: DataFrame, column: str, into: str = "media") -> DataFrame:
    """``df`` with a struct column of what the ISO media files in a binary column hold."""
    names = ["codec", "handler", "duration_s", "n_samples", "keyframes", "n_tracks", "tracks", "error"]

    @F.pandas_udf(MEDIA)
    def probe(cells: pd.Series) -> pd.DataFrame:
        rows = []
        for cell in cells:
            try:
                rows.append({"error": "null"} if cell is None else probe_bytes(bytes(cell)))
            except MediaError as error:
                rows.append({"error": str(error)})
        return pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})

    cell = F.col(quoted(column))
    return df.withColumn(into, F.when(cell.isNotNull(), probe(cell)))


STORED = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:bigint,size:bigint>>"


def text_media(docs: DataFrame) -> DataFrame:
    """Every text stored as a media file and read back; a null text is the empty one.

    Needs the columns doc_id and text; others, whatever they are called, play no part.
    """


    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("size", pa.int64())]))]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_s", "keyframes"]
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                stored = wrap_payload(pad(raw))
                back, track = read_payload(stored)
                keys = [{"offset": int(a), "size": int(b)} for a, b in track["keys"]]
                rows.append((doc, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-SAMPLE:]), len(stored), hashlib.sha256(stored).hexdigest(), features_of(back, track), track["codec"], track["duration"] / track["scale"], keys))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, STORED)
