"""Media columns: ISO base media files held in a binary column.

``store`` writes payload bytes as raw video samples (8 x 8 pixels of three 8-bit channels, 192 bytes a
frame) into a file of nested boxes. ``describe`` walks the boxes, decodes the sample tables and gives
codec, duration and the byte ranges of keyframes; it never looks at the payload. ``sample_bytes`` reads
the payload back through those tables. Of several tracks the first one counts; samples that movie
fragments hold are in no sample table and aren't listed.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, spread, table, texts, widened

FRAME, SIDE, RATE, KEY_EVERY = 192, 8, 25, 16
#: Boxes lie in one another to this depth at most.
DEPTH = 32
#: Boxes that hold boxes.
NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"mvex", b"moof", b"traf"}
UNITY = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    if size < 1 << 32:
        return b"".join((struct.pack(">I4s", size, kind), *parts))
    return b"".join((struct.pack(">I4sQ", 1, kind, size + 8), *parts))


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def _words(values) -> bytes:
    return np.asarray(values, ">u4").tobytes()


def frames(payload: bytes) -> bytes:
    """A file whose samples are the payload's frames; its length must be a positive multiple of 192."""
    n = len(payload) // FRAME
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")
    data = _box(b"mdat", payload)
    begin = len(head) + len(data) - len(payload)
    chunks = begin + FRAME * KEY_EVERY * np.arange(-(-n // KEY_EVERY), dtype=np.int64)
    wide = chunks[-1] >= 1 << 32
    full, rest = divmod(n, KEY_EVERY)
    runs = [(1, KEY_EVERY, 1)] * bool(full) + [(full + 1, rest, 1)] * bool(rest)
    entry = _box(
        b"raw ",
        struct.pack(">6xH16xHHIIIH32sHh", 1, SIDE, SIDE, 72 << 16, 72 << 16, 0, 1, b"", 24, -1),
    )
    tables = _box(
        b"stbl",
        _full(b"stsd", struct.pack(">I", 1), entry),
        _full(b"stts", struct.pack(">III", 1, n, 1)),
        _full(b"stss", struct.pack(">I", len(chunks)), _words(1 + KEY_EVERY * np.arange(len(chunks)))),
        _full(b"stsc", struct.pack(">I", len(runs)), _words(runs)),
        _full(b"stsz", struct.pack(">II", FRAME, n)),
        _full(b"co64" if wide else b"stco", struct.pack(">I", len(chunks)), chunks.astype(">u8" if wide else ">u4").tobytes()),
    )
    media = _box(
        b"mdia",
        _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, n, 0x55C4, 0)),
        _full(b"hdlr", struct.pack(">I4s12x", 0, b"vide"), b"frames\0"),
        _box(
            b"minf",
            _full(b"vmhd", bytes(8), flags=1),
            _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))),
            tables,
        ),
    )
    track = _full(b"tkhd", struct.pack(">IIIII8xhhhH", 0, 0, 1, 0, n, 0, 0, 0, 0), UNITY, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7)
    movie = _full(b"mvhd", struct.pack(">IIIIIH10x", 0, 0, RATE, n, 0x10000, 0x100), UNITY, bytes(24), struct.pack(">I", 2))
    return b"".join((head, data, _box(b"moov", movie, _box(b"trak", track, media))))


def boxes(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, begin, end) of the contents of every box, outer ones first."""
    if len(path) > DEPTH:
        raise ValueError("boxes are nested too deeply")
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} goes beyond its parent")
        yield (*path, kind), body, stop
        if kind in NESTED:
            yield from boxes(data, body, stop, (*path, kind))
        start = stop


class Track:
    """The sample tables of the first track."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        at: dict[bytes, tuple[int, int]] = {}
        for path, begin, end in boxes(view):
            if path[-1] == b"trak" and b"trak" in at:
                break
            at.setdefault(path[-1], (begin, end))

        def numbers(kind: bytes, skip: int, count: int, width: int = 4) -> np.ndarray:
            """Big-endian numbers in a box; its length is looked at before any array is made."""
            begin, end = at[kind]
            if begin + skip + count * width > end:
                raise ValueError(f"box {kind!r} has fewer entries than it says")
            return np.frombuffer(view, f">u{width}", count, begin + skip).astype(np.int64)

        def listed(kind: bytes, each: int = 1, width: int = 4) -> np.ndarray:
            return numbers(kind, 8, each * int(numbers(kind, 4, 1)[0]), width)

        self.codec = bytes(view[at[b"stsd"][0] + 12 : at[b"stsd"][0] + 16]).decode("latin-1")
        version = view[at[b"mdhd"][0]]
        self.rate, ticks = struct.unpack_from(">IQ" if version else ">II", view, at[b"mdhd"][0] + (20 if version else 12))
        if b"stts" in at:  # how many samples last how long
            ticks = sum(a * b for a, b in listed(b"stts", 2).reshape(-1, 2).tolist())
        self.duration = ticks / self.rate if self.rate else 0.0
        fixed, n = numbers(b"stsz", 4, 2).tolist()
        if fixed * n > len(data):
            raise ValueError("samples are larger than the file")
        self.sizes = np.full(n, fixed) if fixed else numbers(b"stsz", 12, n)
        if self.sizes.sum() > len(data):
            raise ValueError("samples are larger than the file")
        wide = b"stco" not in at
        chunks = listed(b"co64" if wide else b"stco", width=8 if wide else 4)
        runs = listed(b"stsc", 3).reshape(-1, 3)
        firsts = np.append(runs[:, 0], len(chunks) + 1)
        if (np.diff(firsts) < 0).any() or n and firsts[0] != 1:
            raise ValueError("runs of chunks are out of order")
        per_chunk = np.repeat(runs[:, 1], np.diff(firsts))
        ends = np.cumsum(per_chunk)
        if n > (ends[-1] if len(ends) else 0):
            raise ValueError("samples without a chunk")
        # A sample lies behind the samples before it in its chunk.
        before = np.cumsum(self.sizes) - self.sizes
        chunk_of = np.searchsorted(ends, np.arange(n), "right")
        first = (ends - per_chunk)[chunk_of]
        self.offsets = chunks[chunk_of] + before - before[first]
        if ((self.offsets < 0) | (self.offsets > len(data) - self.sizes)).any():
            raise ValueError("a sample lies beyond the file")
        self.keys = listed(b"stss") - 1 if b"stss" in at else np.arange(n)
        if ((self.keys < 0) | (self.keys >= n)).any():
            raise ValueError("a keyframe is no sample")

    def sample_bytes(self, data: bytes) -> bytes:
        ends = self.offsets + self.sizes
        breaks = np.flatnonzero(self.offsets[1:] != ends[:-1]) + 1
        return b"".join(data[self.offsets[a] : ends[b - 1]] for a, b in zip([0, *breaks], [*breaks, len(ends)]) if b > a)

    def key_ranges(self) -> list[tuple[int, int]]:
        return list(zip(self.offsets[self.keys].tolist(), self.sizes[self.keys].tolist()))


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``n_bytes`` and ``media``: the text's bytes, padded with blanks to whole frames, as a file.

    A null or empty text becomes one frame of blanks. Columns of these names are replaced. Repeated rows
    get equal files; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8 << 20):
            raw = [t.encode() for t in texts(batch, text_col)]
            files = [frames(r + b" " * (max(FRAME, -(-len(r) // FRAME) * FRAME) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(r) for r in raw], pa.int64()), pa.array(files, pa.binary())], names=[*batch.schema.names, "n_bytes", "media"])

    docs = docs.drop("n_bytes", "media")
    return docs.mapInArrow(run, widened(docs.schema, ("n_bytes", "long"), ("media", "binary")))


def track_of(data: bytes | None) -> tuple[Track | None, str | None]:
    """The track of a file, or what is wrong with it; neither for null."""
    try:
        return (None, None) if data is None else (Track(data), None)
    except KeyError as e:
        return None, f"no box {e.args[0]!r}"
    except (ValueError, IndexError, OverflowError, struct.error) as e:
        return None, str(e)


def describe(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Add ``codec``, ``duration_s``, ``n_samples``, ``keyframes`` (array of offset and length) and ``error``.

    A cell that is no such file has ``error`` alone, a null cell nothing. Tables are held against the file
    before they are used: counts beyond their box, samples beyond the file or larger than it in sum, keyframes
    that are no samples and boxes nested too deeply are errors. Columns of these names are
    replaced, all others stay; repeated rows get equal values and an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
        for batch in slices(batches):
            both = [track_of(m) for m in batch.column(batch.schema.get_field_index(media_col)).to_pylist()]
            found = [t for t, _ in both]
            new = [
                pa.array([t and t.codec for t in found], pa.string()),
                pa.array([t and t.duration for t in found], pa.float64()),
                pa.array([t and len(t.sizes) for t in found], pa.int64()),
                pa.array([t and [{"offset": a, "length": b} for a, b in t.key_ranges()] for t in found], kind),
                pa.array([e for _, e in both], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, *names])

    names = ["codec", "duration_s", "n_samples", "keyframes", "error"]
    media = media.drop(*names)
    kinds = ("string", "double", "long", "array<struct<offset:bigint,length:bigint>>", "string")
    return media.mapInArrow(run, widened(media.schema, *zip(names, kinds)))


def feature(track: Track) -> str:
    """Codec, duration, number of samples, and the keyframes' ranges: how many, the first, the last and a checksum."""
    ranges = track.key_ranges()
    listed = zlib.crc32(";".join(f"{a}+{b}" for a, b in ranges).encode())
    ends = f"{ranges[0][0]}+{ranges[0][1]}..{ranges[-1][0]}+{ranges[-1][1]}" if ranges else "none"
    return f"codec={track.codec.strip()} duration={track.duration:.2f}s samples={len(track.sizes)} keyframes={len(ranges)} ranges={ends} crc={listed:08x}"


def digests(media: DataFrame) -> DataFrame:
    """What the stored files hold, read back: sizes, digests and the feature text of ``store``'s result.

    A cell that is no such file has its size and digest, ``error``, and no payload. Rows stay one to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for data in batch.column(2).to_pylist():
                track, error = track_of(data)
                own = (len(data), hashlib.sha256(data).hexdigest()) if data is not None else (None, None)
                if track is None:
                    rows.append((None, None, None, *own, None, error))
                    continue
                payload = track.sample_bytes(data)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, feature(track), None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            new = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"
    )


def op4_media(spark, sf_dir):
    """Every text of documents as a media file, read back."""
    return digests(store(spread(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "n_bytes", "media"))
