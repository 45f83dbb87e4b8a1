"""Media columns: content-addressed payloads in tar shards, described by small rows.

A payload is a run of 8-bit samples, 192 to a line, kept as a greyscale PNG of that width.  Writers append the
images to tar shards in the shared folder, one image for each distinct digest of a shard, and give back rows with
digest, shard, offset and length.  Everything later works on those rows: metadata columns come from range reads of
the image header alone, and features from range reads of single images.

No payload is shuffled, so copies cost no skew; a shard holds an image once however many rows name it.  Shards get
a name that no other attempt shares, and only the rows of attempts that Spark committed name them, so a lost
executor or a second attempt leaves at worst a shard that nothing refers to.

Nulls and ties: a null text is an empty payload, padded to one line.  Repeated rows and equal texts name one image a
shard and have equal values.  Null ids are kept.  Texts of any length fit, as an image has any number of lines.  An
empty table writes no shard.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ridgeline.llm.common import id_and_text, small
from ridgeline.shared import scratch_path, shuffle_partitions, stage_table

WIDTH = 192
#: A shard is closed beyond this size.
SHARD_BYTES = 256 << 20

_PNG = b"\x89PNG\r\n\x1a\n"
#: Signature, and the whole IHDR chunk.
HEADER_BYTES = len(_PNG) + 25


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit greyscale image of the payload's bytes, ``width`` to a line."""
    lines = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(lines), width + 1), np.uint8)  # a leading 0 a line: no filter
    raw[:, 1:] = lines
    head = struct.pack(">IIBBBBB", width, len(lines), 8, 0, 0, 0, 0)
    return _PNG + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits a sample from the first ``HEADER_BYTES`` of an image."""
    if head[:8] != _PNG or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def decode_png(image: bytes) -> np.ndarray:
    """The samples of an image that ``encode_png`` made, a row a line."""
    width, height, _ = png_header(image)
    at, packed = 8, []
    while at < len(image):
        (n,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    return raw[:, 1:]


def pad(payload: bytes, unit: int = WIDTH) -> bytes:
    """Spaces up to a positive multiple of ``unit``."""
    return payload + b" " * (-len(payload) % unit if payload else unit)


def _store(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, root: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_bytes, digest, shard, offset, length)``, staged in the shared folder."""

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        fs.create_dir(base, recursive=True)
        out, name, at, placed = None, "", 0, {}
        try:
            for batch in small(it):
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    payload = text.encode()
                    image_of = pad(payload)
                    digest = hashlib.sha256(image_of).hexdigest()
                    if digest not in placed:
                        if out is None:
                            name, at = f"{uuid.uuid4().hex}.tar", 0
                            out = fs.open_output_stream(f"{base}/{name}")
                        image = encode_png(image_of)
                        info = tarfile.TarInfo(f"{digest}.png")
                        info.size = len(image)
                        head = info.tobuf(tarfile.USTAR_FORMAT)
                        out.write(head + image + b"\0" * (-len(image) % 512))
                        placed[digest] = (name, at + len(head), len(image))
                        at += len(head) + len(image) + -len(image) % 512
                    rows.append((doc_id, len(payload), digest, *placed[digest]))
                    if at >= shard_bytes:
                        out.write(b"\0" * 1024)
                        out.close()
                        out, placed = None, {}
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _PLACES, strict=True)], schema=_PLACES)
            if out is not None:
                out.write(b"\0" * 1024)
        finally:
            if out is not None:
                out.close()

    names = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    return stage_table(id_and_text(docs).mapInArrow(write, names), "media")


_PLACES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _read_ranges(root: str, extra: pa.Schema, values, only: int | None = None):
    """A mapInArrow function that adds columns made of the stored bytes that each row names.

    Rows best come in the order of shards and offsets, so that reads go forward through one shard at a time and the
    rows of one image meet; what an image gave is remembered for the shard at hand.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _store(root)
        shard, source, known = None, None, {}
        for batch in it:
            made = []
            cols = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("shard", "offset", "length")]
            for name, offset, length in zip(*cols, strict=True):
                if name != shard:
                    if source is not None:
                        source.close()
                    shard, source, known = name, fs.open_input_file(f"{base}/{name}"), {}
                if offset not in known:
                    known[offset] = values(source.read_at(min(length, only or length), offset))
                made.append(known[offset])
            columns = [pa.array(c, t.type) for c, t in zip(zip(*made, strict=True), extra, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], schema=pa.schema([*batch.schema, *extra]))
        if source is not None:
            source.close()

    return run


def in_shard_order(places: DataFrame) -> DataFrame:
    """The rows dealt evenly by shard and offset, each part in the order of its shards."""
    parts = shuffle_partitions(places.sparkSession)
    return places.repartitionByRange(parts, "shard", "offset").sortWithinPartitions("shard", "offset")


def _with(places: DataFrame, names: str, fn) -> DataFrame:
    have = ", ".join(f"{c} {t}" for c, t in places.dtypes)
    return places.where("shard is not null").mapInArrow(fn, f"{have}, {names}")


def header_columns(places: DataFrame, root: str) -> DataFrame:
    """Adds width, height and bits, from the first bytes of each image."""
    extra = pa.schema([("width", pa.int32()), ("height", pa.int32()), ("bits", pa.int32())])
    return _with(places, "width int, height int, bits int", _read_ranges(root, extra, png_header, HEADER_BYTES))


def _features(image: bytes) -> tuple:
    samples = decode_png(image)
    payload = samples.tobytes()
    # Mean sample of a 4 x 4 grid of blocks, two hex digits each.
    rows = np.array_split(samples, 4) if len(samples) >= 4 else [samples] * 4
    cells = [int(part.mean()) for line in rows for part in np.array_split(line, 4, axis=1)]
    return (
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-16:]),
        len(image),
        hashlib.sha256(image).hexdigest(),
        bytes(cells).hex(),
    )


def payload_columns(places: DataFrame, root: str) -> DataFrame:
    """Adds what needs the whole image: sizes, digests of payload and stored form, tail checksum, block means."""
    extra = pa.schema([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    names = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _with(places, names, _read_ranges(root, extra, _features))


def media_table(docs: DataFrame) -> DataFrame:
    """Writes the shards of ``docs`` and gives its media columns, one row for each row of ``docs``."""
    root = scratch_path(docs.sparkSession, "shards")
    places = in_shard_order(write_shards(docs, root))
    return payload_columns(header_columns(places, root), root)
