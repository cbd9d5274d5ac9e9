"""Media columns: progressive JPEG in, full-resolution RGB tensors out."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jpeg


#: Pixels of a picture that a worker decodes; a header may claim more than its data can fill.
MAX_PIXELS = 1 << 26


def decode_images(images: DataFrame, media_col: str = "media", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Add ``height, width, rgb`` (row-major bytes of a ``(height, width, 3)`` tensor) and ``error``.

    A null or empty value gives nulls; whatever cannot be decoded (no progressive
    JPEG, cut short, damaged, over ``max_pixels``, of other than one or three
    components or of sampling that is not a whole ratio) gives nulls and the
    reason in ``error``, and never ends the job; all columns stay, those of these
    names are replaced; an empty table gives an empty one.
    """
    new = ("height", "width", "rgb", "error")
    kept = images.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a tensor at a time
                row, (h, w, rgb, error) = batch.slice(i, 1), (None,) * 4
                data = row.column(row.schema.get_field_index(media_col))[0].as_py()
                try:
                    if data:
                        tensor = jpeg.to_rgb(jpeg.decode(data, max_pixels))
                        h, w, rgb = tensor.shape[0], tensor.shape[1], tensor.tobytes()
                except Exception as e:  # noqa: BLE001 - any damage of one picture is that row's
                    error = str(e) or type(e).__name__
                extra = [pa.array([h], pa.int32()), pa.array([w], pa.int32()), pa.array([rgb], pa.binary()), pa.array([error], pa.string())]
                yield pa.RecordBatch.from_arrays([*row.columns, *extra], names=[*row.schema.names, *new])

    extra = "height int, width int, rgb binary, error string"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [extra])
    return kept.mapInArrow(run, schema)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store every whole text in a progressive JPEG, read it back, and describe both.

    The UTF-8 bytes, filled with bytes 0 to a positive multiple of 64, are the
    coefficients of a picture.  Returns ``doc_id, n_bytes, payload_bytes,
    payload_sha256`` (of what is read back), ``tail_crc32, media_bytes,
    media_sha256, feature`` (size, channel sums and checksum of the RGB tensor)
    and, with ``keep_media``, the pictures.  A null or empty text is 64 bytes 0;
    null ids and repeated rows stay; an empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *["media"] * keep_media]
    kinds = ["long", "long", "string", "long", "long", "string", "string", *["binary"] * keep_media]
    arrow = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.binary()] * keep_media]

    def describe(text: str | None) -> tuple:
        raw = (text or "").encode("utf-8", "surrogatepass")
        media = jpeg.store(raw + bytes(-len(raw) % 64 if raw else 64))
        picture = jpeg.decode(media)
        back, rgb = jpeg.stored(picture), jpeg.to_rgb(picture)
        sums = ",".join(map(str, rgb.sum(axis=(0, 1), dtype="int64").tolist()))
        feature = f"{rgb.shape[0]}x{rgb.shape[1]}x3;{sums};{zlib.crc32(rgb)}"
        out = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*out, media) if keep_media else out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 256):
                part = batch.slice(b, 256)
                rows = [describe(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(arrow)]], names=names)

    schema = f"doc_id {rows.schema[0].dataType.simpleString()}, " + ", ".join(f"{n} {k}" for n, k in zip(names[1:], kinds, strict=True))
    return rows.mapInArrow(run, schema)
