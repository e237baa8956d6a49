"""Sizes of pictures from their headers: the byte layouts of PNG, JPEG, GIF and WebP, without decoding."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

PNG, GIF = b"\x89PNG\r\n\x1a\n", (b"GIF87a", b"GIF89a")
#: JPEG markers that start a frame and so carry its size, and those that stand alone, without a length.
FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}
ALONE = {0x01, *range(0xD0, 0xD9)}
SIZE = T.StructType().add("kind", T.StringType()).add("width", T.IntegerType()).add("height", T.IntegerType()).add("wanted", T.LongType())


def size_of(data: bytes) -> tuple[str, int | None, int | None, int | None]:
    """kind, width, height, wanted: how many bytes from the start would tell, where these don't reach; else None.

    Pictures of no known kind are ``unknown``, those that break off or contradict themselves ``broken``; neither has a size.
    """
    if data.startswith(PNG):
        if len(data) < 24:
            return "png", None, None, 24
        if data[12:16] != b"IHDR":
            return "broken", None, None, None
        return _checked("png", *struct.unpack(">II", data[16:24]))
    if data[:6] in GIF:
        return _checked("gif", *struct.unpack("<HH", data[6:10])) if len(data) >= 10 else ("gif", None, None, 10)
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return _webp(data)
    if data[:2] == b"\xff\xd8":
        return _jpeg(data)
    return "unknown", None, None, None


def _checked(kind: str, width: int, height: int) -> tuple[str, int | None, int | None, int | None]:
    return (kind, width, height, None) if width and height else ("broken", None, None, None)


def _webp(data: bytes) -> tuple[str, int | None, int | None, int | None]:
    if len(data) < 30:
        return "webp", None, None, 30
    chunk, body = data[12:16], data[20:30]
    if chunk == b"VP8X":
        return _checked("webp", 1 + int.from_bytes(body[4:7], "little"), 1 + int.from_bytes(body[7:10], "little"))
    if chunk == b"VP8L" and body[0] == 0x2F:
        bits = int.from_bytes(body[1:5], "little")
        return _checked("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF))
    if chunk == b"VP8 " and body[3:6] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", body[6:10])
        return _checked("webp", width & 0x3FFF, height & 0x3FFF)
    return "broken", None, None, None


def _jpeg(data: bytes) -> tuple[str, int | None, int | None, int | None]:
    """Segment by segment: a marker, its length, and so where the next one is. Large profiles may put the frame far in."""
    at = 2
    while True:
        if at + 4 > len(data):
            return "jpeg", None, None, at + 9
        if data[at] != 0xFF:
            return "broken", None, None, None
        marker = data[at + 1]
        if marker == 0xFF:  # padding
            at += 1
        elif marker in ALONE:
            at += 2
        elif marker in FRAMES:
            if at + 9 > len(data):
                return "jpeg", None, None, at + 9
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return _checked("jpeg", width, height)
        elif marker in (0xD9, 0xDA):  # the end, or the picture itself, before any frame
            return "broken", None, None, None
        else:
            length = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if length < 2:
                return "broken", None, None, None
            at += 2 + length


@F.pandas_udf(SIZE)
def picture_size(content: pd.Series) -> pd.DataFrame:
    """struct(kind, width, height, wanted) of the first bytes of a picture; null bytes are ``missing``."""
    rows = [size_of(bytes(x)) if x is not None else ("missing", None, None, None) for x in content]
    return pd.DataFrame({"kind": [r[0] for r in rows], **{n: pd.array([r[k] for r in rows], "Int64") for k, n in ((1, "width"), (2, "height"), (3, "wanted"))}})
