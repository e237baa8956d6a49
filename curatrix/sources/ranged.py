"""Files read in ranges: what a container or picture says of itself, found where its own sizes point, a block at a time."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from curatrix.functions.pictures import size_of

BLOCK = 8192
#: Reads of one file at most; what needs more is told as scattered. The index of an ASF file is read no further than its bound.
READS, ASF_BYTES, PICTURE_BYTES = 40, 1 << 20, 1 << 20

# ---- Fixed values: what locks a track ----

ENTRIES = {"drms": "drms", "aavd": "aavd", "enca": "encrypted"}
SCHEMES = {"itun": "itun", "cenc": "cenc", "cens": "cens", "cbc1": "cbc1", "cbcs": "cbcs", "adrm": "adrm"}
ASF_HEADER = bytes.fromhex("3026b2758e66cf11a6d900aa0062ce6c")
ASF_LOCKS = (bytes.fromhex("fbb3112223bdd211b4b700a0c955fc6e"), bytes.fromhex("14e68a292226174cb935dae07ee9289c"), bytes.fromhex("3385054381 69e6499b74ad12cb86d58c"))


class Ranges:
    """Bytes of one file on demand. Blocks that were read are kept, so walking on within one reads nothing."""

    def __init__(self, source: io.IOBase, size: int, block: int = BLOCK):
        self.source, self.size, self.block, self.held, self.reads, self.bytes = source, size, block, {}, 0, 0

    def at(self, start: int, n: int) -> bytes:
        """n bytes from start, fewer where the file ends."""
        out = b""
        end = min(start + n, self.size)
        while start + len(out) < end:
            here = start + len(out)
            index = here // self.block
            if index not in self.held:
                if self.reads >= READS:
                    raise Scattered
                self.source.seek(index * self.block)
                self.held[index] = self.source.read(self.block)
                self.reads, self.bytes = self.reads + 1, self.bytes + len(self.held[index])
            part = self.held[index][here - index * self.block : here - index * self.block + end - here]
            if not part:
                break
            out += part
        return out


class Scattered(Exception):
    """A file that takes more reads than READS."""


class Broken(Exception):
    """Sizes that can't be."""


def boxes(f: Ranges, start: int, end: int, cut: bool = False) -> Iterator[tuple[str, int, int]]:
    """Kind, start of the body and end of each box between two places. cut: the last may run past the end, as in a file cut short."""
    while start + 8 <= end:
        head = f.at(start, 16)
        if len(head) < 8:
            raise Broken
        size, kind, own = struct.unpack(">I", head[:4])[0], head[4:8].decode("latin-1"), 8
        if size == 1:
            if len(head) < 16:
                raise Broken
            size, own = struct.unpack(">Q", head[8:16])[0], 16
        size = end - start if size == 0 else size
        if size < own or (size > end - start and not cut):
            raise Broken
        yield kind, start + own, start + size
        start += size


def _child(f: Ranges, start: int, end: int, *path: str) -> tuple[int, int] | None:
    for kind in path:
        found = next(((a, z) for k, a, z in boxes(f, start, end) if k == kind), None)
        if found is None:
            return None
        start, end = found
    return start, end


def mp4(f: Ranges) -> tuple[str, int]:
    """What locks a track (empty: nothing), and the size that the boxes ask for. The index may stand first or last."""
    wanted, index, brand = 0, None, ""
    for kind, a, z in boxes(f, 0, f.size, cut=True):
        wanted = max(wanted, z)
        if kind == "ftyp":
            brand = f.at(a, 4).decode("latin-1")
        if kind == "moov" and z <= f.size:
            index = (a, z)
    if brand.startswith("aax"):
        return "aax", wanted
    for kind, a, z in boxes(f, *index) if index else ():
        if kind != "trak":
            continue
        table = _child(f, a, z, "mdia", "minf", "stbl", "stsd")
        for entry, x, y in boxes(f, table[0] + 8, table[1]) if table else ():
            if entry in ENTRIES:
                # a sound entry has 28 bytes of its own before its boxes
                scheme = _child(f, x + 28, y, "sinf", "schm")
                said = f.at(scheme[0] + 4, 4).decode("latin-1") if scheme else ""
                return SCHEMES.get(said, ENTRIES[entry]), wanted
    return "", wanted


def asf(f: Ranges) -> str:
    """drm if the header has one of the objects that encrypt."""
    size = f.at(16, 8)
    if len(size) < 8 or (n := min(struct.unpack("<Q", size)[0], ASF_BYTES)) < 30:
        raise Broken
    header = f.at(0, n)
    return "drm" if any(x in header for x in ASF_LOCKS) else ""


def probed(source: io.IOBase, size: int, block: int = BLOCK) -> dict:
    """container, locked, wanted, error, reads, bytes of a file."""
    f = Ranges(source, size, block)
    out = {"container": "unknown", "locked": "", "wanted": None, "error": ""}
    try:
        head = f.at(0, 16)
        if head[4:8] == b"ftyp":
            out["container"] = "mp4"
            out["locked"], out["wanted"] = mp4(f)
        elif head == ASF_HEADER:
            out["container"] = "asf"
            out["locked"] = asf(f)
    except Broken:
        out["error"] = "broken"
    except Scattered:
        out["error"] = "scattered"
    return out | {"reads": f.reads, "bytes": f.bytes}


def pictured(source: io.IOBase, size: int, block: int = BLOCK) -> dict:
    """kind, width, height, reads, bytes of a picture; read on, up to PICTURE_BYTES, while its header says that more would tell."""
    f = Ranges(source, size, block)
    n = min(block, size)
    while True:
        kind, width, height, wanted = size_of(f.at(0, n))
        if wanted is None or width:
            break
        if n >= size or wanted > PICTURE_BYTES:
            kind = "broken"
            break
        n = min(max(wanted, n + 1), size)
    return {"kind": kind, "width": width, "height": height, "reads": f.reads, "bytes": f.bytes}


def _each(spark: SparkSession, path: str, one: Callable[..., dict], schema: str, block: int) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
        types = [kinds[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            rows = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    where, inside = fs.FileSystem.from_uri(name)
                    with where.open_input_file(inside) as f:
                        rows.append(one(f, size, block))
                except OSError:
                    rows.append({"error": "unread", "kind": "unread"})
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([r.get(n) for r in rows], k) for n, k in zip(names[2:], types[2:])]], names=names)

    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    uri = F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20"))
    return listed.select(uri.alias("path"), F.col("length").alias("size")).mapInArrow(run, schema)


def probes(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """path, size, container, locked, wanted, error, reads, bytes of the files under a path: a task reads only the blocks that lead to the answer.
    Empty files are not listed."""
    return _each(spark, path, probed, "path string, size long, container string, locked string, wanted long, error string, reads int, bytes long", block)


def picture_sizes(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """path, size, kind, width, height, reads, bytes of the pictures under a path; broken, unknown and unread ones have no size."""
    return _each(spark, path, pictured, "path string, size long, kind string, width int, height int, reads int, bytes long", block)
