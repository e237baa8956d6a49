"""Kernels for pictures, sound and containers, in numpy, with their pandas UDFs."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits up to which two picture hashes are one picture: the frequency hash alone, or both.
SAME_BITS, NEAR_BITS, SAME_STEPS = 10, 14, 10


def reduced(grey: np.ndarray, width: int, height: int) -> np.ndarray:
    """Mean grey of each cell of a grid; every pixel is in one cell, and a cell without pixels is 0."""
    h, w = grey.shape
    cell = (np.arange(h) * height // h)[:, None] * width + np.arange(w) * width // w
    n = np.bincount(cell.ravel(), minlength=width * height)
    return (np.bincount(cell.ravel(), grey.ravel(), width * height) / np.maximum(n, 1)).reshape(height, width)


def frequency_hash(grey: np.ndarray) -> int:
    """64 bits: the 8 x 8 lowest frequencies (cosine transform) of a 32 x 32 reduction against the median of all but the first."""
    basis = np.cos(np.pi * (2 * np.arange(32) + 1) * np.arange(8)[:, None] / 64)
    low = (basis @ reduced(grey, 32, 32) @ basis.T).ravel()
    rest = np.sort(low[1:])
    bits = low > (rest[30] + rest[31]) / 2
    return int("".join("1" if b else "0" for b in bits), 2)


def step_hash(grey: np.ndarray) -> int:
    """64 bits: each cell of a 9 x 8 reduction against its right-hand one."""
    g = reduced(grey, 9, 8)
    return int("".join("1" if b else "0" for b in (g[:, :-1] > g[:, 1:]).ravel()), 2)


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


@F.pandas_udf(T.StructType([T.StructField("p", T.LongType()), T.StructField("d", T.LongType())]))
def picture_hashes(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Both hashes of pictures given as bytes of red, green and blue; null without a whole picture."""
    out = []
    for raw, w, h in zip(pixels, width, height):
        if raw is None or pd.isna(w) or pd.isna(h) or w < 1 or h < 1 or len(raw) != 3 * w * h:
            out.append((None, None))
            continue
        grey = luma(np.frombuffer(raw, np.uint8).reshape(int(h), int(w), 3).astype(float))
        out.append(tuple(np.array([x], np.uint64).view(np.int64)[0] for x in (frequency_hash(grey), step_hash(grey))))
    return pd.DataFrame({k: pd.array([o[i] for o in out], "Int64") for i, k in enumerate("pd")})


def bits_apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def same_picture(p1: Column, d1: Column, p2: Column, d2: Column) -> Column:
    p, d = bits_apart(p1, p2), bits_apart(d1, d2)
    return (p <= SAME_BITS) | ((p <= NEAR_BITS) & (d <= SAME_STEPS))


# ---- Sound ----------------------------------------------------------------------------------------


#: Added to the mean square of a window. Fixed value.
LOUDNESS_FLOOR = 1e-6


def envelope(pcm: np.ndarray, window: int = 200) -> np.ndarray:
    """Loudness of each whole window: the logarithm of its root mean square, with a floor that keeps silence finite."""
    n = len(pcm) // window
    return np.log(np.sqrt((pcm[: n * window].astype(float).reshape(n, window) ** 2).mean(1) + LOUDNESS_FLOOR)) if n else np.zeros(0)


def standardised(x: np.ndarray) -> np.ndarray | None:
    """Mean 0 and length 1; None for what doesn't vary."""
    d = x - x.mean() if len(x) else x
    size = np.sqrt((d**2).sum()) if len(d) else 0
    return d / size if size > 1e-9 else None


def stretched(x: np.ndarray, speed: float) -> np.ndarray:
    """What x would be read ``speed`` times as fast, by linear interpolation."""
    n = int(len(x) / speed)
    return np.interp(np.arange(n) * speed, np.arange(len(x)), x) if n > 1 else x[:n]


def best_match(needle: np.ndarray, haystack: np.ndarray, speeds: list[float]) -> tuple[float, int, float]:
    """Highest correlation of the needle, at any of the speeds, with any part of the haystack: score, offset, speed."""
    best, whole = (0.0, -1, 1.0), {}
    # what the haystack says of itself is the same for all speeds
    s1, s2 = (np.concatenate([[0], np.cumsum(haystack**k)]) for k in (1, 2))
    for speed in speeds:
        x = standardised(stretched(needle, speed))
        m = 0 if x is None else len(x)
        if not m or m > len(haystack):
            continue
        size = 1 << (len(haystack) + m - 1).bit_length()
        if size not in whole:
            whole[size] = np.fft.rfft(haystack, size)
        dots = np.fft.irfft(whole[size] * np.conj(np.fft.rfft(x, size)), size)[: len(haystack) - m + 1]
        spread = np.sqrt(np.maximum((s2[m:] - s2[:-m]) - (s1[m:] - s1[:-m]) ** 2 / m, 0))
        score = np.where(spread > 1e-9, dots / np.maximum(spread, 1e-9), 0)
        at = int(score.argmax())
        if score[at] > best[0]:
            best = (float(score[at]), at, speed)
    return best


#: Fixed values of spectra: lowest frequency, share of the rate where the bands end, their number, seconds of a frame and of a
#: part that is lined up on its own, and the energy that keeps a silent band finite.
BAND_LOW, BAND_END, BANDS, FRAME_SECONDS, PART_SECONDS, SILENCE = 100.0, 0.45, 16, 0.064, 8.0, 1e-3


def _power_of_two(n: float) -> int:
    """The least power of two that is not under n."""
    return 1 << max(0, int(np.ceil(np.log2(max(1.0, n)))))


def spectrogram(pcm: np.ndarray, rate: int, frame: int = 1024, hop: int = 256, bands: int = BANDS) -> np.ndarray:
    """Logarithm of the energy in bands of equal musical width, bands x frames."""
    if frame < 1 or hop < 1 or bands < 1 or len(pcm) < frame:
        return np.zeros((max(bands, 0), 0))
    size = _power_of_two(frame)
    edges = np.rint(np.geomspace(BAND_LOW, BAND_END * rate, bands + 1) * size / rate).astype(int)
    edges = np.maximum.accumulate(edges - np.arange(bands + 1)) + np.arange(bands + 1)  # one bin each at least
    frames = np.lib.stride_tricks.sliding_window_view(np.asarray(pcm, float), frame)[::hop] * np.hanning(frame)
    power = np.abs(np.fft.rfft(frames, size, axis=1)[:, : size // 2]) ** 2
    upto = np.concatenate([np.zeros((len(power), 1)), np.cumsum(power, axis=1)], axis=1)[:, np.minimum(edges, size // 2)]
    return np.log(np.diff(upto, axis=1) / frame + SILENCE).T


def spectral_score(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over bands of the correlation of two spectrograms of the same times; bands that don't vary in either are left out."""
    n = min(a.shape[1], b.shape[1])
    if n < 2:
        return 0.0
    pairs = [(standardised(x[:n]), standardised(y[:n])) for x, y in zip(a, b)]
    scores = [float(x @ y) for x, y in pairs if x is not None and y is not None]
    return float(np.mean(scores)) if scores else 0.0


def spectral_match(needle: np.ndarray, haystack: np.ndarray, rate: int, offset: int, speed: float, window: int = 200) -> float:
    """How alike the spectra of a needle are to those of the stretch that best_match found for it (offset in windows, speed).

    The needle is taken in parts, each at the place, within a window of where it should be, that suits it best; the mean.
    """
    frame = _power_of_two(FRAME_SECONDS * rate)
    hop, played = frame // 4, stretched(np.asarray(needle, float), speed)
    part = min(int(PART_SECONDS * rate), len(played))
    if rate < 1 or window < 1 or part < 2 * frame or not len(haystack):
        return 0.0
    scores = []
    for a in range(0, len(played) - part + 1, part):
        own = spectrogram(played[a : a + part], rate, frame, hop)
        starts = [at for at in range(offset * window + a - window, offset * window + a + window + 1, max(1, hop // 2)) if 0 <= at <= len(haystack) - part]
        scores.append(max([0.0, *(spectral_score(own, spectrogram(haystack[at : at + part], rate, frame, hop)) for at in starts)]))
    return float(np.mean(scores)) if scores else 0.0


def quiet(pcm: np.ndarray, window: int = 200, share: float = 0.6, of_peak: float = 0.1) -> bool:
    """Most windows are under a tenth of the loudest."""
    n = len(pcm) // window
    loud = np.sqrt((pcm[: n * window].astype(float).reshape(n, window) ** 2).mean(1)) if n else np.zeros(0)
    return not n or loud.max() == 0 or float((loud < of_peak * loud.max()).mean()) > share


#: How much faster or slower one copy may play, and the step between the speeds tried, in percent.
SPEED_MOST, SPEED_STEP = 3.0, 0.25


def speeds(most: float = SPEED_MOST, step: float = SPEED_STEP) -> list[float]:
    """The speeds that are tried, the slowest first."""
    n = round(most / step)
    return [1 + step * i / 100 for i in range(-n, n + 1)]


@F.pandas_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spectral", T.DoubleType()), T.StructField("offset", T.IntegerType()), T.StructField("speed", T.DoubleType()), T.StructField("quiet", T.BooleanType())]))
def compare_point(needle: pd.Series, haystack: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """One point of two recordings, as arrays of samples of one rate: where the first is found in the second, and how alike their
    loudness and their spectra are there."""
    out = []
    for a, b, hz in zip(needle, haystack, rate):
        a, b = (np.asarray(x if x is not None else [], float) for x in (a, b))
        score, at, speed = best_match(envelope(a), envelope(b), speeds())
        out.append((score, spectral_match(a, b, int(hz), at, speed) if at >= 0 else 0.0, at, speed, quiet(a)))
    return pd.DataFrame(out, columns=["score", "spectral", "offset", "speed", "quiet"]).astype({"offset": "int32"})


#: A point is heard at this envelope score, and found if its spectra are this alike too; medians under the last are apart.
HEARD, ALIKE, APART = 0.7, 0.6, 0.65


def compare_verdict(points: Column, heard: Column, found: Column, median: Column) -> Column:
    """same: four points of five found; different: at most one of five heard and a low median, or most heard but few found."""
    most, few = F.ceil(0.8 * points), F.floor(points / 5)
    return F.when(points == 0, "unsure").when(found >= most, "same").when(((heard <= few) & (median < APART)) | ((heard >= most) & (found <= few)), "different").otherwise("unsure")


# ---- Containers -----------------------------------------------------------------------------------

#: First bytes by container. Fixed values: (offset, bytes).
SIGNATURES = {
    "mp4": (4, b"ftyp"), "ogg": (0, b"OggS"), "flac": (0, b"fLaC"), "wav": (0, b"RIFF"), "asf": (0, bytes.fromhex("3026b275")),
    "matroska": (0, bytes.fromhex("1a45dfa3")), "id3": (0, b"ID3"), "aiff": (0, b"FORM"), "ape": (0, b"MAC "), "audible": (4, bytes.fromhex("57907536")),
}


def container(content: Column) -> Column:
    """Which container bytes open; mp3 for a bare frame, else unknown."""
    out = F.when((F.conv(F.hex(F.substring(content, 1, 2)), 16, 10).cast("int").bitwiseAND(0xFFE0)) == 0xFFE0, "mp3").otherwise("unknown")
    for name, (at, magic) in SIGNATURES.items():
        out = F.when(F.hex(F.substring(content, at + 1, len(magic))) == magic.hex().upper(), name).otherwise(out)
    return out


def mp4_boxes(data: bytes, start: int = 0, stop: int | None = None) -> list[tuple[str, int, int]]:
    """Kind, start and end of the boxes that bytes open; the last may end past what is there."""
    out, at, stop = [], start, len(data) if stop is None else stop
    while at + 8 <= min(stop, len(data)):
        size, kind, head = struct.unpack(">I", data[at : at + 4])[0], data[at + 4 : at + 8].decode("latin-1"), 8
        if size == 1 and at + 16 <= len(data):
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        end = stop if size == 0 else at + size
        if end < at + head:
            break
        out.append((kind, at + head, end))
        at = end
    return out


@F.pandas_udf(T.StructType([T.StructField("locked", T.StringType()), T.StructField("wanted", T.LongType())]))
def mp4_report(content: pd.Series) -> pd.DataFrame:
    """What locks an MP4 (aax, aavd, drms or encrypted; else null), and the size that its boxes ask for."""

    def report(data: bytes) -> tuple[str | None, int | None]:
        boxes = mp4_boxes(data)
        brand = data[8:12].decode("latin-1") if boxes and boxes[0][0] == "ftyp" else ""
        found = next((k for k in ("aavd", "drms", "enca") if k.encode() in data), None)
        return ("aax" if brand.startswith("aax") else {"enca": "encrypted"}.get(found, found)), max((e for _, _, e in boxes), default=None)

    rows = [report(bytes(x)) if x is not None else (None, None) for x in content]
    return pd.DataFrame({"locked": [r[0] for r in rows], "wanted": pd.array([r[1] for r in rows], "Int64")})


#: Fixed values of a shop's ribbon: the grid that a cover is reduced to, least red and green and most blue of its yellow, how
#: much the red may exceed the green, where its middle may lie (0: top left corner, 2: bottom right), how wide half of it may
#: be, how yellow it must be as a whole and in each of four parts, and how yellow what lies beside it may be.
GRID, RED_LEAST, GREEN_LEAST, BLUE_MOST, RED_OVER = 160, 170, 160, 130, 40
MIDDLES, HALVES, SIDE_NEAR, SIDE_FAR = np.arange(1.25, 1.8001, 0.025), np.arange(0.05, 0.1301, 0.01), 0.02, 0.12
INSIDE_LEAST, PART_LEAST, OUTSIDE_MOST, PARTS = 0.45, 0.30, 0.25, 4


def yellow_grid(rgb: np.ndarray) -> np.ndarray:
    """Which cells of the grid show the ribbon's yellow."""
    h, w, _ = rgb.shape
    cells = rgb[(np.arange(GRID) * h // GRID)[:, None], np.arange(GRID) * w // GRID].astype(int)
    r, g, b = cells[..., 0], cells[..., 1], cells[..., 2]
    return (r >= RED_LEAST) & (g >= GREEN_LEAST) & (b <= BLUE_MOST) & (g + RED_OVER >= r)


class _Diagonals:
    """Yellow and all cells by diagonal and part of it, summed up, so that any band is one difference."""

    def __init__(self, yellow: np.ndarray):
        n = len(yellow)
        y, x = np.mgrid[0:n, 0:n]
        part = np.minimum(PARTS - 1, (x - y + n) * PARTS // (2 * n))
        at = ((x + y) * PARTS + part).ravel()
        table = np.stack([np.bincount(at, w, 2 * n * PARTS).reshape(2 * n, PARTS) for w in (yellow.ravel(), None)])
        self.n, self.upto = n, np.concatenate([np.zeros((2, 1, PARTS)), np.cumsum(table, axis=1)], axis=1)

    def share(self, low: float, high: float) -> tuple[float, float]:
        """The yellow share of the band from low to under high, and of its least yellow part."""
        a, z = (int(np.clip(np.ceil(x * self.n - 1e-9), 0, 2 * self.n)) for x in (low, high))
        hit, every = self.upto[:, max(a, z)] - self.upto[:, a]
        return (float(hit.sum() / every.sum()), float((hit[every > 0] / every[every > 0]).min())) if every.sum() else (0.0, 0.0)


def ribbon(rgb: np.ndarray) -> dict[str, float] | None:
    """The ribbon of a cover that stands out most (middle, half, inside, outside), or None."""
    bands, best = _Diagonals(yellow_grid(rgb)), None
    for middle in MIDDLES:
        for half in HALVES:
            inside, least = bands.share(middle - half, middle + half)
            if inside < INSIDE_LEAST or least < PART_LEAST:
                continue
            outside = max(bands.share(middle - half - SIDE_FAR, middle - half - SIDE_NEAR)[0], bands.share(middle + half + SIDE_NEAR, min(2.0, middle + half + SIDE_FAR))[0])
            if outside <= OUTSIDE_MOST and (best is None or inside - outside > best["inside"] - best["outside"]):
                best = {"middle": float(middle), "half": float(half), "inside": inside, "outside": outside}
    return best


@F.pandas_udf(T.BooleanType())
def has_ribbon(pixels: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
    """Whether pictures, given as bytes of red, green and blue, carry the ribbon; false without a whole picture."""
    whole = lambda raw, w, h: raw is not None and not pd.isna(w) and not pd.isna(h) and len(raw) == 3 * int(w) * int(h) > 0
    return pd.Series([whole(r, w, h) and ribbon(np.frombuffer(r, np.uint8).reshape(int(h), int(w), 3)) is not None for r, w, h in zip(pixels, width, height)])
