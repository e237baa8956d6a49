"""Kernels of pictures and sound against plain versions."""

import numpy as np
from pyspark.sql import functions as F

from curatrix.functions import media
from curatrix.operators import files


def banded(middle, half, colour=(250, 230, 40), size=200, art=(30, 60, 120)):
    y, x = np.mgrid[0:size, 0:size]
    s = (x + y) / size
    out = np.full((size, size, 3), art, np.uint8)
    out[(s >= middle - half) & (s < middle + half)] = colour
    return out


def test_ribbons():
    found = media.ribbon(banded(1.5, 0.08))
    assert found and abs(found["middle"] - 1.5) < 0.06 and found["inside"] > 0.9 and found["outside"] < 0.1
    assert media.ribbon(banded(0.5, 0.08)) is None  # the other corner
    assert media.ribbon(banded(1.5, 0.08, (220, 30, 30))) is None  # another colour
    assert media.ribbon(banded(1.5, 0.6)) is None  # a yellow cover
    half = banded(1.5, 0.08)
    half[:, :100] = (30, 60, 120)  # only at one end
    assert media.ribbon(half) is None


def test_bands_equal_plain_counts():
    r = np.random.default_rng(1)
    yellow = r.random((media.GRID, media.GRID)) < 0.4
    bands = media._Diagonals(yellow)
    for low, high in ((1.2, 1.4), (1.55, 1.8), (0.0, 2.0)):
        hit, every = np.zeros(4), np.zeros(4)
        for y in range(media.GRID):
            for x in range(media.GRID):
                if low <= (x + y) / media.GRID < high:
                    k = min(3, (x - y + media.GRID) * 4 // (2 * media.GRID))
                    hit[k] += yellow[y, x]
                    every[k] += 1
        share, least = bands.share(low, high)
        assert abs(share - hit.sum() / every.sum()) < 1e-12 and abs(least - (hit[every > 0] / every[every > 0]).min()) < 1e-12


def test_has_ribbon(spark):
    rows = [(1, banded(1.5, 0.08).tobytes(), 200, 200), (2, banded(1.5, 0.6).tobytes(), 200, 200), (3, b"12", 200, 200), (4, None, None, None)]
    df = spark.createDataFrame([(i, bytearray(p) if p else None, w, h) for i, p, w, h in rows], "i int, p binary, w int, h int")
    assert {r.i: r.x for r in df.select("i", media.has_ribbon("p", "w", "h").alias("x")).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_spectrogram_equals_a_plain_one():
    r = np.random.default_rng(2)
    pcm, rate, frame, hop = r.standard_normal(3000) * 1000, 4000, 256, 64
    edges = [round(np.exp(np.log(100) + (np.log(0.45 * rate) - np.log(100)) * b / 16) * 256 / rate) for b in range(17)]
    for b in range(1, 17):
        edges[b] = max(edges[b], edges[b - 1] + 1)
    got = media.spectrogram(pcm, rate, frame, hop)
    assert got.shape == (16, (3000 - 256) // 64 + 1)
    shape = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(256) / 255)
    for k in (0, 7):
        power = np.abs(np.fft.fft(pcm[k * hop : k * hop + frame] * shape)) ** 2
        want = [np.log(power[a:z][: max(0, 128 - a)].sum() / frame + 1e-3) for a, z in zip(edges, edges[1:])]
        assert np.allclose(got[:, k], want)


def test_spectral_match_tells_voices_apart():
    r = np.random.default_rng(3)
    rate = 4000
    t = np.arange(rate * 40) / rate

    def voice(seed):
        q = np.random.default_rng(seed)
        tones = q.uniform(150, 1500, 6)
        gains = np.repeat(q.random((len(t) // 800, 6)), 800, axis=0)
        return (np.sin(2 * np.pi * t[:, None] * tones) * gains[: len(t)]).sum(1) * 3000 + r.standard_normal(len(t)) * 20

    a, other = voice(1), voice(2)
    needle = a[rate * 10 : rate * 22]
    score, at, speed = media.best_match(media.envelope(needle), media.envelope(a), media.speeds())
    assert score > 0.95 and speed == 1 and at == rate * 10 // 200
    assert media.spectral_match(needle, a, rate, at, speed) > 0.9 > 0.6 > media.spectral_match(needle, other, rate, at, speed)
    assert len(media.speeds()) == 25 and media.speeds()[0] == 0.97
    assert media.spectral_match(needle[:100], a, rate, at, speed) == 0.0


def test_player_values(spark):
    asked = {".mp2": "mp2", ".oga": "speex", ".opus": "vorbis", ".caf": "alac", ".aac": "aac", ".wav": "pcm_s16le", ".m4p": "aac"}
    df = spark.createDataFrame(list(asked.items()), "e string, k string").select("e", files.needs_probe(F.col("e"), F.col("k")).alias("n"))
    got = {r.e: r.n for r in df.collect()}
    assert not got[".mp2"] and not got[".oga"] and not got[".aac"] and got[".opus"] and got[".m4p"] and files.CONTAINERS[".aac"] == "aac"


def test_headers_read_only_the_start(spark, tmp_path):
    from curatrix.sources import catalog

    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "x.m4b").write_bytes(b"0123456789" * 5000)
    (tmp_path / "short.mp3").write_bytes(b"abc")
    got = sorted((r.size, bytes(r.head)) for r in catalog.headers(spark, str(tmp_path), 16).collect())
    assert got == [(3, b"abc"), (50_000, b"0123456789012345")]


def test_written_tables_go(spark):
    import os

    from curatrix.sources import storage

    table = storage.written(spark.range(5), "test")
    assert table.count() == 5 and os.path.exists(table._written)
    storage.dropped(table)
    assert not os.path.exists(table._written)


def test_a_haystack_is_transformed_once(monkeypatch):
    """All speeds share the transform of what is searched (one each before)."""
    seen, rng = [], np.random.default_rng(5)
    hay = rng.normal(size=1500)
    real = np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda x, n=None: seen.append(len(x)) or real(x, n))
    assert media.best_match(hay[700:800], hay, media.speeds())[1:] == (700, 1.0)
    assert seen.count(len(hay)) == 1
