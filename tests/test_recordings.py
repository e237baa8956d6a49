"""Recordings in chunks against whole arrays."""

import os

import numpy as np
import pytest

from curatrix import curation_queries
from curatrix.functions import media
from curatrix.operators import recordings

RATE, WINDOW, STRETCH, REACH = 400, 20, 30.0, 60.0
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def voice(seed, seconds, rate=RATE):
    """Noise that rises and falls like speech."""
    r = np.random.default_rng(seed)
    loud = np.repeat(r.random(int(seconds * 4)) ** 2 * 9000, rate // 4)
    return (r.standard_normal(len(loud)) * loud).astype(int)


def table(spark, sounds, samples):
    rows = [(i, k, pcm[a : a + samples].tolist()) for i, pcm in sounds.items() for k, a in enumerate(range(0, len(pcm), samples))]
    return spark.createDataFrame(rows, "item_id string, chunk int, pcm array<int>")


def plainly(a, b, n, retries, rate=RATE, window=WINDOW, stretch=STRETCH, reach=REACH):
    """Each point with both recordings whole."""
    out, size = [], int(stretch * rate)
    for p in range(n):
        at = int(np.floor(len(a) * (2 * p + 1) / (2 * n)))
        for k in range(retries + 1):
            needle = a[at : at + size]
            if k == retries or not media.quiet(needle, window) or at + 2 * size > len(a):
                break
            at += size
        wide = max(reach * rate, 0.05 * len(b))
        start = max(0, int(np.floor(at * len(b) / len(a) - wide)))
        hay = b[start : min(len(b), int(np.floor(start + 2 * wide)))]
        score, off, speed = media.best_match(media.envelope(needle, window), media.envelope(hay, window), media.speeds())
        spectral = media.spectral_match(needle, hay, rate, off, speed, window) if off >= 0 else 0.0
        out.append((p, at / rate, score, spectral, speed, (start + off * window) / rate if off >= 0 else None))
    return out


@pytest.mark.parametrize("samples", [333, 5000])
def test_chunks_equal_whole_arrays(spark, samples):
    one = voice(1, 400)
    silent = one.copy()
    silent[30 * RATE : 75 * RATE] = 0  # where the first point is taken
    sounds = {"one": one, "copy": np.concatenate([voice(9, 7), one]), "other": voice(2, 380), "silent": silent, "short": voice(3, 20), "none": np.zeros(0, int)}
    pairs = [("one", "copy"), ("one", "other"), ("silent", "copy"), ("short", "one"), ("one", "none")]
    df = recordings.compared(spark.createDataFrame(pairs, "a_id string, b_id string"), table(spark, sounds, samples), samples, n=4, stretch=STRETCH, reach=REACH, rate=RATE, window=WINDOW).cache()
    got = {}
    for r in df.collect():
        got.setdefault((r.a_id, r.b_id), []).append((r.point, r.at_s, r.score, r.spectral, r.speed, r.found_s))
    assert set(got) == set(pairs[:4])
    for (a, b), rows in got.items():
        for x, y in zip(sorted(rows), plainly(sounds[a], sounds[b], 4, recordings.RETRIES), strict=True):
            assert x[0] == y[0] and x[1] == y[1] and x[5] == y[5] and np.allclose(x[2:5], y[2:5], atol=1e-6), (a, b, x, y)
    assert sorted(got["silent", "copy"])[0][1] > 50  # a quiet stretch is passed over
    told = {(r.a_id, r.b_id): r for r in recordings.verdicts(df).collect()}
    assert told["one", "copy"].verdict == "same" and told["one", "other"].verdict == "different" and told["one", "copy"].found == 4


def test_loudness_in_pieces():
    pcm = voice(5, 30)
    whole = media.envelope(pcm, WINDOW)
    for size in (1, 7, 20, 333, 10_000):
        loud = recordings.Loudness(WINDOW)
        for a in range(0, len(pcm), size):
            loud.add(pcm[a : a + size])
        assert np.allclose(loud.envelope(), whole) and len(loud.left) < WINDOW
    assert len(recordings.Loudness().envelope()) == 0


@pytest.mark.skipif(not os.path.exists(f"{SF}/lineitem.parquet"), reason="needs the supplied tables")
def test_query_equals_whole_arrays(spark):
    sounds = {}
    for r in sorted(curation_queries.supplier_sound(spark, SF).collect(), key=lambda r: (r.item_id, r.chunk)):
        sounds[r.item_id] = np.concatenate([sounds.get(r.item_id, np.zeros(0, int)), r.pcm])
    p = curation_queries.SOUND
    got = curation_queries.recording_verdicts(spark, SF).collect()
    assert len(got) == sum(1 for i in sounds if i[0] == "s") + sum(f"s{int(i[1:]) + 1}" in sounds for i in sounds if i[0] == "s")
    for r in got:
        rows = plainly(sounds[r.a_id], sounds[r.b_id], p["n"], recordings.RETRIES, p["rate"], p["window"], p["stretch"], p["reach"])
        heard = [x for x in rows if x[2] >= media.HEARD]
        assert (r.points, r.heard, r.found) == (len(rows), len(heard), sum(x[3] >= media.ALIKE for x in heard))
        assert np.isclose(r.median, np.median([x[2] for x in rows]), atol=1e-6) and np.isclose(r.spectral_median, np.median([x[3] for x in rows]), atol=1e-6)
