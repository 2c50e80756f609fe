"""Measures of images: hand-made arrays, plain loops, files."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest

from scorelake.functions import image_constraints as C
from scorelake.functions import image_measures as M
from scorelake.operators import images
from scorelake.sources import requests

RNG = np.random.default_rng(0)
NOISE = RNG.integers(0, 256, (40, 60, 3)).astype(np.uint8)
FLAT = np.full((30, 30, 3), (0, 0, 255), np.uint8)


def _filtered_png(x, kinds):
    h, w, d = x.shape
    lines, above = [], np.zeros(w * d, int)
    for y in range(h):
        line, kind = x[y].reshape(-1).astype(int), kinds[y % len(kinds)]
        left = np.concatenate([np.zeros(d, int), line[:-d]])
        corner = np.concatenate([np.zeros(d, int), above[:-d]])
        if kind == 4:
            p = left + above - corner
            pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        else:
            guess = (0 * line, left, above, (left + above) // 2)[kind]
        lines.append(bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes())
        above = line
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def test_decoding():
    assert np.array_equal(M.decode(images.png(NOISE)), NOISE)
    assert np.array_equal(M.decode(_filtered_png(NOISE, [0, 1, 2, 3, 4])), NOISE)
    assert np.array_equal(M.decode(b"P6 # c\n60 40\n255\n" + NOISE.tobytes()), NOISE)
    assert M.decode(b"P5\n2 1\n255\n\x07\x09").tolist() == [[[7] * 3, [9] * 3]]
    with pytest.raises(ValueError):
        M.decode(b"GIF89a")


def test_colours():
    x = np.array([[(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 255), (0, 0, 0), (200, 100, 50)]], np.uint8)
    assert M.hsv(x)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0], [10, 191, 200]]
    assert M.gray(x)[0].tolist() == [76, 150, 29, 255, 0, 124]
    assert [M.colour_name(c) for c in ((250, 5, 5), (130, 130, 125), (0, 0, 120))] == ["red", "gray", "navy"]
    two = np.concatenate([FLAT, np.full((10, 30, 3), (255, 0, 0), np.uint8)])
    got = M.palette(two)["palette"]
    assert [(c["name"], c["percentage"]) for c in got] == [("blue", 75.0), ("red", 25.0)]
    assert M.histogram(two)["color_entropy"] == pytest.approx(0.811, abs=1e-3) and M.histogram(FLAT)["color_diversity_score"] == 0.0


def test_filters_against_loops():
    g = M.gray(NOISE)[:9, :11]
    p = np.pad(g, 1, mode="reflect")
    want = np.array([[sum(M._SOBEL[a, b] * p[i + a, j + b] for a in range(3) for b in range(3)) for j in range(11)] for i in range(9)])
    assert np.allclose(M.gradients(g)[0], want)
    q = np.pad(g, 3, mode="symmetric")
    assert np.allclose(M._local_std(g), [[q[i : i + 7, j : j + 7].std() for j in range(11)] for i in range(9)])


def test_edges():
    x = np.zeros((40, 40))
    x[:, 20:] = 200
    e = M.edges(x)
    assert e.any(axis=1).all() and e.sum() == 40 and set(np.flatnonzero(e[10])) <= {19, 20}
    faint = np.zeros((40, 40))
    faint[:, 20:] = 10
    assert not M.edges(faint).any()
    mixed = x / 200 * 20  # 80 of gradient: an edge only where it joins a strong one
    assert not M.edges(mixed).any()
    mixed[:3, 20:] = 200
    assert M.edges(mixed)[30].any()


def test_scores():
    assert M.resolution(NOISE)["closest_standard_ratio"] == "3:2" and M.resolution(FLAT)["orientation"] == "square"
    assert M.light(FLAT)["saturation_score"] == 100.0 and M.light(FLAT)["rms_contrast"] == 0.0
    assert M.sharpness(M.gray(FLAT))["blur_detected"] and not M.sharpness(M.gray(NOISE))["blur_detected"]
    sym = np.concatenate([M.gray(NOISE), M.gray(NOISE)[:, ::-1]], axis=1)
    assert M.composition(sym)["horizontal_symmetry"] == 1.0
    sigma = M.noise(np.random.default_rng(1).normal(128, 5, (200, 200)))["estimated_noise_sigma"]
    assert sigma == pytest.approx(5, abs=0.3) and M.noise(np.zeros((2, 2)))["noise_score"] == 100.0


def test_hashes_and_likeness():
    x = RNG.integers(20, 230, (8, 10, 3)).repeat(8, axis=0).repeat(8, axis=1).astype(np.uint8)
    near = np.clip(x.astype(int) + 4, 0, 255).astype(np.uint8)
    a, b, c = M.hashes(x), M.hashes(near), M.hashes(x[:, ::-1])
    assert M.hamming(a["perceptual_hash"], b["perceptual_hash"]) <= 6 < M.hamming(a["difference_hash"], c["difference_hash"])
    assert all(len(v) == 16 for v in a.values())
    own = M.likeness(x, x)
    assert (own["ssim"], own["psnr"], own["perceptual_hash_distance"], own["reference_similarity_score"]) == (1.0, math.inf, 0, 100.0)
    assert M.likeness(x, x[::2, ::2])["ssim"] > 0.85 and M.likeness(x, NOISE)["reference_similarity_score"] < 60
    k = M._cosines(8)
    assert np.allclose(k @ k.T, np.eye(8))


def test_prompts():
    asked = C.parse("A photorealistic laptop, centered on a plain white background, softbox lighting. No text. Exactly 3 paperclips on it, matte-black.")
    assert asked.backgrounds[0] == "white" and asked.composition == "centered" and asked.lighting == "studio" and "photorealistic" in asked.styles
    assert "laptop" in asked.objects and "text" in asked.forbidden and ("paperclips", 3) in asked.counts and "matte-black" in asked.colours
    white = np.full((40, 40, 3), 255, np.uint8)
    found = images.measures(white)
    kept = C.check(white, C.parse("on a white background"), found)
    assert kept["background_color"] == 100.0 and kept["color_presence"] == 100.0 and kept["lighting_adherence"] is None
    assert C.check(white, C.parse("x"), found)["overall_constraint_score"] == 50.0
    assert C.check(FLAT, C.parse("white background"), images.measures(FLAT))["background_color"] == 0.0


def test_evaluation(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(images.png(NOISE))
    (tmp_path / "b.ppm").write_bytes(b"P6\n30 30\n255\n" + FLAT.tobytes())
    (tmp_path / "c.png").write_bytes(b"no image")
    prompts = spark.createDataFrame([("a", "a studio photo", images.png(NOISE)), ("b", None, None), ("c", "x", None)], "name string, prompt string, reference binary")
    rows = images.paired(requests.images(spark, str(tmp_path)), prompts)
    got = {r["name"]: r for r in images.evaluate(rows, ["name"], "content", "prompt", "reference").collect()}
    assert got["c"]["error"] and got["c"]["category_scores"] is None and got["a"]["error"] is None
    a, b = got["a"]["category_scores"], got["b"]["category_scores"]
    assert a["reference_similarity"] == 100.0 and b["reference_similarity"] is None
    parts = [b[k] for k in ("technical_quality", "color_tone", "detail_texture", "composition", "constraint_adherence")]
    assert b["overall"] == round(float(np.mean(parts)), 1)
    assert M.decode(bytes(got["b"]["thumbnail"])).shape == (30, 30, 3) and got["a"]["resolution"]["width"] == 60
