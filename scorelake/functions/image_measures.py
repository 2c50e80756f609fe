"""Measures of 8-bit RGB images as arrays (height, width, 3), and of their likeness to a reference image.

Grey values, HSV, gradients and edges follow the common fixed-point definitions of 8-bit image libraries. PNG (8 bits a
channel, not interlaced), PPM and PGM are decoded here; other formats need a library that gives an array.
"""

from __future__ import annotations

import math
import re
import struct
import zlib

import numpy as np

# Names of colours.
COLOURS = {
    "white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "magenta": (255, 0, 255),
    "orange": (255, 165, 0), "purple": (128, 0, 128), "pink": (255, 192, 203), "brown": (139, 69, 19), "gray": (128, 128, 128), "navy": (0, 0, 128), "teal": (0, 128, 128), "olive": (128, 128, 0),
    "maroon": (128, 0, 0), "beige": (245, 245, 220), "ivory": (255, 255, 240), "silver": (192, 192, 192), "gold": (255, 215, 0), "coral": (255, 127, 80), "salmon": (250, 128, 114), "lime": (0, 255, 0),
    "indigo": (75, 0, 130), "violet": (238, 130, 238), "turquoise": (64, 224, 208), "tan": (210, 180, 140), "khaki": (240, 230, 140),
}
# Standard ratios of width to height.
RATIOS = {"1:1": 1.0, "4:3": 4 / 3, "3:2": 3 / 2, "16:9": 16 / 9, "3:4": 3 / 4, "2:3": 2 / 3, "9:16": 9 / 16, "21:9": 21 / 9}


def decode(data: bytes) -> np.ndarray:
    """(height, width, 3) of a PNG, PPM or PGM file."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return _png(data)
    m = re.match(rb"P([56])(?:\s+#[^\n]*\n|\s)+(\d+)(?:\s+#[^\n]*\n|\s)+(\d+)(?:\s+#[^\n]*\n|\s)+(\d+)\s", data)
    if not m or int(m[4]) != 255:
        raise ValueError("not an image of a known format")
    depth, w, h = (3 if m[1] == b"6" else 1), int(m[2]), int(m[3])
    x = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
    return np.repeat(x, 3, axis=2) if depth == 1 else x


def _png(data: bytes) -> np.ndarray:
    at, parts, palette = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            parts.append(body)
    depth = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    if bits != 8 or laced:
        raise ValueError("only PNG files of 8 bits a channel that aren't interlaced")
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * depth)
    rows, above = np.zeros((h, w * depth), np.uint8), np.zeros(w * depth, np.int64)
    for y in range(h):
        above = _unfiltered(int(raw[y, 0]), raw[y, 1:].astype(np.int64), above, depth)
        rows[y] = above
    x = rows.reshape(h, w, depth)
    if colour == 3:
        return palette[x[:, :, 0]]
    return np.repeat(x[:, :, :1], 3, axis=2) if depth < 3 else x[:, :, :3]


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return np.cumsum(line.reshape(-1, depth), axis=0).reshape(-1) & 255
    if kind == 2:
        return (line + above) & 255
    out, up = line.tolist(), above.tolist()
    for i in range(len(out)):
        a, b, c = (out[i - depth], up[i], up[i - depth]) if i >= depth else (0, up[i], 0)
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            guess = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
        out[i] = (out[i] + guess) & 255
    return np.array(out, np.int64)


def gray(x: np.ndarray) -> np.ndarray:
    r, g, b = (x[:, :, i].astype(np.int64) for i in range(3))
    return ((r * 4899 + g * 9617 + b * 1868 + 8192) >> 14).astype(np.float64)


def hsv(x: np.ndarray) -> np.ndarray:
    """Hue of 0 to 179, saturation and value of 0 to 255."""
    x = x.astype(np.int64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    v = x.max(axis=-1)
    d = v - x.min(axis=-1)
    table = lambda k, n: np.concatenate([[0], np.rint((k << 12) / (n * np.arange(1.0, 256.0)))]).astype(np.int64)
    s = (d * table(255, 1)[v] + 2048) >> 12
    h = np.where(v == r, g - b, np.where(v == g, b - r + 2 * d, r - g + 4 * d))
    h = (h * table(180, 6)[d] + 2048) >> 12
    return np.stack([np.where(h < 0, h + 180, h), s, v], axis=-1)


def _filtered(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect") -> np.ndarray:
    """Correlation with a small kernel; the border is mirrored about its pixels, or as `mode` of np.pad says."""
    ky, kx = kernel.shape
    p = np.pad(x, ((ky // 2, ky // 2), (kx // 2, kx // 2)), mode=mode)
    out = np.zeros(x.shape)
    for i in range(ky):
        for j in range(kx):
            if kernel[i, j]:
                out += kernel[i, j] * p[i : i + x.shape[0], j : j + x.shape[1]]
    return out


_SOBEL = np.outer([1.0, 2, 1], [-1.0, 0, 1])
_LAPLACE = np.array([[0.0, 1, 0], [1, -4, 1], [0, 1, 0]])


def gradients(g: np.ndarray, mode: str = "reflect") -> tuple[np.ndarray, np.ndarray]:
    return _filtered(g, _SOBEL, mode), _filtered(g, _SOBEL.T, mode)


def edges(g: np.ndarray, low: float = 50, high: float = 150) -> np.ndarray:
    """Edge pixels: local maxima of the gradient along its direction above `low` that join one above `high`."""
    dx, dy = gradients(g, "edge")
    m = np.abs(dx) + np.abs(dy)
    p = np.pad(m, 1)
    shift = lambda i, j: p[1 + i : 1 + i + m.shape[0], 1 + j : 1 + j + m.shape[1]]
    flat, steep = np.abs(dy) < np.abs(dx) * math.tan(math.pi / 8), np.abs(dy) > np.abs(dx) * math.tan(3 * math.pi / 8)
    same = (dx < 0) == (dy < 0)
    before = np.where(flat, shift(0, -1), np.where(steep, shift(-1, 0), np.where(same, shift(-1, -1), shift(-1, 1))))
    after = np.where(flat, shift(0, 1), np.where(steep, shift(1, 0), np.where(same, shift(1, 1), shift(1, -1))))
    peak = (m > low) & (m > before) & np.where(flat | steep, m >= after, m > after)
    found = peak & (m > high)
    while True:
        q = np.pad(found, 1)
        near = np.zeros_like(found)
        for i in (0, 1, 2):
            for j in (0, 1, 2):
                near |= q[i : i + m.shape[0], j : j + m.shape[1]]
        grown = peak & near
        if (grown == found).all():
            return found
        found = grown


def resolution(x: np.ndarray) -> dict:
    h, w = x.shape[:2]
    ratio, mega = w / h, w * h / 1e6
    name = min(RATIOS, key=lambda k: abs(RATIOS[k] - ratio))
    shape = "square" if abs(w - h) < 10 else "landscape" if w > h else "portrait"
    return {"width": w, "height": h, "aspect_ratio": round(ratio, 3), "closest_standard_ratio": name, "ratio_deviation": round(abs(RATIOS[name] - ratio), 4), "megapixels": round(mega, 2), "orientation": shape, "resolution_score": round(min(100.0, mega / 8.3 * 100), 1)}


def histogram(x: np.ndarray) -> dict:
    out: dict = {}
    for i, name in enumerate(("red", "green", "blue")):
        c = x[:, :, i].astype(np.float64).ravel()
        std = c.std()
        out |= {f"{name}_mean": float(c.mean()), f"{name}_std": float(std), f"{name}_median": float(np.median(c)), f"{name}_skewness": float(((c - c.mean()) ** 3).mean() / (std**3 + 1e-10))}
    q = x.reshape(-1, 3) // 32
    # codes of 8 bits, as defined: the red part wraps
    code = (q[:, 0].astype(np.int64) * 64 % 256 + q[:, 1].astype(np.int64) * 8 + q[:, 2]) % 256
    share = np.bincount(code) / len(code)
    share = share[share > 0]
    entropy = float(-(share * np.log2(share)).sum()) + 0.0
    return out | {"color_entropy": round(entropy, 3), "color_diversity_score": round(min(100.0, entropy / 9 * 100), 1)}


def light(x: np.ndarray) -> dict:
    f, colour = x.astype(np.float64), hsv(x)
    value, saturation = colour[..., 2], colour[..., 1]
    lum = 0.299 * f[..., 0] + 0.587 * f[..., 1] + 0.114 * f[..., 2]
    low, high = float(lum.min()), float(lum.max())
    return {
        "mean_brightness": round(float(value.mean()), 2), "std_brightness": round(float(value.std()), 2), "mean_luminance": round(float(lum.mean()), 2), "rms_contrast": round(float(lum.std()), 2),
        "michelson_contrast": round((high - low) / (high + low + 1e-10), 4), "dynamic_range": round(high - low, 2), "mean_saturation": round(float(saturation.mean()), 2), "std_saturation": round(float(saturation.std()), 2),
        "brightness_score": round(max(0.0, 100 - abs(float(value.mean()) - 130) * 1.2), 1), "contrast_score": round(min(100.0, float(lum.std()) / 80 * 100), 1), "saturation_score": round(min(100.0, float(saturation.mean()) / 128 * 100), 1),
    }


def _local_std(g: np.ndarray, size: int = 7) -> np.ndarray:
    p = np.pad(g, size // 2, mode="symmetric")
    sums = []
    for y in (p, p * p):
        c = np.pad(y.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        sums.append((c[size:, size:] - c[:-size, size:] - c[size:, :-size] + c[:-size, :-size]) / size**2)
    return np.sqrt(np.maximum(sums[1] - sums[0] ** 2, 0))


def detail(g: np.ndarray) -> dict:
    dx, dy = gradients(g)
    m = np.hypot(dx, dy)
    density = float(edges(g).mean())
    return {"edge_density_canny": round(density, 4), "mean_gradient_magnitude": round(float(m.mean()), 2), "texture_complexity": round(float(_local_std(g).mean()), 2), "detail_ratio": round(float((m > np.percentile(m, 75)).mean()), 4), "detail_score": round(min(100.0, density / 0.15 * 100), 1)}


def sharpness(g: np.ndarray) -> dict:
    lap = _filtered(g, _LAPLACE)
    dx, dy = gradients(g)
    spectrum = np.abs(np.fft.fftshift(np.fft.fft2(g)))
    h, w = g.shape
    y, x = np.ogrid[:h, :w]
    outer = (x - w // 2) ** 2 + (y - h // 2) ** 2 > (min(h, w) // 4) ** 2
    variance = float(lap.var())
    return {
        "laplacian_variance": round(variance, 2), "laplacian_mean": round(float(np.abs(lap).mean()), 2), "tenengrad": round(float((dx**2 + dy**2).mean()), 2), "brenner_focus": round(float(((g - np.roll(g, -2, axis=1)) ** 2).mean()), 2),
        "high_freq_ratio": round(float(spectrum[outer].sum() / (spectrum.sum() + 1e-10)), 4), "sharpness_score": round(min(100.0, variance / 1500 * 100), 1), "blur_detected": variance < 100,
    }


def composition(g: np.ndarray) -> dict:
    h, w = g.shape
    e = edges(g)
    near = 0
    for y in (h // 3, 2 * h // 3):
        for x in (w // 3, 2 * w // 3):
            near += int(e[max(0, y - h // 10) : y + h // 10, max(0, x - w // 10) : x + w // 10].sum())
    thirds = min(1.0, near / ((int(e.sum()) + 1e-10) * 0.3))
    mirrored = lambda a, b: 1 - float(np.abs(a - b).mean()) / 255 if a.size else 1.0
    across = mirrored(g[:, : w // 2], g[:, w // 2 : w // 2 * 2][:, ::-1])
    down = mirrored(g[: h // 2], g[h // 2 : h // 2 * 2][::-1])
    total = g.sum() + 1e-10
    cy, cx = float((np.arange(h)[:, None] * g).sum() / total / h), float((np.arange(w)[None] * g).sum() / total / w)
    off = math.hypot(cx - 0.5, cy - 0.5)
    quarters = [q.mean() for q in (g[: h // 2, : w // 2], g[: h // 2, w // 2 :], g[h // 2 :, : w // 2], g[h // 2 :, w // 2 :]) if q.size]
    balance = 1 - float(np.std(quarters)) / 128
    score = min(100.0, max(0.0, thirds * 30 + across * 20 + balance * 25 + (1 - off) * 25))
    return {"rule_of_thirds_adherence": round(thirds, 3), "horizontal_symmetry": round(across, 3), "vertical_symmetry": round(down, 3), "visual_center_x": round(cx, 3), "visual_center_y": round(cy, 3), "center_deviation": round(off, 4), "quadrant_balance": round(balance, 3), "composition_score": round(score, 1)}


def colour_name(rgb) -> str:
    """The nearest named colour."""
    return min(COLOURS, key=lambda k: sum((float(a) - b) ** 2 for a, b in zip(rgb, COLOURS[k], strict=True)))


def palette(x: np.ndarray, colours: int = 6, most: int = 50_000, rounds: int = 50, seed: int = 42) -> dict:
    """Dominant colours by k-means on at most `most` pixels, drawn with a fixed seed, and how well their hues go together."""
    rng = np.random.default_rng(seed)
    pixels = x.reshape(-1, 3).astype(np.float64)
    if len(pixels) > most:
        pixels = pixels[rng.choice(len(pixels), most, replace=False)]
    different, counts = np.unique(pixels, axis=0, return_counts=True)
    centre = different[[0]]
    while len(centre) < min(colours, len(different)):
        far = ((different[:, None] - centre[None]) ** 2).sum(axis=2).min(axis=1) * counts
        centre = np.concatenate([centre, different[[rng.choice(len(different), p=far / far.sum())]]])
    for _ in range(rounds):
        at = ((different[:, None] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        held = np.bincount(at, weights=counts, minlength=len(centre))
        sums = np.stack([np.bincount(at, weights=counts * different[:, i], minlength=len(centre)) for i in range(3)], axis=1)
        new = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centre)
        if np.allclose(new, centre):
            break
        centre = new
    share = held / held.sum()
    order = np.argsort(-share, kind="stable")
    rgb = centre.astype(np.int64)
    hues = [c[0] for c in hsv(rgb[:, None].astype(np.uint8))[:, 0] if c[1] > 20]
    harmony = max(0.0, min(100.0, 100 - float(np.std(hues)) * 0.8)) if len(hues) >= 2 else 80.0
    found = [{"hex": "#{:02x}{:02x}{:02x}".format(*rgb[i]), "name": colour_name(rgb[i]), "percentage": round(float(share[i]) * 100, 1)} for i in order]
    return {"palette": found, "num_dominant_colors": colours, "color_harmony_score": round(harmony, 1)}


def _lanczos(n: int, m: int) -> np.ndarray:
    """(m, n) weights of a Lanczos resampling of n pixels to m, with three lobes, stretched where it shrinks."""
    scale = max(n / m, 1.0)
    at = (np.arange(m)[:, None] + 0.5) * n / m
    d = (np.arange(n)[None] + 0.5 - at) / scale
    w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(g: np.ndarray, h: int, w: int) -> np.ndarray:
    across = np.clip(np.rint(g @ _lanczos(g.shape[1], w).T), 0, 255)
    return np.clip(np.rint(_lanczos(g.shape[0], h) @ across), 0, 255)


def _cosines(n: int) -> np.ndarray:
    k = np.arange(n)
    c = np.cos(np.pi * (2 * k[None] + 1) * k[:, None] / (2 * n)) * math.sqrt(2 / n)
    c[0] /= math.sqrt(2)
    return c


def hashes(x: np.ndarray) -> dict:
    """64-bit hashes as 16 hexadecimal digits: of the mean, of differences, of low frequencies."""
    g = np.rint(x.astype(np.float64) @ np.array([299, 587, 114]) / 1000)
    small, wide, c = resized(g, 8, 8), resized(g, 8, 9), _cosines(32)
    low = (c @ resized(g, 32, 32) @ c.T)[:8, :8]
    bits = {"average_hash": small > small.mean(), "difference_hash": wide[:, :-1] > wide[:, 1:], "perceptual_hash": low > np.median(low)}
    return {k: f"{int(''.join('01'[int(b)] for b in v.ravel()), 2):016x}" for k, v in bits.items()}


def noise(g: np.ndarray) -> dict:
    h, w = g.shape
    if h < 3 or w < 3:
        return {"estimated_noise_sigma": 0.0, "signal_to_noise_ratio": 0.0, "noise_score": 100.0}
    inner = _filtered(g, np.outer([1.0, -2, 1], [1.0, -2, 1]))[1:-1, 1:-1]
    sigma = float(np.abs(inner).sum()) * math.sqrt(0.5 * math.pi) / (6 * (w - 2) * (h - 2))
    return {"estimated_noise_sigma": round(sigma, 3), "signal_to_noise_ratio": round(float(g.std()) / (sigma + 1e-10), 2), "noise_score": round(max(0.0, min(100.0, 100 - sigma * 5)), 1)}


def _area(n: int, m: int) -> np.ndarray:
    """(m, n) shares of n pixels in m."""
    left, right = np.arange(m)[:, None] * n / m, (np.arange(m)[:, None] + 1) * n / m
    w = np.clip(np.minimum(right, np.arange(n)[None] + 1) - np.maximum(left, np.arange(n)[None]), 0, None)
    return w / w.sum(axis=1, keepdims=True)


def fitted(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """An image brought to a size by area averages."""
    if x.shape[:2] == (h, w):
        return x
    rows, cols = _area(x.shape[0], h), _area(x.shape[1], w)
    return np.rint(np.stack([rows @ x[:, :, i].astype(np.float64) @ cols.T for i in range(3)], axis=2)).astype(np.uint8)


def ssim(a: np.ndarray, b: np.ndarray) -> float:
    k = np.exp(-((np.arange(11) - 5.0) ** 2) / (2 * 1.5**2))
    k /= k.sum()
    blur = lambda x: _filtered(_filtered(x, k[None]), k[:, None])
    c1, c2, ma, mb = (0.01 * 255) ** 2, (0.03 * 255) ** 2, blur(a), blur(b)
    va, vb, cov = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
    return float(((2 * ma * mb + c1) * (2 * cov + c2) / ((ma * ma + mb * mb + c1) * (va + vb + c2))).mean())


def hamming(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def likeness(x: np.ndarray, reference: np.ndarray) -> dict:
    """Measures against a reference image. Keypoint matching needs a library and is left out: the other weights are shared anew."""
    y = fitted(reference, *x.shape[:2])
    mse = float(((x.astype(np.float64) - y) ** 2).mean())
    correlation = []
    for i in range(3):
        a, b = (np.bincount(z[:, :, i].ravel(), minlength=256).astype(np.float64) for z in (x, y))
        a, b = a - a.mean(), b - b.mean()
        norm = math.sqrt(float((a * a).sum() * (b * b).sum()))
        correlation.append(float((a * b).sum()) / norm if norm else 1.0)
    same, far = ssim(gray(x), gray(y)), hamming(hashes(x)["perceptual_hash"], hashes(reference)["perceptual_hash"])
    mean = sum(correlation) / 3
    score = min(100.0, (0.35 * same + 0.25 * mean + 0.20 * (1 - far / 64)) / 0.80 * 100)
    return {"ssim": round(same, 4), "mse": round(mse, 2), "psnr": round(10 * math.log10(255**2 / mse), 2) if mse else math.inf, "histogram_correlation": round(mean, 4), "perceptual_hash_distance": far, "perceptual_hash_similarity": round(1 - far / 64, 4), "reference_similarity_score": round(score, 1)}
