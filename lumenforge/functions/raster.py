"""Whole rasters as numpy arrays, for Arrow batches: resizing, tensors, features, wavelets, corner marks.

Definitions are those of ``lumenforge.operators.pixels``; tests hold both to each
other. A raster is uint8[height, width, 3]; nothing here keeps state between rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# ---- sizes ----------------------------------------------------------------------


@lru_cache(64)
def _weights(n: int, m: int, kind: str) -> np.ndarray:
    """m rows of weights over n samples; kept for the sizes that were asked for last."""
    centre = (np.arange(m) + 0.5) * n / m - 0.5
    if kind == "lanczos":
        wide = max(1.0, n / m)
        d = (np.arange(n)[None, :] - centre[:, None]) / wide
        w = np.where(np.abs(d) < 3, np.sinc(d) * np.sinc(d / 3), 0.0)
    else:
        w = np.maximum(0.0, 1.0 - np.abs(np.arange(n)[None, :] - np.clip(centre, 0, n - 1)[:, None]))
    return w / w.sum(1, keepdims=True)


def resize(rgb: np.ndarray, width: int, height: int, kind: str = "bilinear") -> np.ndarray:
    """Stretch, without a crop. kind: 'bilinear' or 'lanczos'."""
    h, w = rgb.shape[:2]
    out = (_weights(h, height, kind) @ rgb.reshape(h, -1).astype(np.float64)).reshape(height, w, -1)
    out = _weights(w, width, kind) @ out
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def short_side_crop(rgb: np.ndarray, short: int = 440, crop: int = 384, kind: str = "bilinear") -> np.ndarray:
    """The shorter side to ``short``, then the middle ``crop`` by ``crop``; what lies outside is black."""
    h, w = rgb.shape[:2]
    scale = short / max(1, min(h, w))
    nw, nh = max(1, int(np.floor(w * scale + 0.5))), max(1, int(np.floor(h * scale + 0.5)))
    big = resize(rgb, nw, nh, kind)
    x, y = max(0, (nw - crop) // 2), max(0, (nh - crop) // 2)
    out = np.zeros((crop, crop, 3), np.uint8)
    part = big[y : y + crop, x : x + crop]
    out[: part.shape[0], : part.shape[1]] = part
    return out


def box_downsample(rgb: np.ndarray, most: int = 256, least: int = 32) -> np.ndarray:
    """Area average over integer bins; an image that is small enough stays as it is."""
    h, w = rgb.shape[:2]
    scale = min(1.0, most / max(h, w))
    nw, nh = max(least, int(np.floor(w * scale + 0.5))), max(least, int(np.floor(h * scale + 0.5)))
    if (nw, nh) == (w, h):
        return rgb

    def bins(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
        a = np.arange(m) * n // m
        return a, np.maximum(a + 1, (np.arange(m) + 1) * n // m)

    total = np.zeros((h + 1, w + 1, 3))
    total[1:, 1:] = rgb.astype(np.float64).cumsum(0).cumsum(1)
    (y0, y1), (x0, x1) = bins(h, nh), bins(w, nw)
    box = total[y1][:, x1] - total[y0][:, x1] - total[y1][:, x0] + total[y0][:, x0]
    area = (y1 - y0)[:, None, None] * (x1 - x0)[None, :, None]
    return np.floor(box / area + 0.5).astype(np.uint8)


def tensor(rgb: np.ndarray, mean: tuple[float, ...] = (0.5, 0.5, 0.5), std: tuple[float, ...] = (0.5, 0.5, 0.5)) -> np.ndarray:
    """float32[3, height, width], normalised by channel."""
    x = (rgb.astype(np.float64) / 255.0 - np.array(mean)) / np.array(std)
    return np.ascontiguousarray(x.transpose(2, 0, 1)).astype(np.float32)


# ---- features -------------------------------------------------------------------


def luma(rgb: np.ndarray) -> np.ndarray:
    p = rgb.astype(np.float64)
    return (0.299 * p[..., 0] + 0.587 * p[..., 1] + 0.114 * p[..., 2]).astype(np.float32)


def spectrum(v: np.ndarray) -> np.ndarray:
    if len(v) & (len(v) - 1):
        raise ValueError("the length must be a power of two")
    return np.abs(np.fft.fft(v))[: len(v) // 2].astype(np.float32)


def high_frequency(row: np.ndarray) -> float:
    n = 1
    while n < len(row):
        n *= 2
    padded = np.zeros(n)
    padded[: len(row)] = row
    mags = spectrum(padded - padded.mean()).astype(np.float64)
    high, all_ = mags[int(len(mags) * 0.35) :].sum(), mags[1:].sum()
    return float(high / (all_ + 1e-6))


def _top_share(keys: np.ndarray) -> tuple[int, float]:
    n = np.bincount(keys, minlength=1)
    n = np.sort(n[n > 0])[::-1]
    return len(n), float(n[:8].sum() / n.sum()) if len(n) else 0.0


def _buttons(rgb: np.ndarray) -> float:
    h, w = rgb.shape[:2]
    part = rgb[: min(h, max(12, int(h * 0.1))), : min(w, max(48, int(w * 0.2)))].astype(int)
    r, g, b = part[..., 0], part[..., 1], part[..., 2]
    red = (r > 140) & (r > g + 40) & (r > b + 40)
    yellow = ~red & (r > 140) & (g > 100) & (g > b + 30) & (r > b + 30)
    green = ~red & ~yellow & (g > 120) & (g > r + 25) & (g > b + 15)
    xs = [np.sort(np.nonzero(m)[1]) for m in (red, yellow, green)]
    if min(map(len, xs)) < 4:
        return 0.0
    mid = [int(x[len(x) // 2]) for x in xs]
    d1, d2 = mid[1] - mid[0], mid[2] - mid[1]
    if d1 < 4 or d2 < 4 or abs(d1 - d2) > max(4, 0.45 * max(d1, d2)):
        return 0.0
    return 1.0 if all(np.abs(x - m).mean() < 10 for x, m in zip(xs, mid)) else 0.7


NAMES = ("hf", "lap", "chroma", "block", "axis", "colors", "share", "f_axis", "f_share", "f_colors", "center_share", "chrome")


def features(rgb: np.ndarray) -> dict[str, float]:
    """The twelve features, the score and a detail; below 32 pixels a side 0.5 and zeros."""
    h, w = rgb.shape[:2]
    if w < 32 or h < 32:
        return dict.fromkeys(NAMES, 0.0) | {"colors": 0, "f_colors": 0, "score": 0.5, "detail": "too-small"}
    p, l = rgb.astype(np.int64), luma(rgb).astype(np.float64)
    out: dict[str, float] = {"hf": high_frequency(l[h // 2])}
    response = np.abs(4 * l[1:-1, 1:-1] - l[:-2, 1:-1] - l[2:, 1:-1] - l[1:-1, :-2] - l[1:-1, 2:]).astype(np.float32)
    out["lap"] = float(response.astype(np.float64).var())
    top = p.max(2)
    out["chroma"] = float(1 - np.where(top > 0, (top - p.min(2)) / np.maximum(1, top), 0).mean())
    diff, edge = np.abs(np.diff(l, axis=1)), (np.arange(w - 1) + 1) % 8 == 0
    out["block"] = float(np.clip(diff[:, edge].mean() / (diff[:, ~edge].mean() + 1e-3) / 4, 0, 1))
    inner = p[1:-1, 1:-1]
    gx, gy = np.abs(inner - p[1:-1, 2:]).sum(2), np.abs(inner - p[2:, 1:-1]).sum(2)
    straight, both = ((gx >= 40) & (gy < 20)) | ((gy >= 40) & (gx < 20)), (gx >= 40) & (gy >= 40)
    y, x = np.mgrid[1 : h - 1, 1 : w - 1]
    frame = (x < max(8, int(w * 0.2))) | (y < max(8, int(h * 0.12)))
    centre = (x >= w // 4) & (x < int(w * 0.75)) & (y >= h // 4) & (y < int(h * 0.75))
    ratio = lambda a, b: float(a / (a + b)) if a + b else 0.0
    out["axis"], out["f_axis"] = ratio(straight.sum(), both.sum()), ratio((straight & frame).sum(), (both & frame).sum())
    key = (inner[..., 0] >> 4) * 256 + (inner[..., 1] >> 4) * 16 + (inner[..., 2] >> 4)
    out["colors"], out["share"] = _top_share(key.reshape(-1))
    out["f_colors"], out["f_share"] = _top_share(key[frame])
    out["center_share"] = _top_share(key[centre])[1]
    out["chrome"] = _buttons(rgb)
    unit = lambda v: min(1.0, max(0.0, v))
    raw = 0.34 * unit(1 - out["hf"] / 0.55) + 0.28 * unit(1 - out["lap"] / 120) + 0.22 * unit((out["chroma"] - 0.35) / 0.45) + 0.16 * unit((out["block"] - 0.25) / 0.5)
    return out | {"score": unit(0.15 + 0.7 * raw), "detail": "ok"}


def stub(rgb: np.ndarray) -> float:
    """The reproducible head."""
    p = rgb[::2, ::2].astype(np.float64)
    if not p.size:
        return 0.9
    y = p @ np.array([0.299, 0.587, 0.114])
    var = max(0.0, float((y * y).mean() - y.mean() ** 2))
    colour = float(((p.max(2) - p.min(2)) / 255).mean())
    real = 0.85 * min(1.0, var / 2200) + 0.15 * min(1.0, colour / 0.55)
    return float(np.clip(0.9 - real * 0.8, 0.05, 0.95))


# ---- wavelets and the six-channel tensor ----------------------------------------

#: The reconstruction low-pass filter of Daubechies' wavelet with four vanishing moments, and the carriers' places.
LOW = np.array([0.2303778133088965, 0.7148465705529157, 0.6308807679298589, -0.027983769416859854, -0.18703481171909309, 0.030841381835560764, 0.0328830116668852, -0.010597401785069032])
CARRIERS = ((14, 14), (-14, -14), (126, 14), (-126, -14), (98, -14), (-98, 14), (128, 128), (-128, -128))
HIGH = LOW[::-1] * np.where(np.arange(8) % 2, -1.0, 1.0)


def dwt(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    """Approximation and detail along an axis, with symmetric extension."""
    x = np.moveaxis(x, axis, -1)
    n, f = x.shape[-1], len(LOW)
    ext = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(f - 1, f - 1)], mode="symmetric")
    at = 2 * np.arange((n + f - 1) // 2)[:, None] + f - np.arange(f)[None, :]
    window = ext[..., at]
    return np.moveaxis(window @ LOW[::-1], -1, axis), np.moveaxis(window @ HIGH[::-1], -1, axis)


def idwt(a: np.ndarray, d: np.ndarray, axis: int, n: int) -> np.ndarray:
    a, d = np.moveaxis(a, axis, -1), np.moveaxis(d, axis, -1)
    f, up = len(LOW), 2 * a.shape[-1]
    rec = np.zeros((*a.shape[:-1], up + f - 1))
    for k in range(f):
        rec[..., k : k + up : 2] += LOW[k] * a + HIGH[k] * d
    return np.moveaxis(rec[..., f - 2 : f - 2 + n], -1, axis)


def soft(x: np.ndarray, t: float | np.ndarray) -> np.ndarray:
    return np.sign(x) * np.maximum(np.abs(x) - t, 0.0)


def denoise(x: np.ndarray, levels: int = 3) -> np.ndarray:
    """Universal threshold from the finest level's horizontal-low, vertical-high band, for each plane of [..., size, size] its own."""
    size, cur, kept = x.shape[-2], x, []
    for _ in range(levels):
        low, high = dwt(cur, -1)
        (ll, lh), (hl, hh) = dwt(low, -2), dwt(high, -2)
        kept.append((lh, hl, hh, cur.shape[-2:]))
        cur = ll
    t = np.median(np.abs(kept[0][0]), axis=(-2, -1), keepdims=True) / 0.6745 * np.sqrt(2 * np.log(size * size))
    for lh, hl, hh, (h, w) in reversed(kept):
        low, high = idwt(cur, soft(lh, t), -2, h), idwt(soft(hl, t), soft(hh, t), -2, h)
        cur = idwt(low, high, -1, w)
    return cur


def log_magnitude(gray: np.ndarray) -> np.ndarray:
    v = np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(gray))))
    return ((v - v.min()) / (v.max() - v.min() + 1e-8)).astype(np.float32)


def carrier_mask(size: int) -> np.ndarray:
    out, c = np.zeros((size, size), np.float32), size // 2
    for fy, fx in CARRIERS:
        for y, x in ((c + fy, c + fx), (c - fy, c - fx)):
            if 0 <= y < size and 0 <= x < size:
                out[y, x] = 1
    return out


def mark_tensor(rgb: np.ndarray, size: int = 512) -> np.ndarray:
    """float32[6, size, size]: colours, mean residual of denoising, spectrum, carriers; never a non-finite number."""
    x = resize(rgb, size, size).astype(np.float64)
    planes = [x[..., c] / 255 for c in range(3)]
    residual = sum(p - q for p, q in zip(planes, denoise(np.stack(planes)))) / 3
    gray = np.clip(np.floor(x @ np.array([0.299, 0.587, 0.114]) + 0.5), 0, 255) / 255
    out = np.stack([*planes, residual, log_magnitude(gray), carrier_mask(size)]).astype(np.float32)
    return np.nan_to_num(out, nan=0.0, posinf=1.0, neginf=-1.0)


# ---- marks burnt into corners ---------------------------------------------------

#: Glyphs of 5 by 7 points, in the order in which ties are settled.
GLYPHS = [
    ("0", "01110100011000110001100010111000000"), ("1", "00100011000010000100001001111100000"), ("2", "01110100010000100100010001111100000"), ("3", "11111000100011000001000011111000000"), ("4", "10001100011111100001000010000100000"),
    ("5", "11111100001111000001000011111000000"), ("6", "01111100001111010001100010111000000"), ("7", "11111000010001000100010001000000000"), ("8", "01110100010111010001100010111000000"), ("9", "01110100011000101111000011111000000"),
    ("A", "01110100011000111111100011000110001"), ("B", "11110100011111010001100011111000000"), ("C", "01111100001000010000100000111100000"), ("D", "11110100011000110001100011111000000"), ("E", "11111100001111010000100001111100000"),
    ("F", "11111100001111010000100001000000000"), ("G", "01111100001000010111100011011100000"), ("H", "10001100011111110001100011000100000"), ("I", "11111001000010000100001001111100000"), ("J", "00111000100001000010000101111000000"),
    ("K", "10001100101110010100100101000100000"), ("L", "10000100001000010000100001111100000"), ("M", "10001110111010110001100011000100000"), ("N", "10001110011010110011100011000100000"), ("O", "01110100011000110001100010111000000"),
    ("P", "11110100011111010000100001000000000"), ("Q", "01110100011000110001101010111000001"), ("R", "11110100011111010001100011000100000"), ("S", "01111100000111000001000011111000000"), ("T", "11111001000010000100001000010000000"),
    ("U", "10001100011000110001100010111000000"), ("V", "10001100011000101010010100010000000"), ("W", "10001100011000110101110111000100000"), ("X", "10001101010010000100101011000100000"), ("Y", "10001100010101000100001000010000000"),
    ("Z", "11111000100010001000100001111100000"), ("·", "00000000000010000100000000000000000"), (".", "00000000000000000000001000010000000"), ("-", "00000000000111100000000000000000000"),
]
_BITS = np.array([[c == "1" for c in bits] for _, bits in GLYPHS])
#: Phrases of marks, in order of priority.
PHRASES = [
    "grok", "xai", "chatgpt", "openai", "dalle", "dall·e", "dall-e", "midjourney", "firefly", "adobefirefly", "ideogram", "gemini", "imagen", "imagefx", "copilot", "designer", "leonardo", "leonardoai", "nightcafe", "craiyon", "bing", "recraft", "runway",
    "runwayml", "luma", "lumalabs", "flux", "stablediffusion", "stabilityai", "dreamstudio", "wombo", "starryai", "clipdrop", "canva", "novelai", "perchance", "synthesia", "aigenerated", "generatedwithai", "createdwithai", "madewithai", "generatedbyai",
    "madewithmidjourney", "createdwithchatgpt", "generatedbygrok",
]


def glyphs(bits: np.ndarray, most: int = 29) -> np.ndarray:
    """bits: one band. Runs of columns with any bit, 2 pixels to 2.2 times the height wide, sampled at 5 by 7 points."""
    h = bits.shape[0]
    edge = np.diff(np.concatenate([[0], bits.any(0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = (end - begin >= 2) & (end - begin <= h * 2.2)
    out = []
    for a, b in list(zip(begin[keep], end[keep]))[:most]:
        x = a + ((np.arange(5) + 0.5) * ((b - a) / 5)).astype(int)
        y = ((np.arange(7) + 0.5) * (h / 7)).astype(int)
        out.append(bits[np.ix_(y, x)].reshape(-1))
    return np.array(out, bool).reshape(-1, 35)


def read_glyphs(g: np.ndarray, least: float = 0.58) -> str:
    """The best glyph for each, the first of the table among equals; '?' unless more than ``least`` of the points agree."""
    agree = (g[:, None, :] == _BITS[None]).mean(2) if len(g) else np.zeros((0, len(GLYPHS)))
    return "".join(GLYPHS[k][0] if row[k] > least else "?" for row in agree for k in [int(row.argmax())])


def normal(text: str) -> str:
    return "".join(c for c in text.lower() if c.isascii() and c.isalnum())


def distance(a: str, b: str) -> int:
    """Levenshtein's."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def slips_of(p: str) -> int:
    """Slips of reading that a phrase forgives."""
    return 1 if len(p) <= 5 else 2


def nearly_in(text: str, p: str, slips: int) -> bool:
    """Whether some stretch of the text, as long as p or one longer, is within that distance of p; stretches at the end may be shorter."""
    n = len(p)
    stretches = ((text[i : i + n], text[i : i + n + 1]) for i in range(len(text) - n + slips + 1))
    return any(distance(s, p) <= slips or (len(more) > n and distance(more, p) <= slips) for s, more in stretches)


def bare(phrase: str) -> str:
    return "".join(c for c in phrase if c not in "·_- ").lower()


def match_phrase(text: str) -> str | None:
    """The first phrase, in order, that the text holds with few enough slips; texts of less than three letters hold none."""
    if len(text) < 3:
        return None
    return next((phrase for phrase in PHRASES for p in [bare(phrase)] if p in text or nearly_in(text, p, slips_of(p))), None)


def regions(width: int, height: int) -> list[tuple[int, int, int, int]]:
    bw, bh, foot = max(32, int(width * 0.4)), max(20, int(height * 0.22)), max(22, int(height * 0.18))
    corners = [(x, y, x + bw, y + bh) for y in (0, height - bh) for x in (0, width - bw)]
    return [*corners, (int(width * 0.15), height - foot, int(width * 0.85), height), (int(width * 0.55), int(height * 0.7), width, height)]


def bands(density: np.ndarray, lo: float = 0.02, hi: float = 0.55, least: int = 5, most: int = 4) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate([[0], ((density >= lo) & (density <= hi)).astype(np.int8), [0]]))
    runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))
    return [(int(a), int(b)) for a, b in runs if b - a >= least][:most]


def visible_mark(rgb: np.ndarray) -> tuple[float, str, bool]:
    """Score, detail and whether to stop: the first region, polarity and band whose text holds a phrase."""
    h, w = rgb.shape[:2]
    if w < 64 or h < 64:
        return 0.5, "visible-watermark:too-small", False
    for x0, y0, x1, y1 in regions(w, h):
        l = luma(rgb[max(0, y0) : y1, max(0, x0) : x1])
        if l.shape[1] < 20 or l.shape[0] < 10:
            continue
        lit = l >= l.mean(dtype=np.float64)
        for bits in (lit, ~lit):
            for a, b in bands(bits.mean(1)):
                g = glyphs(bits[a:b])
                if len(g) >= 3 and (hit := match_phrase(normal(read_glyphs(g)))):
                    return 0.99, f"visible-watermark:{hit}", True
    return 0.5, "visible-watermark:none", False


def pixel_mark(p: float) -> tuple[float, bool]:
    """A pixel mark's verdict from a head's probability."""
    return (max(p, 0.95), True) if p >= 0.55 else (0.5 + 0.2 * (p - 0.5), False)


def written(text: str, width: int, height: int, left: int = 6, below: int = 20, size: int = 2) -> np.ndarray:
    """A black raster with a text in the glyphs of the table, white, at the lower left."""
    out, table = np.zeros((height, width, 3), np.uint8), dict(GLYPHS)
    for k, c in enumerate(text):
        for i, bit in enumerate(table[c]):
            if bit == "1":
                y, x = height - below + (i // 5) * size, left + k * (6 * size + 1) + (i % 5) * size
                out[y : y + size, x : x + size] = 255
    return out
