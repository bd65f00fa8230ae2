"""Page images as arrays: read and write PNG, straighten, even out contrast, shrink.  NumPy only.

Images are 8-bit gray or RGB; other formats go through a decoder that the caller brings.
"""

from __future__ import annotations

import base64
import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def read_png(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels) of a PNG file with 8 bits a sample, without interlacing."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at, packed, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            packed.append(part)
        at += size + 12
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only PNG files with 8 bits a sample and without interlacing are read")
    width, height, n = head[0], head[1], CHANNELS[head[3]]
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * n)
    out = np.zeros((height + 1, width + 1, n), np.int32)  # a border of zeros above and to the left
    for y in range(height):
        line, up = rows[y, 1:].reshape(width, n).astype(np.int32), out[y]
        match rows[y, 0]:
            case 0:
                out[y + 1, 1:] = line
            case 1:
                out[y + 1, 1:] = np.cumsum(line, 0) & 255
            case 2:
                out[y + 1, 1:] = (line + up[1:]) & 255
            case kind:
                for x in range(width):
                    left, above, corner = out[y + 1, x], up[x + 1], up[x]
                    guess = (left + above) // 2 if kind == 3 else _nearest(left, above, corner)
                    out[y + 1, x + 1] = (line[x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _nearest(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """Of the three neighbours the one nearest to left + above - corner; the first of equals."""
    guess = left + above - corner
    a, b, c = (np.abs(guess - x) for x in (left, above, corner))
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def write_png(pixels: np.ndarray) -> bytes:
    """A gray image (height, width) as a PNG file."""
    height, width = pixels.shape
    rows = np.zeros((height, width + 1), np.uint8)
    rows[:, 1:] = pixels
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def gray(pixels: np.ndarray) -> np.ndarray:
    """Luma of an image of any number of channels; alpha is left out."""
    if pixels.ndim == 2:
        return pixels
    if pixels.shape[2] < 3:
        return pixels[..., 0]
    return np.rint(pixels[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def resized(pixels: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear samples at ``scale``."""
    height, width = (max(1, round(n * scale)) for n in pixels.shape)
    return sampled(pixels, np.repeat(((np.arange(height) + 0.5) / scale - 0.5)[:, None], width, 1), np.repeat(((np.arange(width) + 0.5) / scale - 0.5)[None], height, 0))


def sampled(pixels: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between pixels; beyond the border the image is mirrored."""
    def mirrored(v: np.ndarray, n: int) -> np.ndarray:
        v = np.mod(v, 2 * n)
        return np.where(v < n, v, 2 * n - 1 - v)

    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx, p = y - y0, x - x0, pixels.astype(float)
    at = lambda dy, dx: p[mirrored(y0 + dy, p.shape[0]), mirrored(x0 + dx, p.shape[1])]
    return np.rint((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy).astype(np.uint8)


def rotated(pixels: np.ndarray, degrees: float) -> np.ndarray:
    """The image turned counter-clockwise about its middle, in its old size."""
    turn, (height, width) = np.radians(degrees), pixels.shape
    y, x = np.mgrid[:height, :width] - np.array([height // 2, width // 2])[:, None, None]
    return sampled(pixels, height // 2 + np.sin(turn) * x + np.cos(turn) * y, width // 2 + np.cos(turn) * x - np.sin(turn) * y)


def edges(pixels: np.ndarray, low: float = 100, high: float = 200) -> np.ndarray:
    """Pixels on edges: local maxima of the gradient over ``low`` that hang together with one over ``high``."""
    p = np.pad(pixels.astype(float), 1, "edge")
    gx = p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:] - p[:-2, :-2] - 2 * p[1:-1, :-2] - p[2:, :-2]
    gy = p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:] - p[:-2, :-2] - 2 * p[:-2, 1:-1] - p[:-2, 2:]
    size = np.abs(gx) + np.abs(gy)
    wide = np.pad(size, 1)
    around = lambda dy, dx: wide[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    way = np.round(np.degrees(np.arctan2(gy, gx)) / 45).astype(int) % 4
    peak = np.zeros(size.shape, bool)
    for k, (dy, dx) in enumerate(((0, 1), (1, 1), (1, 0), (1, -1))):
        peak |= (way == k) & (size > around(-dy, -dx)) & (size >= around(dy, dx))
    weak = peak & (size > low)
    found = weak & (size > high)
    while True:
        grown = np.pad(found, 1)
        near = np.zeros_like(found)
        for dy in range(3):
            for dx in range(3):
                near |= grown[dy : dy + found.shape[0], dx : dx + found.shape[1]]
        near &= weak
        if (near == found).all():
            return found
        found = near


def line_angles(marks: np.ndarray, votes: int = 100) -> np.ndarray:
    """Angles (degrees, less 90) of the straight lines that more than ``votes`` marks lie on, in steps of one degree."""
    y, x = np.nonzero(marks)
    theta = np.radians(np.arange(180))
    reach = int(np.ceil(np.hypot(*marks.shape)))
    count = np.zeros((2 * reach + 3, 182), np.int64)
    for k in range(180):
        rho = np.rint(x * np.cos(theta[k]) + y * np.sin(theta[k])).astype(int) + reach + 1
        count[:, k + 1] = np.bincount(rho, minlength=len(count))
    c = count[1:-1, 1:-1]
    top = (c > votes) & (c > count[:-2, 1:-1]) & (c >= count[2:, 1:-1]) & (c > count[1:-1, :-2]) & (c >= count[1:-1, 2:])
    return np.nonzero(top)[1] - 90.0


def tilt(pixels: np.ndarray) -> float:
    """The median angle of an image's lines; 0 without lines, or from 45 degrees on."""
    found = line_angles(edges(pixels))
    middle = float(np.median(found)) if len(found) else 0.0
    return middle if abs(middle) < 45 else 0.0


def evened(pixels: np.ndarray, tiles: int = 8, limit: float = 2.0) -> np.ndarray:
    """Contrast-limited histogram equalisation in ``tiles`` x ``tiles`` parts, blended between their middles."""
    height, width = pixels.shape
    th, tw = -(-height // tiles), -(-width // tiles)
    p = np.pad(pixels, ((0, th * tiles - height), (0, tw * tiles - width)), "symmetric" if min(height, width) >= max(th, tw) else "edge")
    maps = np.zeros((tiles, tiles, 256))
    most = max(1, int(limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            h = np.bincount(p[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(h - most, 0).sum())
            h = np.minimum(h, most) + over // 256
            rest = over % 256
            if rest:
                h[:: max(1, 256 // rest)][:rest] += 1
            maps[i, j] = np.cumsum(h) * 255 / (th * tw)
    y, x = (np.arange(height) + 0.5) / th - 0.5, (np.arange(width) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None]
    clip = lambda v: np.clip(v, 0, tiles - 1)
    at = lambda dy, dx: maps[clip(y0 + dy)[:, None], clip(x0 + dx)[None], pixels]
    return np.clip(np.rint((at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy), 0, 255).astype(np.uint8)


def prepared(pixels: np.ndarray, most: int = 2048) -> np.ndarray:
    """A page as the vision model gets it: straightened, gray, evened, at most ``most`` pixels a side."""
    g = gray(pixels)
    if angle := tilt(g):
        g = rotated(g, angle)
    g = evened(g)
    scale = min(most / g.shape[0], most / g.shape[1])
    return resized(g, scale) if scale < 1 else g


def encoded(pixels: np.ndarray) -> str:
    """A gray image as a PNG file in base64."""
    return base64.b64encode(write_png(pixels)).decode()
