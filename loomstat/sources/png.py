"""PNG pictures: written and read with the standard library's inflate, brought to one size and colour space with numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
#: Values of a pixel by colour type.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _around(a: int, b: int, c: int) -> int:
    """Of left, up and corner the one that is nearest to left + up - corner; ties in this order."""
    p = a + b - c
    pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
    return a if pa <= pb and pa <= pc else b if pb <= pc else c


def _unfiltered(raw: bytes, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of bytes; each is stored behind the number of the way in which it differs from its neighbours ``step`` bytes to the left and up."""
    if len(raw) != height * (stride + 1):
        raise ValueError("wrong size of data")
    rows = np.frombuffer(raw, np.uint8).reshape(height, stride + 1)
    out, above = np.zeros((height, stride), np.uint8), np.zeros(stride, np.uint8)
    for y, row in enumerate(rows):
        way, line = row[0], row[1:]
        if way == 0:
            done = line
        elif way == 1:
            done = np.zeros(-(-stride // step) * step, np.uint8)
            done[:stride] = line
            done = done.reshape(-1, step).cumsum(axis=0, dtype=np.uint8).ravel()[:stride]
        elif way == 2:
            done = line + above
        elif way in (3, 4):
            now, up = line.tolist(), above.tolist()
            for i in range(stride):
                left, corner = (now[i - step], up[i - step]) if i >= step else (0, 0)
                now[i] = (now[i] + ((left + up[i]) // 2 if way == 3 else _around(left, up[i], corner))) & 255
            done = np.array(now, np.uint8)
        else:
            raise ValueError("unknown filter")
        out[y] = above = done
    return out


def decode(content: bytes) -> np.ndarray:
    """Height by width by red, green, blue and alpha, from 0 to 1. Interlaced pictures, and broken ones, are errors."""
    if content[:8] != MAGIC:
        raise ValueError("not a PNG picture")
    at, data, palette, clear, head = 8, [], None, None, None
    while at + 12 <= len(content):
        n, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + n]
        if len(body) < n or zlib.crc32(kind + body) != struct.unpack(">I", content[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("broken chunk")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
    if head is None or head[6] or head[3] not in CHANNELS:
        raise ValueError("no header, or one of a kind that isn't read")
    width, height, depth, colour = head[:4]
    channels = CHANNELS[colour]
    stride, step = -(-width * channels * depth // 8), max(channels * depth // 8, 1)
    rows = _unfiltered(zlib.decompress(b"".join(data)), height, stride, step)
    if depth == 16:
        values = rows.reshape(height, -1, 2).astype(np.int64) @ [256, 1]
    elif depth == 8:
        values = rows.astype(np.int64)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * channels * depth].reshape(height, -1, depth)
        values = bits.astype(np.int64) @ (1 << np.arange(depth)[::-1])
    values = values[:, : width * channels].reshape(height, width, channels)
    most = (1 << depth) - 1
    alpha = np.ones((height, width))
    if colour == 3:
        table = np.ones(max(len(palette), 1))
        if clear is not None:
            table[: len(clear)] = np.frombuffer(clear, np.uint8) / 255
        rgb, alpha = palette[values[..., 0]] / 255, table[values[..., 0]]
    else:
        if clear is not None:
            alpha = (values != struct.unpack(f">{channels}H", clear[: 2 * channels])).any(axis=2).astype(float)
        rgb = (values[..., :3] if channels >= 3 else values[..., [0, 0, 0]]) / most
        if colour in (4, 6):
            alpha = values[..., -1] / most
    return np.concatenate([rgb, alpha[..., None]], axis=2)


def encode(pixels: np.ndarray) -> bytes:
    """Height by width by 1 to 4 values of 8 bits as a picture; the five ways to store a row take turns."""
    h, w, channels = pixels.shape
    flat = pixels.astype(np.uint8).reshape(h, -1).astype(np.int64)
    left, above = np.zeros_like(flat), np.zeros_like(flat)
    left[:, channels:], above[1:] = flat[:, : flat.shape[1] - channels], flat[:-1]
    corner = np.zeros_like(flat)
    corner[1:, channels:] = flat[:-1, : flat.shape[1] - channels]
    p = left + above - corner
    pa, pb, pc = abs(p - left), abs(p - above), abs(p - corner)
    guess = [0 * flat, left, above, (left + above) // 2, np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))]
    way = np.arange(h) % 5
    stored = np.stack([flat - g for g in guess])[way, np.arange(h)] % 256
    raw = np.concatenate([way[:, None], stored], axis=1).astype(np.uint8).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[channels], 0, 0, 0)
    return MAGIC + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def on_white(rgba: np.ndarray) -> np.ndarray:
    return rgba[..., :3] * rgba[..., 3:] + 1 - rgba[..., 3:]


def squared(rgb: np.ndarray) -> np.ndarray:
    """In the middle of a white square."""
    h, w, _ = rgb.shape
    side = max(h, w)
    out = np.ones((side, side, 3))
    y, x = (side - h) // 2, (side - w) // 2
    out[y : y + h, x : x + w] = rgb
    return out


def weights(n: int, size: int, lobes: int = 3) -> np.ndarray:
    """``size`` by ``n``: how much of each of ``n`` pixels is in each of ``size``: a windowed sinc of ``lobes`` lobes, stretched where there are fewer, over
    the pixels that there are."""
    scale = n / size
    stretch = max(scale, 1.0)
    off = ((np.arange(n) + 0.5) - (np.arange(size)[:, None] + 0.5) * scale) / stretch
    w = np.where(np.abs(off) < lobes, np.sinc(off) * np.sinc(off / lobes), 0)
    return w / w.sum(axis=1, keepdims=True)


def resized(rgb: np.ndarray, size: int) -> np.ndarray:
    """A picture as ``size`` by ``size``, from 0 to 1."""
    made = np.einsum("iy,yxc->ixc", weights(rgb.shape[0], size), rgb)
    return np.clip(np.einsum("jx,ixc->ijc", weights(rgb.shape[1], size), made), 0, 1)
