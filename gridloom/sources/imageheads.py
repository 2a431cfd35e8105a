"""Size, mode and integrity of PNG, JPEG, BMP and TIFF files from their headers; pixels aren't decoded.

A header needs the first bytes, and in TIFF a directory anywhere in the file, so files are read by seeking. Modes have the names
of a common imaging library: 1, L, LA, P, RGB, RGBA, RGBX, CMYK, YCbCr, I;16, I, F. Of a PNG file all chunks are checked against their sums.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Callable
from typing import BinaryIO, NamedTuple

#: Bytes that are read or hashed at once, and of a file that is held whole so that it is read once.
BLOCK, HELD = 1 << 20, 64 << 20


class Head(NamedTuple):
    width: int
    height: int
    mode: str


class BadImage(ValueError):
    """No image of a known kind, or a damaged one."""


def _exactly(file: BinaryIO, n: int) -> bytes:
    data = file.read(n)
    if len(data) != n:
        raise BadImage("file ends too early")
    return data


# Signatures, and what numbers in headers mean.
PNG = b"\x89PNG\r\n\x1a\n"
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
JPEG_FRAMES = {0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF}
JPEG_BARE = {0x01, *range(0xD0, 0xD9)}
TIFF_TYPES = {1: "B", 3: "H", 4: "I"}
WIDTH, HEIGHT, BITS, PHOTOMETRIC, SAMPLES, EXTRA, FORMAT = 256, 257, 258, 262, 277, 338, 339


def _png(file: BinaryIO, verify: bool) -> Head:
    kind, body = _png_chunk(file, True)
    if kind != b"IHDR" or len(body) < 13:
        raise BadImage("PNG without header")
    width, height, depth, colour = struct.unpack(">IIBB", body[:10])
    if colour not in PNG_MODES:
        raise BadImage(f"PNG with colour type {colour}")
    while verify and kind != b"IEND":
        kind, _ = _png_chunk(file, False)
    mode = PNG_MODES[colour]
    return Head(width, height, {1: "1", 16: "I;16"}.get(depth, mode) if mode == "L" else mode)


def _png_chunk(file: BinaryIO, keep: bool) -> tuple[bytes, bytes]:
    """Kind and, if asked for, content of the next chunk, whose sum must be right; content is read block by block."""
    size, kind = struct.unpack(">I4s", _exactly(file, 8))
    total, parts = zlib.crc32(kind), []
    while size:
        part = _exactly(file, min(size, BLOCK))
        total, size = zlib.crc32(part, total), size - len(part)
        parts += [part] if keep else []
    if struct.unpack(">I", _exactly(file, 4))[0] != total:
        raise BadImage(f"damaged PNG chunk {kind!r}")
    return kind, b"".join(parts)


def _jpeg(file: BinaryIO, verify: bool) -> Head:
    while True:
        if _exactly(file, 1) != b"\xff":
            raise BadImage("JPEG without frame")
        code = 0xFF
        while code == 0xFF:  # any number of fill bytes
            code = _exactly(file, 1)[0]
        if code in JPEG_BARE:
            continue
        if code in (0xD9, 0xDA):
            raise BadImage("JPEG without frame")
        size = struct.unpack(">H", _exactly(file, 2))[0] - 2
        if code in JPEG_FRAMES:
            _, height, width, parts = struct.unpack(">BHHB", _exactly(file, 6))
            if parts not in JPEG_MODES:
                raise BadImage(f"JPEG with {parts} components")
            return Head(width, height, JPEG_MODES[parts])
        if size < 0:
            raise BadImage("JPEG segment without length")
        file.seek(size, io.SEEK_CUR)


def _bmp(file: BinaryIO, verify: bool) -> Head:
    _exactly(file, 12)
    size = struct.unpack("<I", _exactly(file, 4))[0]
    body = _exactly(file, size - 4) if 12 <= size <= 1024 else b""
    if size == 12:
        width, height, _, bits = struct.unpack("<HHHH", body)
        colours, packing = 0, 0
    elif len(body) >= 36:
        width, height, _, bits, packing = struct.unpack("<iiHHI", body[:16])
        colours = struct.unpack("<I", body[28:32])[0]
    else:
        raise BadImage("BMP with an unknown header")
    if bits in (16, 24, 32):
        masks = struct.unpack("<IIII", body[36:52]) if len(body) >= 52 else (0, 0, 0, 0)
        return Head(width, abs(height), "RGBA" if bits == 32 and packing == 3 and masks[3] else "RGB")
    if bits not in (1, 4, 8):
        raise BadImage(f"BMP with {bits} bits")
    n, step = colours or 1 << bits, 3 if size == 12 else 4
    table = _exactly(file, n * step) if n <= 256 else b""
    ramp = (0, 255) if n == 2 else range(n)
    if all(table[k * step : k * step + 3] == bytes([v] * 3) for k, v in enumerate(ramp)):
        return Head(width, abs(height), "1" if n == 2 else "L")
    return Head(width, abs(height), "P")


def _tiff(file: BinaryIO, verify: bool) -> Head:
    file.seek(0)
    order = {b"II": "<", b"MM": ">"}[_exactly(file, 2)]
    if struct.unpack(f"{order}H", _exactly(file, 2))[0] != 42:
        raise BadImage("TIFF of another version")
    file.seek(struct.unpack(f"{order}I", _exactly(file, 4))[0])
    entries = [struct.unpack(f"{order}HHI4s", _exactly(file, 12)) for _ in range(struct.unpack(f"{order}H", _exactly(file, 2))[0])]
    tags = {}
    for tag, kind, n, value in entries:
        if tag in (WIDTH, HEIGHT, BITS, PHOTOMETRIC, SAMPLES, EXTRA, FORMAT) and kind in TIFF_TYPES and 0 < n <= 64:
            form = f"{order}{n}{TIFF_TYPES[kind]}"
            if struct.calcsize(form) > 4:
                file.seek(struct.unpack(f"{order}I", value)[0])
                value = _exactly(file, struct.calcsize(form))
            tags[tag] = struct.unpack_from(form, value)
    if WIDTH not in tags or HEIGHT not in tags:
        raise BadImage("TIFF without size")
    bits, photo, samples = tags.get(BITS, (1,)), tags.get(PHOTOMETRIC, (0,))[0], tags.get(SAMPLES, (1,))[0]
    real = tags.get(FORMAT, (1,))[0] == 3
    if photo in (0, 1):
        mode = "LA" if samples == 2 else {1: "1", 16: "I;16", 32: "F" if real else "I"}.get(bits[0], "L")
    elif photo == 2:
        mode = "RGB" if samples == 3 else "RGBA" if tags.get(EXTRA, (0,))[0] in (1, 2) else "RGBX"
    else:
        mode = {3: "P", 5: "CMYK", 6: "YCbCr"}.get(photo)
    if mode is None:
        raise BadImage(f"TIFF with colours of kind {photo}")
    return Head(tags[WIDTH][0], tags[HEIGHT][0], mode)


READERS: list[tuple[bytes, int, Callable[[BinaryIO, bool], Head]]] = [(PNG, 8, _png), (b"\xff\xd8", 2, _jpeg), (b"BM", 2, _bmp), (b"II*\0", 4, _tiff), (b"MM\0*", 4, _tiff)]


def head(file: BinaryIO, verify: bool = False) -> Head:
    """Width, height and mode of an image file, by its first bytes, whatever its name; raises BadImage."""
    start = file.read(8)
    for signature, skip, reader in READERS:
        if start.startswith(signature):
            file.seek(skip)
            found = reader(file, verify)
            if found.width <= 0 or found.height <= 0:
                raise BadImage("image without area")
            return found
    raise BadImage("not a PNG, JPEG, BMP or TIFF file")


def inspected(file: BinaryIO, size: int, digest: bool) -> tuple[int, int, str | None, str | None, str | None]:
    """``width, height, mode, sha256, error`` of an open file; sizes are -1 where it isn't an image.

    With ``digest`` all bytes are hashed and checked, from memory up to a bound, so that a file is read once; a larger file is read twice.
    """
    if digest and size <= HELD:
        file = io.BytesIO(file.read())
    try:
        width, height, mode, error = *head(file, digest), None
    except (BadImage, struct.error, OverflowError) as bad:
        width, height, mode, error = -1, -1, None, str(bad)
    total = None
    if digest:
        file.seek(0)
        own = hashlib.sha256()
        while block := file.read(BLOCK):
            own.update(block)
        total = own.hexdigest()
    return width, height, mode, total, error
