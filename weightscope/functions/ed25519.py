"""Verification of Ed25519 signatures (RFC 8032)."""

from __future__ import annotations

import hashlib

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, P - 2, P) % P
ROOT_OF_MINUS_1 = pow(2, (P - 1) // 4, P)

Point = tuple[int, int, int, int]


def _recover(y: int, odd: int) -> int | None:
    if y >= P:
        return None
    square = (y * y - 1) * pow(D * y * y + 1, P - 2, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT_OF_MINUS_1 % P
    if (x * x - square) % P or (x == 0 and odd):
        return None
    return P - x if x & 1 != odd else x


def _decode(data: bytes) -> Point | None:
    n = int.from_bytes(data, "little")
    y, odd = n & ((1 << 255) - 1), n >> 255
    x = _recover(y, odd)
    return None if x is None else (x, y, 1, x * y % P)


def _encode(p: Point) -> bytes:
    inverse = pow(p[2], P - 2, P)
    return (p[1] * inverse % P | (p[0] * inverse % P & 1) << 255).to_bytes(32, "little")


def _add(p: Point, q: Point) -> Point:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, p: Point) -> Point:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


_Y = 4 * pow(5, P - 2, P) % P
BASE: Point = (_recover(_Y, 0), _Y, 1, _recover(_Y, 0) * _Y % P)


def is_key(key: bytes) -> bool:
    """Do 32 bytes encode a point?"""
    return len(key) == 32 and _decode(key) is not None


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Is ``signature`` (64 bytes) one of ``message`` by ``key`` (32 bytes)?"""
    point, s = _decode(key), int.from_bytes(signature[32:], "little")
    if point is None or s >= ORDER or len(signature) != 64:
        return False
    k = int.from_bytes(hashlib.sha512(signature[:32] + key + message).digest(), "little") % ORDER
    minus = (P - point[0], point[1], 1, (P - point[0]) * point[1] % P)
    return _encode(_add(_times(s, BASE), _times(k, minus))) == signature[:32]


def sign(seed: bytes, message: bytes) -> tuple[bytes, bytes]:
    """Public key and signature from a seed of 32 bytes; for tests, not constant in time."""
    h = hashlib.sha512(seed).digest()
    a = int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254
    key = _encode(_times(a, BASE))
    r = int.from_bytes(hashlib.sha512(h[32:] + message).digest(), "little") % ORDER
    start = _encode(_times(r, BASE))
    k = int.from_bytes(hashlib.sha512(start + key + message).digest(), "little") % ORDER
    return key, start + ((r + k * a) % ORDER).to_bytes(32, "little")
