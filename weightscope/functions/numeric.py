"""Decoding of tensor bytes to doubles, in numpy."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

_PLAIN = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1"}
BLOCK = 32
BLOCK_BYTES = {"Q4_0": 18, "Q4_1": 20, "Q5_0": 22, "Q5_1": 24, "Q8_0": 34}
WIDTH = {"F64": 8, "I64": 8, "F32": 4, "I32": 4, "F16": 2, "BF16": 2, "I16": 2, "I8": 1, "U8": 1, "BOOL": 1}


def unit(kind: str) -> tuple[int, int]:
    """Elements and bytes of the smallest piece of ``kind`` that can be decoded alone."""
    return (BLOCK, BLOCK_BYTES[kind]) if kind in BLOCK_BYTES else (1, WIDTH[kind])


def decode(data, kind: str, elements: int | None = None) -> np.ndarray:
    """The values of whole elements or blocks as doubles, at most ``elements``; a partial last one is left out."""
    n, size = unit(kind)
    data = memoryview(data)[: len(data) // size * size]
    if kind in _PLAIN:
        out = np.frombuffer(data, _PLAIN[kind]).astype(np.float64)
    elif kind == "BOOL":
        out = (np.frombuffer(data, np.uint8) != 0).astype(np.float64)
    elif kind == "BF16":
        out = (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32).astype(np.float64)
    else:
        out = _blocks(np.frombuffer(data, np.uint8).reshape(-1, size), kind).astype(np.float64).ravel()
    return out if elements is None else out[:elements]


def _half(raw: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(raw).view("<f2").astype(np.float32)


def _blocks(raw: np.ndarray, kind: str) -> np.ndarray:
    """Legacy block formats: a scale, for some an offset and fifth bits, then packed values; in single precision."""
    scale = _half(raw[:, 0:2])
    if kind == "Q8_0":
        return scale * raw[:, 2:].view(np.int8).astype(np.float32)
    at = 2
    offset = None
    if kind in ("Q4_1", "Q5_1"):
        offset, at = _half(raw[:, 2:4]), 4
    high = None
    if kind in ("Q5_0", "Q5_1"):
        bits = np.ascontiguousarray(raw[:, at : at + 4]).view("<u4")
        high, at = ((bits >> np.arange(32, dtype=np.uint32)) & 1).astype(np.uint8) << 4, at + 4
    packed = raw[:, at:]
    value = np.concatenate([packed & 15, packed >> 4], 1)
    if high is not None:
        value = value | high
    value = value.astype(np.float32)
    if offset is not None:
        return value * scale + offset
    return (value - np.float32(16 if high is not None else 8)) * scale


def moments(values: np.ndarray) -> dict:
    """Mergeable statistics of values; NaN and infinities are counted and left out of the rest."""
    nan, inf = np.isnan(values), np.isinf(values)
    x = values[~(nan | inf)]
    out = {"n": len(x), "nan_count": int(nan.sum()), "inf_count": int(inf.sum()), "zeros": int((x == 0).sum()), "min": None, "max": None, "max_abs": None, "mean": None, "m2": 0.0, "m3": 0.0, "m4": 0.0}
    if len(x):
        mean = float(x.mean())
        d = x - mean
        d2 = d * d
        out |= {"min": float(x.min()), "max": float(x.max()), "max_abs": float(np.abs(x).max()), "mean": mean, "m2": float(d2.sum()), "m3": float((d2 * d).sum()), "m4": float((d2 * d2).sum())}
    return out


#: Values up to which tensors of one kind and size are taken together, and how many values at a time.
SMALL, TOGETHER = 4096, 1 << 18


def moments_of(chunks: Iterable[tuple[bytes, str, int | None]]) -> list[dict]:
    """``moments`` of many chunks (bytes, kind, elements as for ``decode``); small ones of equal size are decoded and summed at once."""
    out, alike = [], {}
    for i, (raw, kind, elements) in enumerate(chunks):
        per, width = unit(kind)
        whole = len(raw) // width * width
        out.append(None)
        if not whole or elements == 0 or whole // width * per > SMALL:
            out[i] = moments(decode(raw, kind, elements))
            continue
        alike.setdefault((kind, whole, elements), []).append((i, raw[:whole]))
    for (kind, whole, elements), found in alike.items():
        per, width = unit(kind)
        step = max(1, TOGETHER // (whole // width * per))
        for at in range(0, len(found), step):
            some = found[at : at + step]
            values = decode(b"".join(raw for _, raw in some), kind).reshape(len(some), -1)[:, :elements]
            for (i, _), made in zip(some, _moments_of_rows(values), strict=True):
                out[i] = made
    return out


def _moments_of_rows(values: np.ndarray) -> list[dict]:
    """``moments`` of every row; rows with values that aren't finite one by one."""
    good = np.isfinite(values).all(1)
    x = np.where(good[:, None], values, 0.0)
    mean = x.mean(1)
    d = x - mean[:, None]
    d2 = d * d
    cols = {"zeros": (x == 0).sum(1), "min": x.min(1), "max": x.max(1), "max_abs": np.abs(x).max(1), "mean": mean, "m2": d2.sum(1), "m3": (d2 * d).sum(1), "m4": (d2 * d2).sum(1)}
    same = {"n": x.shape[1], "nan_count": 0, "inf_count": 0}
    rows = zip(*[c.tolist() for c in cols.values()], strict=True)
    return [same | dict(zip(cols, row, strict=True)) if ok else moments(values[i]) for i, (ok, row) in enumerate(zip(good, rows, strict=True))]


def pair_sums(s: np.ndarray, b: np.ndarray, eps: float) -> dict:
    """Mergeable sums of values of two tensors, place by place, up to the shorter one's end."""
    n = min(len(s), len(b))
    s, b = s[:n], b[:n]
    d = s - b
    out = {"n": n, "dot": float((s * b).sum()), "diff2": float((d * d).sum()), "changed": int((np.abs(d) > eps).sum())}
    for tag, x in (("s", s), ("b", b)):
        out |= {f"{tag}{k}": float((x**k).sum()) for k in (1, 2, 3, 4)}
        out[f"max_{tag}"] = float(np.nanmax(np.abs(x))) if n and not np.isnan(x).all() else 0.0
    return out

