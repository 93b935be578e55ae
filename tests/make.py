"""Tiny containers for tests, built byte by byte."""

import json
import struct

EVIL = b"\x80\x02cos\nsystem\nU\x02id\x85R."
ELF = b"\x7fELF" + b"payload " * 8


def safetensors(path, tensors, gaps=None, tail=b"", meta=None):
    """tensors: name -> (dtype, shape, bytes); gaps: name -> bytes before it."""
    header, body = {}, b""
    if meta:
        header["__metadata__"] = meta
    for name, (dtype, shape, data) in tensors.items():
        body += (gaps or {}).get(name, b"")
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    text = json.dumps(header).encode()
    while len(text) % 256 == 0x80:  # a length that starts with 0x80 would make it look like a pickle
        text += b" "
    path.write_bytes(struct.pack("<Q", len(text)) + text + body + tail)
    return str(path)


def f32(values):
    return struct.pack(f"<{len(values)}f", *values)


def layered(path, n=6, scale=None, prefix="model.layers.", extra=None):
    base = [((k % 7) - 3) * 0.01 for k in range(64)]
    t = {f"{prefix}{i}.mlp.weight": ("F32", [64], f32([v * (scale or {}).get(i, 1.0) * (1 + i * 0.01) for v in base])) for i in range(n)}
    return safetensors(path, t | (extra or {}))


def gstr(s):
    return struct.pack("<Q", len(s)) + s.encode()


def gguf(path, kv=(), tensors=(), data=b"", version=3, align=32):
    """kv: (key, tag, packed value); tensors: (name, dims, type, offset)."""
    out = b"GGUF" + struct.pack("<IQQ", version, len(tensors), len(kv))
    for key, tag, value in kv:
        out += gstr(key) + struct.pack("<I", tag) + value
    for name, dims, kind, offset in tensors:
        out += gstr(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", kind, offset)
    if tensors:
        out += b"\0" * (-len(out) % align)
    path.write_bytes(out + data)
    return str(path)
