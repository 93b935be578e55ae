"""Reading of containers: what their headers and opcodes say, as plain rows.

Everything here works on any buffer (an ``mmap`` on executors), reads headers
and opcodes only, and never loads what it reads.
"""

from __future__ import annotations

import io
import json
import lzma
import struct
import zipfile
import zlib

from weightscope import constants as K

BIG = (1 << 63) - 1  # larger numbers are out of any file's bounds all the same


def _clamp(n: int) -> int:
    return min(n, BIG)


def _is_u64(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 64


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def read_safetensors(data) -> dict:
    """header_error, or data_start, seg_len, metadata and tensors (with a problem where the spec is malformed)."""
    size = len(data)
    if size < 8:
        return {"header_error": "the file is too short for a header length"}
    (n,) = struct.unpack("<Q", bytes(data[:8]))
    if 8 + n > size:
        return {"header_error": f"the header length {n} goes beyond the file's {size} bytes"}
    try:
        header = json.loads(bytes(data[8 : 8 + n]).decode("utf-8"), parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        return {"header_error": f"the header is not JSON: {e}"}
    if not isinstance(header, dict):
        return {"header_error": "the header is not a JSON object"}
    tensors = []
    for name in sorted(header):
        spec = header[name]
        if name == "__metadata__":
            continue
        row = {"ord": len(tensors), "name": name, "dtype": "", "shape": [], "begin": None, "end": None, "problem": None}
        if not isinstance(spec, dict):
            row["problem"] = "its spec is not an object"
        else:
            numbers = lambda k: [x for x in spec.get(k) if _is_u64(x)] if isinstance(spec.get(k), list) else []  # noqa: B023, E731
            row["dtype"] = spec["dtype"] if isinstance(spec.get("dtype"), str) else ""
            row["shape"] = [_clamp(x) for x in numbers("shape")]
            offsets = numbers("data_offsets")
            if len(offsets) == 2:
                row["begin"], row["end"] = map(_clamp, offsets)
            else:
                row["problem"] = "its data_offsets are malformed"
        tensors.append(row)
    meta = header.get("__metadata__")
    texts = {k: v for k, v in meta.items() if isinstance(v, str)} if isinstance(meta, dict) else {}
    return {"data_start": 8 + n, "seg_len": size - 8 - n, "tensors": tensors, "kv": [{"key": f"metadata.{k}", "text": texts[k], "number": None} for k in sorted(texts)]}


class _Cursor:
    """Reads that fail with ValueError at the end of the data."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def skip(self, n: int) -> None:
        if n > len(self.data) - self.at:
            raise ValueError(f"the file ends at byte {len(self.data)}, {n} were expected at {self.at}")
        self.at += n

    def take(self, n: int) -> bytes:
        self.skip(n)
        return bytes(self.data[self.at - n : self.at])

    def u32(self) -> int:
        return int.from_bytes(self.take(4), "little")

    def u64(self) -> int:
        return int.from_bytes(self.take(8), "little")

    def text(self) -> str:
        return self.take(self.u64()).decode("utf-8", "replace")


#: Bytes of scalar GGUF value tags, and those that are kept as numbers.
_TAG_BYTES = {0: 1, 1: 1, 2: 2, 3: 2, 4: 4, 5: 4, 6: 4, 7: 1, 10: 8, 11: 8, 12: 8}
_TAG_STRING, _TAG_ARRAY = 8, 9
_TAGS_DROPPED = (2, 3)


def _value(c: _Cursor, tag: int) -> tuple[str | None, int | None]:
    """Text or number of a metadata value; arrays are passed over."""
    if tag in _TAG_BYTES:
        number = int.from_bytes(c.take(_TAG_BYTES[tag]), "little")
        return None, None if tag in _TAGS_DROPPED else _clamp(number)
    if tag == _TAG_STRING:
        return c.text(), None
    if tag == _TAG_ARRAY:
        inner, n = c.u32(), c.u64()
        if inner in _TAG_BYTES:
            c.skip(_TAG_BYTES[inner] * n)
        elif inner == _TAG_STRING:
            for _ in range(n):
                c.skip(c.u64())
        else:
            for _ in range(n):
                _value(c, inner)
        return None, None
    raise ValueError(f"unknown value type {tag}")


def read_gguf(data) -> dict:
    """header_error or bad_version, or kv, tensors, info_end, alignment, data_start and seg_len."""
    c, kv, tensors = _Cursor(data), [], []
    try:
        if c.take(4) != b"GGUF":
            return {"header_error": "the GGUF magic is missing"}
        version = c.u32()
        if version not in (2, 3):
            return {"bad_version": version}
        n_tensors, n_kv = c.u64(), c.u64()
        if max(n_tensors, n_kv) > len(data):
            return {"header_error": f"{n_tensors} tensors and {n_kv} values can't be in {len(data)} bytes"}
        alignment = 32
        for _ in range(n_kv):
            key = c.text()
            text, number = _value(c, c.u32())
            kv.append({"key": key, "text": text, "number": number})
            if key == "general.alignment" and number:
                alignment = number
        for i in range(n_tensors):
            name, n_dims = c.text(), c.u32()
            if n_dims > 8:
                raise ValueError(f"tensor {name!r} has {n_dims} dimensions")
            dims = [_clamp(c.u64()) for _ in range(n_dims)]
            type_id, offset = c.u32(), _clamp(c.u64())
            tensors.append({"ord": i, "name": name, "dtype": "", "type_id": min(type_id, (1 << 31) - 1), "shape": dims, "begin": offset, "end": None, "problem": None})
    except ValueError as e:
        return {"header_error": str(e), "kv": kv}
    except RecursionError:
        return {"header_error": "arrays in arrays go too deep", "kv": kv}
    out = {"kv": kv, "tensors": tensors, "info_end": c.at, "alignment": alignment}
    if tensors:
        start = -(-c.at // alignment) * alignment
        if start > len(data):
            return {"header_error": "the tensor data would start beyond the end of the file", "kv": kv}
        out |= {"data_start": start, "seg_len": len(data) - start}
    return out


# Pickle opcodes by what follows them.
_STOP = 0x2E
_PLAIN = frozenset(b"(012NQad}el]s)tu") | {0x85, 0x86, 0x87, 0x88, 0x89, 0x8F, 0x90, 0x94, 0x97, 0x98}
_RUNS = {0x52: "REDUCE", 0x62: "BUILD", 0x6F: "OBJ", 0x81: "NEWOBJ", 0x92: "NEWOBJ_EX"}
_LINE, _TEXT_LINE = frozenset(b"FILPg"), frozenset(b"SV")
_SKIP = {**dict.fromkeys(b"Khq", 1), 0x80: 1, 0x82: 1, 0x4D: 2, 0x83: 2, **dict.fromkeys(b"Jjr", 4), 0x84: 4, 0x47: 8, 0x95: 8}
_COUNTED = {**dict.fromkeys(b"UC", (1, True)), 0x8C: (1, True), **dict.fromkeys(b"TXB", (4, True)), 0x8D: (8, True), 0x8E: (8, False), 0x96: (8, False), 0x8B: (4, False)}
_GLOBAL, _INST, _STACK_GLOBAL, _LONG1 = 0x63, 0x69, 0x93, 0x8A
#: Fixed value: the number that a legacy torch file starts with.
TORCH_LEGACY = 0x1950A86A20F9469CFC6C


#: For each opcode how long it is with the fixed bytes that follow it; 0 where that isn't all there is to it.
_LENGTH = bytes(1 if op in _PLAIN else 1 + _SKIP.get(op, -1) for op in range(256))


def _unquote(text: str) -> str:
    return text[1:-1] if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"" else text


def scan_stream(data, begin: int = 0) -> dict:
    """One pickle stream: end, truncated, exec_ops, refs (opcode, module, name) and first_long1. Nothing is executed.

    Module and name of STACK_GLOBAL are the last two strings that were pushed.
    Of strings only the places are kept; those that are named are decoded.
    """
    at, size, strings, ops, refs, first, ended = begin, len(data), [], [], [], None, False

    def pop() -> str:
        if not strings:
            return "?"
        start, stop, quoted = strings.pop()
        text = str(data[start:stop], "utf-8", "replace")
        return _unquote(text) if quoted else text

    while at < size:
        op = data[at]
        length = _LENGTH[op]
        if length:
            if at + length > size:
                break
            at += length
        elif op in _COUNTED or op == _LONG1:
            width, push = _COUNTED.get(op, (1, False))
            body = at + 1 + width
            stop = body + int.from_bytes(data[at + 1 : body], "little")
            if stop > size:
                break
            if push:
                strings.append((body, stop, False))
            elif op == _LONG1 and first is None and stop - body <= 16:
                first = int.from_bytes(data[body:stop], "little")
            at = stop
        elif op == _STOP:
            at += 1
            ended = True
            break
        elif op in (_GLOBAL, _INST):
            middle = data.find(b"\n", at + 1)
            stop = data.find(b"\n", middle + 1) if middle >= 0 else -1
            if stop < 0:
                break
            refs.append({"opcode": "GLOBAL" if op == _GLOBAL else "INST", "module": str(data[at + 1 : middle], "utf-8", "replace"), "name": str(data[middle + 1 : stop], "utf-8", "replace")})
            if op == _INST:
                ops.append("INST")
            at = stop + 1
        elif op == _STACK_GLOBAL:
            name = pop()
            refs.append({"opcode": "STACK_GLOBAL", "module": pop(), "name": name})
            at += 1
        elif op in _RUNS:
            ops.append(_RUNS[op])
            at += 1
        elif op in _LINE or op in _TEXT_LINE:
            stop = data.find(b"\n", at + 1)
            if stop < 0:
                break
            if op in _TEXT_LINE:
                strings.append((at + 1, stop, True))
            at = stop + 1
        else:
            break
    return {"end": at, "truncated": not ended, "exec_ops": ops, "refs": refs, "first_long1": first}


class _View(io.RawIOBase):
    """A file over any buffer; nothing is copied but what is read."""

    def __init__(self, data):
        super().__init__()
        self.data, self.at = data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, to: int, whence: int = 0) -> int:
        self.at = max(0, to + (0, self.at, len(self.data))[whence])
        return self.at

    def readinto(self, out) -> int:
        part = self.data[self.at : self.at + len(out)]
        out[: len(part)] = part
        self.at += len(part)
        return len(part)


class _Held(io.BytesIO):
    """The same over bytes that are held, which aren't copied either."""

    def seek(self, to: int, whence: int = 0) -> int:
        return super().seek(to if whence else max(0, to), whence)


#: What reading a damaged or hostile zip may raise.
_ZIP_ERRORS = (zipfile.BadZipFile, zlib.error, lzma.LZMAError, struct.error, NotImplementedError, RuntimeError, OSError, EOFError, ValueError, KeyError, IndexError, OverflowError)
#: Fixed layout: local and central header of a zip member, and the record at the end.
_LOCAL, _CENTRAL, _END = struct.Struct("<4s5H3L2H"), struct.Struct("<4s6H3L5H2L"), struct.Struct("<4s4H2LH")
#: No comment of a zip is longer, and no larger member is read without ``zipfile``.
_COMMENT, _SMALL = 1 << 16, 1 << 20


#: What ``zipfile`` says of a file without the record at the end.
NO_ZIP = "File is not a zip file"


def no_zip(data) -> bool:
    """Whether a file has no record at its end that would make it a zip."""
    return data.rfind(b"PK\5\6", max(0, len(data) - _COMMENT - _END.size)) < 0


def _is_pickle(name: str) -> bool:
    return name.lower().endswith((".pkl", ".pickle"))


def _simple_zip(data, most: int) -> list[tuple[str, bytes]] | None:
    """Names and contents of the pickles in a zip that is sound and has nothing uncommon; None of any other, which is left to ``zipfile``."""
    end = len(data) - _END.size
    if end < _CENTRAL.size or data[end - 20 : end - 16] == b"PK\6\7":
        return None
    magic, _, _, _, _, length, at, comment = _END.unpack_from(data, end)
    if magic != b"PK\5\6" or comment or at + length != end:
        return None
    members, limit = [], at
    while at < end:
        if at + _CENTRAL.size > end:
            return None
        magic, _, needed, flags, method, _, _, crc, packed, full, n, extra, note, _, _, _, begin = _CENTRAL.unpack_from(data, at)
        at += _CENTRAL.size + n
        name = data[at - n : at]
        if magic != b"PK\1\2" or needed & 255 > 45 or flags or method not in (0, 8) or extra or note or at > end or not name.isascii() or b"\0" in name or (members and begin < members[-1][0]):
            return None
        members.append((begin, name, method, crc, packed, full))
    out = []
    for i, (begin, name, method, crc, packed, full) in enumerate(members):
        if not _is_pickle(name.decode()):
            continue
        after = members[i + 1][0] if i + 1 < len(members) else limit
        if begin + _LOCAL.size > after or after > limit or full > min(most, _SMALL):
            return None
        magic, _, flags, _, _, _, _, _, _, n, extra = _LOCAL.unpack_from(data, begin)
        start = begin + _LOCAL.size + n + extra
        if magic != b"PK\3\4" or flags or data[begin + _LOCAL.size : begin + _LOCAL.size + n] != name or start + packed > after:
            return None
        body = data[start : start + packed]
        if method:
            inflate = zlib.decompressobj(-15)
            try:
                body = inflate.decompress(body, full + 1)
            except zlib.error:
                return None
            if not inflate.eof or inflate.unused_data:
                return None
        if len(body) != full or zlib.crc32(body) != crc:
            return None
        out.append((name.decode(), body))
    return out


def _zip_pickles(data, most: int) -> list[tuple[str, bytes]]:
    """Names and contents of the pickles in a zip; ValueError where one inflates beyond ``most`` bytes."""
    if no_zip(data):
        raise zipfile.BadZipFile(NO_ZIP)
    simple = _simple_zip(data, most)
    if simple is not None:
        return simple
    out = []
    with zipfile.ZipFile(_Held(data) if isinstance(data, bytes) else _View(data)) as z:
        for info in z.infolist():
            if _is_pickle(info.filename):
                body = bytearray()
                with z.open(info) as f:
                    while part := f.read(1 << 20):
                        body += part
                        if len(body) > most:
                            raise ValueError(f"{info.filename} inflates to more than {most} bytes")
                out.append((info.filename, bytes(body)))
    return out


def read_pickle(data, most: int = K.MAX_ENTRY) -> dict:
    """Streams and references of a pickle or of the pickles in a zip, and how the rest of the file looks.

    container: unreadable (damaged, or a pickle inflates beyond ``most``
    bytes), no_pickle, zip, truncated (at), legacy (torch, with a tail), tail
    (at, what it begins), or plain. One damaged pickle makes a zip unreadable.
    """
    streams, refs = [], []

    def add(entry: str, no: int, scan: dict) -> None:
        streams.append({"entry": entry, "stream_no": no, "exec_ops": scan["exec_ops"], "truncated": scan["truncated"], "end": scan["end"]})
        for r in scan["refs"]:
            refs.append({"entry": entry, "ord": len(refs), **r})

    if data[:4] == b"PK\x03\x04":
        try:
            bodies = _zip_pickles(data, most)
        except _ZIP_ERRORS as e:
            return {"streams": [], "refs": [], "container": "unreadable", "detail": str(e)}
        for i, (name, body) in enumerate(bodies):
            add(name, i + 1, scan_stream(body))
        return {"streams": streams, "refs": refs, "container": "zip" if bodies else "no_pickle"}
    found, at = [], 0
    while at < len(data) and len(found) < K.MAX_STREAMS:
        found.append(scan_stream(data, at))
        at = found[-1]["end"]
        if found[-1]["truncated"] or at >= len(data) or data[at] != 0x80:
            break
    for i, scan in enumerate(found):
        add(f"stream {i + 1}/{len(found)}" if len(found) > 1 else "", i + 1, scan)
    kind = "plain"
    if found and found[-1]["truncated"]:
        kind = "truncated"
    elif at < len(data):
        kind = "legacy" if found and found[0]["first_long1"] == TORCH_LEGACY else "tail"
    return {"streams": streams, "refs": refs, "container": kind, "tail_at": at, "tail_len": len(data) - at}


def detect(path: str, head: bytes) -> str:
    """The format of a file by its first bytes, then its name, then its shape."""
    if head[:4] == b"GGUF":
        return "gguf"
    if head[:4] == b"PK\x03\x04" or head[:1] == b"\x80":
        return "pickle"
    ext = path.rsplit("/", 1)[-1].rpartition(".")[2].lower() if "." in path.rsplit("/", 1)[-1][1:] else ""
    if ext in ("safetensors", "gguf"):
        return ext
    if ext in K.EXTENSIONS:
        return "pickle"
    if len(head) >= 9 and 0 < int.from_bytes(head[:8], "little") < 1 << 32 and head[8:9] == b"{":
        return "safetensors"
    return "unknown"


def identify(head: bytes) -> str | None:
    """What leading bytes begin."""
    text = head[:8].hex()
    return next((what for magic, what in K.MAGICS if text.startswith(magic)), None)


def preview(data: bytes) -> str:
    """The first bytes, printable ones as they are."""
    shown = "".join(chr(b) if 0x20 <= b < 0x7F else f"\\x{b:02x}" for b in data[:32])
    return shown + ("…" if len(data) > 32 else "")
