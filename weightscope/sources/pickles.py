"""Short pickles read many at a time: each step takes one opcode of all of them.

Says what ``containers.read_pickle`` says, as Arrow columns. What is rare (long
streams, many strings, wide text, torch's number, zips of several pickles or
with anything uncommon) is left to that, file by file.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weightscope import constants as K
from weightscope.sources import containers as R

#: Bytes of a file, opcodes and strings of a stream up to which a file is read here.
SHORT, STEPS, STRINGS = 1 << 16, 64, 16
#: What an opcode is, beyond those whose length says all.
_LENGTH = np.frombuffer(R._LENGTH, np.uint8).astype(np.int64)
_BAD, _END, _TEXT, _LINES, _STACK, _RUN, _LINE, _LEFT = range(8)
_KIND = np.full(256, _BAD, np.uint8)
_KIND[R._STOP], _KIND[R._STACK_GLOBAL], _KIND[R._LONG1] = _END, _STACK, _LEFT
_KIND[[R._GLOBAL, R._INST]], _KIND[list(R._RUNS)], _KIND[list(R._LINE | R._TEXT_LINE)] = _LINES, _RUN, _LINE
_KIND[list(R._COUNTED)] = _TEXT
_WIDTH = np.array([R._COUNTED.get(op, (0, False))[0] for op in range(256)])
_PUSH = np.array([R._COUNTED.get(op, (0, False))[1] for op in range(256)])
_QUOTED = np.isin(np.arange(256), list(R._TEXT_LINE))
_OP_NAMES = [R._RUNS.get(op, "INST" if op == R._INST else "") for op in range(256)]
_CONTAINERS = ["truncated", "tail", "plain", "zip", "no_pickle", "unreadable"]
_CUT, _TAIL, _WHOLE, _ZIP, _EMPTY, _UNREADABLE = range(6)
_REF_NAMES = [{R._GLOBAL: "GLOBAL", R._INST: "INST", R._STACK_GLOBAL: "STACK_GLOBAL"}.get(op, "") for op in range(256)]


def fits(content: bytes) -> bool:
    """Whether a file may be read here: it is a pickle or a zip by its first bytes, and short."""
    return (content[:1] == b"\x80" or content[:4] == b"PK\3\4") and len(content) <= SHORT


def _opened(content: bytes) -> tuple[int, bytes, str]:
    """The container, or -1 where its opcodes tell, the bytes to look at, and their entry; the container is None of a file that is left."""
    if content[:1] == b"\x80":
        return -1, content, ""
    if R.no_zip(content):
        return _UNREADABLE, b"", ""
    found = R._simple_zip(content, K.MAX_ENTRY)
    if found is None or len(found) > 1 or (found and len(found[0][1]) > SHORT):
        return None, b"", ""
    return (_ZIP, found[0][1], found[0][0]) if found else (_EMPTY, b"", "")


class _Events:
    """Rows of numbers, added some at a time."""

    def __init__(self, width: int):
        self.parts: list[tuple] = [(np.zeros(0, np.int64),) * width]

    def add(self, *columns) -> None:
        if len(columns[0]):
            self.parts.append(columns)

    def of(self, keep: np.ndarray) -> list[np.ndarray]:
        """The columns of files to ``keep``, in order of files, then as added; the first column is the file."""
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        order = np.argsort(columns[0], kind="stable")
        order = order[keep[columns[0][order]]]
        return [c[order] for c in columns]


def _offsets(of: np.ndarray, n: int) -> np.ndarray:
    """Where the items of each of ``n`` lists begin, and the end; ``of`` says whose each item is."""
    return np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32)


def _texts(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """Slices of ``data``, which are ASCII, as strings."""
    size = stop - start
    at = np.concatenate(([0], np.cumsum(size)))
    taken = data[np.repeat(start - at[:-1], size) + np.arange(at[-1])]
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(taken))


def _named(names: list[str], codes: np.ndarray) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(codes))


def _list(kind: pa.DataType, offsets: np.ndarray, columns: dict[str, pa.Array]) -> pa.Array:
    """Lists of structs; where they begin is in ``offsets``."""
    fields = list(kind.value_type)
    values = pa.StructArray.from_arrays([columns[f.name].cast(f.type) for f in fields], fields=fields)
    return pa.ListArray.from_arrays(pa.array(offsets), values, type=kind)


def read(files: list[dict], target: pa.Schema) -> tuple[pa.RecordBatch, list[dict]]:
    """Facts of files (artifact, content) that ``fits`` holds for, in the columns of ``target``, and the files that are left."""
    n = len(files)
    kinds, contents, names = zip(*[_opened(f["content"]) for f in files], strict=True)
    left = np.array([k is None for k in kinds])
    given = np.array([-1 if k is None else k for k in kinds])
    data = np.frombuffer(b"".join([*contents, b"?"]), np.uint8)  # what no string was pushed for is "?"
    nothing = len(data) - 1
    length = np.fromiter(map(len, contents), np.int64, n)
    end = np.cumsum(length)
    begin = end - length
    lines = np.append(np.flatnonzero(data == 10), [len(data)] * 2)
    wide = np.concatenate(([0], np.cumsum(data >= 0x80)))

    at, no, depth = begin.copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    pushed = np.zeros((n, STRINGS, 2), np.int64)
    quoted = np.zeros((n, STRINGS), bool)
    streams, runs, refs = _Events(4), _Events(3), _Events(7)

    def push(rows, start, stop, quote) -> None:
        full = depth[rows] >= STRINGS
        left[rows[full]] = True
        rows, start, stop, quote = rows[~full], start[~full], stop[~full], quote[~full]
        place = depth[rows]
        pushed[rows, place, 0], pushed[rows, place, 1], quoted[rows, place] = start, stop, quote
        depth[rows] += 1

    def pop(rows) -> tuple[np.ndarray, np.ndarray]:
        some = depth[rows] > 0
        depth[rows] -= some
        place = depth[rows]
        left[rows[some & quoted[rows, place]]] = True
        return np.where(some, pushed[rows, place, 0], nothing), np.where(some, pushed[rows, place, 1], nothing + 1)

    active = np.flatnonzero((given <= _ZIP) & ~left)
    for _ in range(STEPS):
        if not len(active):
            break
        where, limit = at[active], end[active]
        out = where >= limit  # what ends without STOP is cut off where it ends
        op = data[np.minimum(where, nothing)]
        to = where + _LENGTH[op]
        fixed = (to > where) & ~out
        broken = out | (fixed & (to > limit))
        good = fixed & ~broken
        at[active[good]] = to[good]
        kind = np.where(fixed | out, _LEFT + 1, _KIND[op])
        broken |= kind == _BAD
        left[active[kind == _LEFT]] = True

        m = np.flatnonzero(kind == _TEXT)
        if len(m):
            rows, p, width = active[m], where[m], _WIDTH[op[m]]
            body = p + 1 + width
            size, huge = np.zeros(len(m), np.int64), np.zeros(len(m), bool)
            for i in range(int(width.max())):
                byte = np.where(i < width, data[np.minimum(p + 1 + i, nothing)], 0).astype(np.int64)
                if i < 4:
                    size |= byte << (8 * i)
                else:
                    huge |= byte > 0
            bad = (body > limit[m]) | huge | (body + size > limit[m])
            broken[m[bad]] = True
            ok = ~bad
            at[rows[ok]] = (body + size)[ok]
            ok &= _PUSH[op[m]]
            push(rows[ok], body[ok], (body + size)[ok], np.zeros(int(ok.sum()), bool))

        m = np.flatnonzero((kind == _LINES) | (kind == _LINE))
        if len(m):
            rows, p, o = active[m], where[m], op[m]
            first = np.searchsorted(lines, p + 1)
            two = kind[m] == _LINES
            middle, stop = lines[first], lines[first + two]
            bad = stop >= limit[m]
            broken[m[bad]] = True
            at[rows[~bad]] = stop[~bad] + 1
            r = two & ~bad
            refs.add(rows[r], no[rows[r]], o[r].astype(np.int64), p[r] + 1, middle[r], middle[r] + 1, stop[r])
            i = r & (o == R._INST)
            runs.add(rows[i], no[rows[i]], o[i].astype(np.int64))
            s = ~two & ~bad & _QUOTED[o]
            push(rows[s], p[s] + 1, stop[s], np.ones(int(s.sum()), bool))

        m = np.flatnonzero(kind == _STACK)
        if len(m):
            rows = active[m]
            n0, n1 = pop(rows)
            m0, m1 = pop(rows)
            refs.add(rows, no[rows], op[m].astype(np.int64), m0, m1, n0, n1)
            at[rows] += 1

        m = np.flatnonzero(kind == _RUN)
        if len(m):
            rows = active[m]
            runs.add(rows, no[rows], op[m].astype(np.int64))
            at[rows] += 1

        done = broken.copy()
        rows = active[broken]
        streams.add(rows, no[rows], at[rows], np.ones(len(rows), np.int64))
        m = np.flatnonzero(kind == _END)
        if len(m):
            rows = active[m]
            at[rows] += 1
            streams.add(rows, no[rows], at[rows], np.zeros(len(rows), np.int64))
            more = (at[rows] < end[rows]) & (data[at[rows]] == 0x80) & (given[rows] < 0) & (no[rows] + 1 < K.MAX_STREAMS)
            done[m[~more]] = True
            no[rows[more]] += 1
            depth[rows[more]] = 0
        active = active[~done & ~left[active]]
    left[active] = True

    of, _, _, m0, m1, n0, n1 = refs.of(~left)
    left[of[(wide[m1] > wide[m0]) | (wide[n1] > wide[n0])]] = True
    keep = ~left
    new = np.cumsum(keep) - 1  # which row of the result a file is
    kept = np.flatnonzero(keep)
    n = len(kept)

    file, number, stop, cut = streams.of(keep)
    per_file = _offsets(new[file], n)
    total = np.diff(per_file)[new[file]]
    entry = pa.array([f"stream {i + 1}/{t}" if t > 1 else names[f] for f, i, t in zip(file.tolist(), number.tolist(), total.tolist(), strict=True)], pa.string())
    r_file, r_no, r_op = runs.of(keep)
    ops = pa.ListArray.from_arrays(pa.array(_offsets(per_file[new[r_file]] + r_no, len(file))), _named(_OP_NAMES, r_op))
    last = np.append(cut, 0)[per_file[1:] - 1]
    base, tail, in_zip = begin[kept], end[kept] - at[kept], given[kept] >= 0
    kinds = np.where(in_zip, given[kept], np.where(last == 1, _CUT, np.where(tail > 0, _TAIL, _WHOLE)))
    f, f_no, f_op, m0, m1, n0, n1 = refs.of(keep)
    ref_at = _offsets(new[f], n)

    def of_tail(say) -> pa.Array:
        heads = [data[a : min(a + 64, e)].tobytes() if k == _TAIL else None for a, e, k in zip(at[kept].tolist(), end[kept].tolist(), kinds.tolist(), strict=True)]
        return pa.array([None if h is None else say(h) for h in heads], pa.string())

    made = {
        "artifact": lambda t: pa.array([files[i]["artifact"] for i in kept.tolist()], t),
        "format": lambda t: pa.array(["pickle"] * n, t),
        "size": lambda t: pa.array([len(files[i]["content"]) for i in kept.tolist()], t),
        "container": lambda t: _named(_CONTAINERS, kinds),
        "detail": lambda t: pa.array([R.NO_ZIP if k == _UNREADABLE else None for k in kinds.tolist()], t),
        "tail_at": lambda t: pa.array(at[kept] - base, t, mask=in_zip),
        "tail_len": lambda t: pa.array(tail, t, mask=in_zip),
        "tail_magic": lambda t: of_tail(R.identify),
        "tail_preview": lambda t: of_tail(R.preview),
        "streams": lambda t: _list(t, per_file, {"entry": entry, "stream_no": pa.array(number + 1), "exec_ops": ops, "truncated": pa.array(cut == 1), "end": pa.array(stop - begin[file])}),
        "refs": lambda t: _list(t, ref_at, {"entry": entry.take(pa.array(per_file[new[f]] + f_no)), "ord": pa.array(np.arange(len(f)) - ref_at[new[f]]), "opcode": _named(_REF_NAMES, f_op), "module": _texts(data, m0, m1), "name": _texts(data, n0, n1)}),
    }
    columns = [made[c.name](c.type) if c.name in made else pa.nulls(n, c.type) for c in target]
    return pa.RecordBatch.from_arrays(columns, schema=target), [files[i] for i in np.flatnonzero(left).tolist()]
