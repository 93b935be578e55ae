"""Damaged and hostile containers give findings, never exceptions, and in little time."""

import io
import random
import struct
import time
import zipfile

import pytest
from make import EVIL, f32, gguf, gstr, layered

from weightscope.sources import containers


def torch_zip(method=zipfile.ZIP_DEFLATED, body=EVIL + b"x" * 300):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        z.writestr("archive/data.pkl", body)
        z.writestr("archive/data/0", b"y" * 64)
    return out.getvalue()


@pytest.fixture(scope="module")
def samples(tmp_path_factory):
    d = tmp_path_factory.mktemp("fuzz")
    strings = struct.pack("<IQ", 8, 2) + gstr("a") + gstr("bc")
    g = gguf(d / "a.gguf", [("general.alignment", 4, struct.pack("<I", 32)), ("l", 9, strings)], [("blk.0.a", [32], 0, 0)], f32([0.5] * 32))
    paths = [layered(d / "a.safetensors", n=2), g]
    kinds = [(containers.read_safetensors, "header_error"), (containers.read_gguf, "header_error")]
    out = [(read, open(p, "rb").read()) for (read, _), p in zip(kinds, paths, strict=True)]
    methods = (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA)
    return out + [(containers.read_pickle, EVIL * 3)] + [(containers.read_pickle, torch_zip(m)) for m in methods]


def test_cut_and_flipped_bytes(samples):
    rng = random.Random(9)
    begin = time.monotonic()
    for read, data in samples:
        for _ in range(250):
            bad = bytearray(data[: rng.randrange(len(data) + 1)] if rng.random() < 0.4 else data)
            for _ in range(rng.randrange(1, 6) if bad else 0):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            assert isinstance(read(bytes(bad)), dict)
    assert time.monotonic() - begin < 60


def test_a_corrupt_entry():
    data = torch_zip(body=random.Random(1).randbytes(4000))
    at = data.index(b"archive/data.pkl") + 40
    assert containers.read_pickle(data[:at] + b"\xff" * 30 + data[at + 30 :])["container"] == "unreadable"


def test_a_bomb():
    got = containers.read_pickle(torch_zip(body=b"\x80\x02" + b"0" * (8 << 20)), most=1 << 20)
    assert got["container"] == "unreadable" and "inflates" in got["detail"]


def test_deep_arrays(tmp_path):
    path = gguf(tmp_path / "deep.gguf", [("k", 9, struct.pack("<IQ", 9, 1) * 100_000)])
    assert "header_error" in containers.read_gguf(open(path, "rb").read())


def test_mentions_are_no_calls(spark):
    from weightscope.operators import text

    code = "x = 'importlib.import_module is slow'\nimportlib.import_module(n)\n" + "eval(1)\n" * 30
    got = text.python_findings(spark.createDataFrame([(1, code), (2, "clean"), (3, None)], "k int, text string"), ["k"]).collect()
    assert sorted((r["ord"], r["line_no"], r["needle"]) for r in got)[:2] == [(1, 2, "importlib.import_module("), (2, 3, "eval(")]
    assert [(r["needle"], r["evidence"]) for r in got if r["ord"] == 21] == [("(more)", "11 more not listed")] and len(got) == 21
