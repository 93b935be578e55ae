"""Hashes, signatures, decoders and container readers against known answers."""

import hashlib
import json
import random
import struct

import numpy as np
import pytest
from make import EVIL, safetensors

from weightscope import cli
from weightscope.functions import blake3, ed25519, numeric
from weightscope.operators import signature
from weightscope.plans import report
from weightscope.sources import containers, walk


def test_blake3_known_answers():
    assert blake3.hexdigest(b"") == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert blake3.hexdigest(b"abc") == "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"


def test_blake3_against_the_jvm(spark):
    jvm = spark.sparkContext._jvm.org.apache.commons.codec.digest.Blake3
    for n in (1, 63, 64, 65, 1023, 1024, 1025, 2048, 3072, 5000, 70000):
        data = random.Random(n).randbytes(n)
        assert blake3.hexdigest(data) == bytes(b & 255 for b in jvm.hash(bytearray(data))).hex(), n


def test_blake3_in_segments(monkeypatch):
    data = random.Random(5).randbytes(150_000)
    whole = blake3.hexdigest(data)
    monkeypatch.setattr(blake3, "SEGMENT", 1 << 14)
    assert blake3.hexdigest(data) == whole


def test_ed25519():
    key, sig = ed25519.sign(bytes([7]) * 32, b"blake3:ab")
    assert ed25519.verify(key, b"blake3:ab", sig) and not ed25519.verify(key, b"blake3:ac", sig)
    known, _ = ed25519.sign(bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60"), b"")
    assert known.hex() == "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a"


def test_decoders():
    half = numeric.decode(struct.pack("<4H", 0x3C00, 0xC000, 0x7C01, 0x7C00), "F16")
    assert half[0] == 1 and half[1] == -2 and np.isnan(half[2]) and np.isinf(half[3])
    assert numeric.decode(struct.pack("<H", 0x3F80), "BF16")[0] == 1
    assert numeric.decode(b"\0\2", "BOOL").tolist() == [0, 1]
    assert numeric.decode(struct.pack("<H", 0x3800) + bytes(range(32)), "Q8_0").tolist() == [0.5 * j for j in range(32)]
    assert not numeric.decode(struct.pack("<H", 0x3C00) + b"\x88" * 16, "Q4_0").any()
    q5 = struct.pack("<HHI", 0x3C00, 0x3C00, 1 << 31) + b"\x10" * 16  # value 1 + offset 1, the last one with its fifth bit
    assert numeric.decode(q5, "Q5_1").tolist() == [1.0] * 16 + [2.0] * 15 + [18.0]
    assert len(numeric.decode(struct.pack("<H", 0) + bytes(32), "Q8_0", 5)) == 5


def test_moments():
    m = numeric.moments(np.array([2, 4, 4, 4, 5, 5, 7, 9.0]))
    assert (m["mean"], m["m2"] / 8) == (5, 4)
    assert numeric.moments(np.array([1, np.nan, 2, np.inf, 3]))["mean"] == 2


def test_pickle_streams():
    s = containers.scan_stream(EVIL)
    assert s["exec_ops"] == ["REDUCE"] and s["refs"][0] == {"opcode": "GLOBAL", "module": "os", "name": "system"} and not s["truncated"]
    assert containers.scan_stream(EVIL[:-3])["truncated"]
    assert containers.scan_stream(b"p0\n.")["truncated"]  # PUT is not followed


@pytest.mark.parametrize("head, name, kind", [(b"GGUF", "x", "gguf"), (b"PK\3\4", "x.safetensors", "pickle"), (b"\x80\2", "a.safetensors", "pickle"), (b"\1\0\0\0\0\0\0\0{", "x", "safetensors"), (b"zz", "x.PT", "pickle"), (b"zz", "x", "unknown")])
def test_detect(head, name, kind):
    assert containers.detect(name, head) == kind


def test_strict_header(tmp_path):
    for text in (b'{"a": NaN}', b"[]", b'{"a": 1} x'):
        assert "header_error" in containers.read_safetensors(struct.pack("<Q", len(text)) + text)


def test_signatures(tmp_path):
    manifest = "blake3:" + "a" * 64
    key, sig = ed25519.sign(bytes([7]) * 32, manifest.encode())
    model = tmp_path / "m.safetensors"
    safetensors(model, {"t": ("U8", [1], b"1")})
    ev = lambda b=None, k=None, m=manifest: signature.evaluate(str(model), m, str(b) if b else None, str(k) if k else None)
    assert ev() == ("unsigned", None)

    def put(name, data):
        (tmp_path / name).write_bytes(data if isinstance(data, bytes) else data.encode())
        return tmp_path / name

    raw, hexed, pub = put("s.raw", sig), put("s.hex", sig.hex() + "\n"), put("k", key)
    assert ev(raw, pub)[0] == ev(hexed, pub)[0] == "signed"
    assert ev(raw)[1]["id"] == "SIG_NO_KEY" and ev(raw, pub, None)[1]["id"] == "SIG_NO_MANIFEST" and ev(raw, tmp_path / "no")[1]["id"] == "SIG_KEY_UNREADABLE"
    assert ev(raw, pub, "blake3:x")[1]["id"] == "SIG_MISMATCH" and ev(put("bad", b"x"), pub)[1]["id"] == "SIG_ERROR"
    assert ev(put("t.json", json.dumps({"manifest": manifest})))[1]["id"] == "SIG_MANIFEST_MATCH"
    assert ev(put("u.json", json.dumps({"manifest": "no"})))[0] == "signature-mismatch"
    assert ev(put("v.json", '{"tlogEntries": []}'))[0] == "unverified (sigstore)" and ev(put("w.json", "{}"))[1]["id"] == "SIG_UNRECOGNIZED"
    assert ev(tmp_path / "none")[1]["id"] == "SIG_BUNDLE_UNREADABLE"
    put("model.sig", sig)
    assert walk.sidecar(str(model)) == str(tmp_path / "model.sig") and ev(None, pub)[0] == "signed"


def test_exit_codes_and_severities():
    a = lambda v, s="info": {"artifact": "x", "format": "f", "verdict": v, "findings": [{"id": "I", "severity": s, "detail": "d"}], "signature": "unsigned"}
    code = lambda *xs, **k: report.Report(list(xs)).exit_code(**k)
    assert [code(a("error")), code(a("empty")), code(a("malformed")), code(a("clean", "high")), code(a("clean", "medium"))] == [3, 4, 2, 1, 0]
    assert code(a("clean", "medium"), fail_on=" Medium ") == 1 and code(a("error"), a("malformed")) == 3
    assert report.human_size(1536) == "1.5 KiB" and report.human_duration(0.5) == "500ms" and report.bars([1, 1]) == "▁▁"


def test_arguments():
    o = cli.parser().parse_args(["compare", "a", "b", "--fail-on", "LOW", "--mad-k", "3"])
    assert (o.subject, o.fail_on, o.mad_k, o.epsilon) == ("a", "low", 3.0, 1e-6)


def test_digest_is_of_the_file(tmp_path):
    assert len(hashlib.sha256(b"").hexdigest()) == len(blake3.hexdigest(b""))
