"""Scans of real containers, end to end: one folder of many artifacts, read once for all tests."""

import json
import struct
import zipfile

import pytest
from make import ELF, EVIL, f32, gguf, gstr, layered, safetensors

from weightscope import api


@pytest.fixture(scope="module")
def scanned(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("repo")
    one = {"weight": ("U8", [4], b"\1\2\3\4")}
    safetensors(d / "clean.safetensors", one)
    safetensors(d / "twin.safetensors", one)
    (d / "oversized.safetensors").write_bytes(struct.pack("<Q", 9999) + b"{}")
    safetensors(d / "tail.safetensors", one, tail=b"PK\3\4" + b"A" * 256)
    safetensors(d / "gap.safetensors", {"a": ("U8", [4], b"1234"), "b": ("U8", [4], b"5678")}, {"b": ELF})
    safetensors(d / "zeros.safetensors", {"a": ("U8", [4], b"1234"), "b": ("U8", [4], b"5678")}, {"b": b"\0" * 40})
    safetensors(d / "mismatch.safetensors", {"a": ("F32", [3], b"12345678"), "b": ("X1", [1], b"1")})
    text = b'{"a":{"dtype":"U8","shape":[4],"data_offsets":[0,4]},"b":{"dtype":"U8","shape":[4],"data_offsets":[2,6]},"c":5}'
    (d / "overlap.safetensors").write_bytes(struct.pack("<Q", len(text)) + text + b"123456")
    safetensors(d / "many.safetensors", {f"t{i:02}": ("U8", [4], b"1234") for i in range(40)}, {f"t{i:02}": b"X" for i in range(40)})
    layered(d / "nan.safetensors", extra={"model.layers.0.z": ("F32", [4], f32([1, float("nan"), 2, float("inf")]))})
    layered(d / "spike.safetensors", scale={3: 100.0})
    (d / "evil.bin").write_bytes(EVIL)
    (d / "cut.pkl").write_bytes(EVIL[:-3])
    (d / "stapled.pkl").write_bytes(EVIL + b"PK\3\4" + b"A" * 256)
    (d / "noise.pkl").write_bytes(EVIL + b"\1\2\3" * 50)
    magic = b"\x80\x02\x8a\x0a\x6c\xfc\x9c\x46\xf9\x20\x6a\xa8\x50\x19."
    (d / "legacy.pt").write_bytes(magic + b"\x80\x02M\xe9\x03." + b"\x80\x02}." + EVIL + b"\x80\x02]." + b"\1" * 99)
    with zipfile.ZipFile(d / "torch.pt", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/data.pkl", b"\x80\x04\x8c\x02os\x8c\x06system\x93.")
        z.writestr("archive/data/0", b"x")
    (d / "broken.pt").write_bytes(b"PK\3\4" + b"junk" * 9)
    (d / "plain.pkl").write_bytes(b"\x80\x02]q\x00.")
    gguf(d / "template.gguf", [("tokenizer.chat_template", 8, gstr("{{ x.__class__ }}"))])
    gguf(d / "mixed.gguf", [("general.architecture", 8, gstr("llama"))], [("blk.0.a", [32], 0, 0), ("blk.0.q", [256], 12, 128)], f32([0.5] * 32) + b"\1" * 144)
    gguf(d / "ggap.gguf", (), [("a", [4], 0, 0), ("b", [4], 0, 80)], f32([1] * 4) + ELF[:64] + f32([2] * 4))
    gguf(d / "iq.gguf", (), [("a", [256], 23, 0), ("b", [4], 0, 4096)], b"\0" * 4112)
    gguf(d / "clash.gguf", (), [("a", [1024], 0, 0), ("b", [4], 0, 16)], b"\0" * 32)
    gguf(d / "far.gguf", (), [("a", [4], 0, 1 << 40)], f32([1] * 4))
    gguf(d / "old.gguf", version=1)
    (d / "bad.gguf").write_bytes(b"NOPExxxxxxxxxxxx")
    (d / "config.json").write_text('{"auto_map": {"AutoModel": "modeling_x.M", "AutoTokenizer": ["org/r--tok.T", "gone.T"]}, "model_type": "bert", "hidden_size": 64}')
    (d / "modeling_x.py").write_text('import os\nos.system("id")\n    # eval(1)\nm.eval()\n')
    (d / "helper.py").write_text("x = 1\n")
    (d / "special_tokens_map.json").write_text('{"t": "hf_' + "a" * 34 + '", "u": "https://example.org/x"}')
    (d / "chat_template.jinja").write_text("{% for m in messages %}{{ m|attr('x') }}{% endfor %}")
    (d / "tokenizer_config.json").write_text('{"chat_template": "{{ cycler.__init__ }}"}')
    (d / "sub").mkdir()
    (d / "sub" / "back").symlink_to("..")
    (d / "sub" / "link.safetensors").symlink_to(d / "clean.safetensors")
    report = api.scan(spark, str(d), deep=True, tensor_entropy=True)
    return report, {a["artifact"].removeprefix(f"{d}/") + ("" if a["format"] not in ("config", "template") else f"#{a['format']}"): a for a in report.artifacts}


def ids(a):
    return {f["id"]: f["severity"] for f in a["findings"]}


PHASE2 = {"ARCH_DETECTED", "ARCH_MISMATCH", "EMBEDDED_SECRET", "SUSPICIOUS_URL", "STATS_DEFERRED_QUANTIZED", "WEIGHT_OUTLIER_LAYER", "TENSOR_ENTROPY_ANOMALY"}


@pytest.mark.parametrize(
    "name, verdict, expected",
    [
        ("clean.safetensors", "clean", {"ALIASED_ARTIFACT": "info"}),
        ("twin.safetensors", "clean", {}),
        ("oversized.safetensors", "malformed", {"ST_HEADER_MALFORMED": "high"}),
        ("tail.safetensors", "untrusted", {"ST_UNREFERENCED_BYTES": "high"}),
        ("gap.safetensors", "untrusted", {"ST_UNREFERENCED_BYTES": "high"}),
        ("zeros.safetensors", "clean", {"ST_UNREFERENCED_BYTES": "low"}),
        ("mismatch.safetensors", "untrusted", {"ST_DTYPE_SHAPE_MISMATCH": "medium", "ST_DTYPE_UNKNOWN": "low"}),
        ("overlap.safetensors", "untrusted", {"ST_OFFSET_OVERLAP": "high", "ST_HEADER_MALFORMED": "medium"}),
        ("nan.safetensors", "clean", {"WEIGHT_NAN_INF": "high"}),
        ("evil.bin", "untrusted", {"PICKLE_RCE_RISK": "high", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("cut.pkl", "untrusted", {"PICKLE_RCE_RISK": "high", "PICKLE_TRUNCATED": "medium", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("stapled.pkl", "untrusted", {"PICKLE_RCE_RISK": "high", "PICKLE_TRAILING_DATA": "high", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("noise.pkl", "untrusted", {"PICKLE_RCE_RISK": "high", "PICKLE_TRAILING_DATA": "medium", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("legacy.pt", "untrusted", {"PICKLE_RCE_RISK": "high", "PICKLE_TORCH_LEGACY": "info", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("torch.pt", "untrusted", {"PICKLE_RCE_RISK": "high", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("broken.pt", "untrusted", {"PICKLE_CONTAINER_UNREADABLE": "medium", "PICKLE_UNTRUSTED": "medium", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("plain.pkl", "untrusted", {"PICKLE_UNTRUSTED": "medium", "SAFE_ALTERNATIVE_AVAILABLE": "info"}),
        ("template.gguf", "untrusted", {"GGUF_CHAT_TEMPLATE": "low", "TEMPLATE_SANDBOX_ESCAPE": "high"}),
        ("mixed.gguf", "clean", {}),
        ("ggap.gguf", "untrusted", {"GGUF_UNREFERENCED_BYTES": "high"}),
        ("iq.gguf", "clean", {"GGUF_ACCOUNTING_INCOMPLETE": "info"}),
        ("clash.gguf", "clean", {"GGUF_ACCOUNTING_INCOMPLETE": "info"}),
        ("far.gguf", "untrusted", {"GGUF_OFFSET_OOB": "high"}),
        ("old.gguf", "malformed", {"GGUF_BAD_VERSION": "high"}),
        ("bad.gguf", "malformed", {"GGUF_PARSE_ERROR": "high"}),
        ("modeling_x.py", "untrusted", {"REMOTE_CODE_AUTO_MAP": "high", "PY_DANGEROUS_CALL": "high"}),
        ("helper.py", "clean", {"REMOTE_CODE_PRESENT": "low"}),
    ],
)
def test_findings_of_the_first_phase(scanned, name, verdict, expected):
    a = scanned[1][name]
    assert a["verdict"] == verdict
    assert {k: v for k, v in ids(a).items() if k not in PHASE2} == expected


def test_forty_gaps_are_capped(scanned):
    found = [f for f in scanned[1]["many.safetensors"]["findings"] if f["id"] == "ST_UNREFERENCED_BYTES"]
    assert len(found) == 17 and found[-1]["severity"] == "high" and "40 regions" in found[-1]["detail"]


def test_only_the_spike_is_anomalous(scanned):
    a = scanned[1]["spike.safetensors"]
    assert [p["layer"] for p in a["layer_profile"] if p["anomaly"]] == [3]
    assert a["fingerprint"]["scheme"] == "hf-llama" and a["fingerprint"]["hidden"] == 64
    assert ids(a)["ARCH_MISMATCH"] == "medium"  # config.json says bert


def test_manifest_and_file_digests(scanned):
    clean, twin, tail = (scanned[1][n]["hashes"] for n in ("clean.safetensors", "twin.safetensors", "tail.safetensors"))
    assert clean == twin and clean["manifest"] == tail["manifest"] and clean["file"] != tail["file"]
    assert "manifest" not in scanned[1]["evil.bin"]["hashes"]


def test_block_types_are_deferred(scanned):
    a = scanned[1]["mixed.gguf"]
    by = {t["name"]: t for t in a["stats"]["per_tensor"]}
    assert by["blk.0.a"]["mean"] == 0.5 and by["blk.0.q"]["quality"] == "deferred_quantized" and "mean" not in by["blk.0.q"]
    assert "STATS_DEFERRED_QUANTIZED" in ids(a)


def test_secrets_and_urls(scanned):
    a = scanned[1]["clean.safetensors"]
    assert ids(a)["EMBEDDED_SECRET"] == "high" and ids(a)["SUSPICIOUS_URL"] == "info"
    assert all("a" * 20 not in str(f) for f in a["findings"])


def test_configs_and_templates(scanned):
    _, by = scanned
    assert ids(by["config.json#config"]) == {"REMOTE_CODE_EXTERNAL": "high", "REMOTE_CODE_UNRESOLVED": "medium"}
    assert ids(by["chat_template.jinja#template"]) == {"TEMPLATE_DYNAMIC_ATTRIBUTE": "medium"}
    assert ids(by["tokenizer_config.json#config"]) == {"TEMPLATE_SANDBOX_ESCAPE": "high"}


def test_legacy_streams_are_all_read(scanned):
    risk = next(f for f in scanned[1]["legacy.pt"]["findings"] if f["id"] == "PICKLE_RCE_RISK")
    assert any("stream 4/5" in e and "os.system" in e for e in risk["evidence"])


def test_report_forms(scanned):
    report, _ = scanned
    assert report.exit_code() == 2 and '"artifacts"' in report.to_json()
    json.loads(report.to_json(), parse_constant=pytest.fail)
    assert "malformed" in report.to_human() and "▁" in report.sparklines() and report.svg().startswith("<svg")


def test_links_and_cycles(scanned):
    assert sum(a.endswith("clean.safetensors") or a.endswith("link.safetensors") for a in scanned[1]) == 1


def test_empty_and_missing(spark, tmp_path):
    report = api.scan(spark, str(tmp_path))
    assert (report.exit_code(), report.exit_code(allow_empty=True)) == (4, 0)
    report = api.scan(spark, str(tmp_path / "nowhere" / "x"))
    assert report.exit_code() == 3 and ids(report.artifacts[0]) == {"PATH_NOT_FOUND": "high"}
