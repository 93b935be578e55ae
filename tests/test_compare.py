"""Comparisons of real containers."""

import json

import pytest
from make import f32, gguf, layered, safetensors

from weightscope import api, cli


def ids(c):
    return {f["id"]: f["severity"] for f in c.doc["findings"]}


def test_identity(spark, tmp_path):
    a = layered(tmp_path / "a.safetensors")
    c = api.compare(spark, a, a)
    assert ids(c) == {"IDENTICAL": "info"} and c.exit_code() == 0
    assert c.doc["summary"] == {"matched": 6, "identical_fraction": 1.0, "structural": 0, "worst_drift": 0.0}


def test_command_line(spark, tmp_path, capsys):
    a = layered(tmp_path / "a.safetensors", scale={3: 4.0})
    b = layered(tmp_path / "b.safetensors")
    assert cli.main(["compare", a, b, "--json", "--svg", str(tmp_path / "x.svg")], spark) == 1
    assert json.loads(capsys.readouterr().out)["arch"]["match"] and (tmp_path / "x.svg").read_text().startswith("<svg")


def test_one_scaled_layer(spark, tmp_path):
    c = api.compare(spark, layered(tmp_path / "s.safetensors", scale={3: 4.0}), layered(tmp_path / "b.safetensors"))
    odd = [p["layer"] for p in c.doc["layer_drift"] if p["anomaly"]]
    assert odd == [3] and ids(c)["LAYER_DRIFT_OUTLIER"] == "high" and c.exit_code() == 1
    assert c.doc["layer_drift"][3]["rel_l2"] == pytest.approx(3.0, rel=1e-6)
    assert "layer 3" in c.to_human() and c.svg().startswith("<svg")


def test_other_architectures_are_refused(spark, tmp_path):
    a, b = layered(tmp_path / "a.safetensors", 8), layered(tmp_path / "b.safetensors", 4)
    c = api.compare(spark, a, b)
    assert ids(c) == {"ARCH_MISMATCH": "high"} and c.doc["tensor_drift"] == []
    c = api.compare(spark, a, b, force=True)
    assert ids(c)["ARCH_MISMATCH"] == "medium" and c.doc["summary"]["structural"] == 4


def test_ties_and_prefixes(spark, tmp_path):
    wte = ("F32", [16], f32([(k - 8) * 0.02 for k in range(16)]))
    bare = layered(tmp_path / "a.safetensors", 4, prefix="h.", extra={"wte.weight": wte})
    full = layered(tmp_path / "b.safetensors", 4, prefix="transformer.h.", extra={"transformer.wte.weight": wte, "lm_head.weight": wte})
    c = api.compare(spark, full, bare)
    assert ids(c) == {"TIED_WEIGHT": "info", "IDENTICAL": "info"} and c.doc["summary"]["matched"] == 5 and len(c.doc["normalization"]) == 1


def test_errors(spark, tmp_path):
    a = safetensors(tmp_path / "a.safetensors", {"t": ("F32", [2], f32([1, 2]))})
    g = gguf(tmp_path / "g.gguf", (), [("a", [4], 0, 0)], f32([1] * 4))
    assert ids(api.compare(spark, a, g)) == {"COMPARE_ERROR": "high"}
    assert ids(api.compare(spark, a, str(tmp_path / "none.safetensors"))) == {"COMPARE_ERROR": "high"}
