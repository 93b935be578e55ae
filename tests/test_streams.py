"""Folders that are watched, progress, and ranges that are read part by part."""

import io
import json
import types

from make import EVIL, layered, safetensors

from weightscope.plans import report, scan
from weightscope.plans.progress import Progress
from weightscope.sources import readers
from weightscope.streaming.watch import watch


def test_a_batch_is_one_scan(spark, tmp_path):
    folder, got = tmp_path / "in", []
    folder.mkdir()
    safetensors(folder / "a.safetensors", {"w": ("U8", [4], b"1234")})
    (folder / "b.pkl").write_bytes(EVIL)
    for more in ((), ("c.pkl",)):
        for name in more:
            (folder / name).write_bytes(EVIL)
        watch(spark, str(folder), f"file://{tmp_path}/seen", got.append).awaitTermination()
    assert sorted((r.artifacts[0]["artifact"].rsplit("/", 1)[1], r.artifacts[0]["verdict"]) for r in got) == [("a.safetensors", "clean"), ("b.pkl", "untrusted"), ("c.pkl", "untrusted")]


def test_progress():
    stage = types.SimpleNamespace(numCompletedTasks=3, numTasks=8)
    tracker = types.SimpleNamespace(getActiveStageIds=lambda: [1, 2], getStageInfo=lambda i: stage if i == 1 else None)
    spark = types.SimpleNamespace(sparkContext=types.SimpleNamespace(statusTracker=lambda: tracker))
    out = io.StringIO()
    with Progress(spark, out, every=0.01) as p:
        while not p.shown:
            pass
    assert "1 stage(s), 3 of 8 tasks" in out.getvalue() and out.getvalue().endswith("\r")


def test_ranges_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(readers, "PART", 16)
    rows = [("a", bytes(100)), ("b", b"\x7fELF" + bytes(60)), ("c", bytes(99) + b"x"), ("d", b"")]
    df = spark.createDataFrame([(k, k, 0, len(c), len(c), c) for k, c in rows], "artifact string, path string, start long, len long, byte_len long, content binary")
    got = {r["artifact"]: (r["all_zero"], r["magic"]) for r in readers.look_at(df, ["artifact"]).collect()}
    assert got == {"a": (True, None), "b": (False, "an ELF executable"), "c": (False, None), "d": (True, None)}
    bits = {r["artifact"]: r["entropy"] for r in readers.byte_entropies(df, ["artifact"]).collect()}
    assert bits["a"] == 0 == bits["d"] and abs(bits["c"] - 0.0807931) < 1e-6


def test_documents_of_executors(spark, tmp_path):
    nan = b"\0\0\xc0\x7f"
    layered(tmp_path / "m.safetensors", scale={2: 90.0}, extra={"model.layers.0.z": ("F32", [2], nan * 2)})
    (tmp_path / "b.pkl").write_bytes(EVIL)
    (tmp_path / "x.py").write_text("import os\nos.system(1)\n")
    found = scan.run(spark, str(tmp_path), deep=True)
    want = report.collect(found).artifacts
    got = sorted(((r["kind"], r["artifact"]), json.loads(r["report"])) for r in report.documents(found).collect())
    assert [g for _, g in got] == json.loads(json.dumps(report.plain(want))) and len(got) == 3
