"""Steps that must not grow faster than their input, and sizes at their edges."""

import io
import re
import time
import zipfile

import numpy as np
import pyarrow as pa
import pytest
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weightscope import container_queries
from weightscope.functions import blake3, numeric
from weightscope.functions import columns as C
from weightscope.operators import text
from weightscope.plans import scan
from weightscope.queries import ORACLE_SQL, QUERIES
from weightscope.sources import containers, pickles, readers


def parts_table(spark, tmp_path, n=40):
    spark.range(n).selectExpr("id AS p_partkey", "CAST(id % 50 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    return str(tmp_path)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_made_and_read_once(spark, tmp_path):
    # files were made anew and joined to their own tensors, by broadcast as their estimated size is small.
    got = QUERIES["dtype_decode"](spark, parts_table(spark, tmp_path))
    assert plan(got).count("MapInArrow") == 3 and plan(got).count("Join") == 1  # the table of types
    assert got.count() == 400


def test_moments_of_many():
    rng = np.random.default_rng(1)
    odd = rng.standard_normal(8).astype("<f4")
    odd[3] = np.nan
    chunks = [(rng.standard_normal(8).astype("<f4").tobytes(), "F32", None) for _ in range(5)] + [(odd.tobytes(), "F32", None), (b"", "F32", None), (b"\x01\x02\x03", "I16", None), (bytes(range(34)) * 2, "Q8_0", 40), (bytes(34), "Q8_0", 0), (bytes(5000), "U8", None)]
    for got, (raw, kind, elements) in zip(numeric.moments_of(chunks), chunks, strict=True):
        want = numeric.moments(numeric.decode(raw, kind, elements))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_chunks_carry_their_own_bytes(spark, monkeypatch):
    monkeypatch.setattr(readers, "CHUNK_VALUES", 64)
    t = spark.createDataFrame([("a", "a", 8, 1000, "U8", 1000, b"h" * 8 + bytes(range(250)) * 4), ("b", "b", 2, 130, "F16", 65, b"xx" + bytes(130))], "artifact string, path string, start long, byte_len long, decode string, elements long, content binary")
    sizes = {(r["artifact"], r["chunk"]): len(r["content"]) for r in readers._chunks(t, ["artifact"]).collect()}
    assert sizes == {**{("a", i): 64 for i in range(15)}, ("a", 15): 40, ("b", 0): 128, ("b", 1): 2}
    assert bytes(readers._chunks(t, ["artifact"]).where("artifact = 'a' and chunk = 1").first()["content"]) == bytes(range(64, 128))


def test_digests_of_many():
    # buffers were hashed one by one, at some 20 ms each however short.
    sizes = [0, 1, 64, 65, 1023, 1024, 1025, 2048, 2049, 3073, 5000, 7168, 9000, 31 * 1024 + 1, 300_000, 0]
    buffers = [bytes(i % 251 for i in range(n)) for n in sizes]
    assert blake3.hexdigests(buffers) == [blake3.hexdigest(b) for b in buffers]
    start = time.process_time()
    assert len(set(blake3.hexdigests([b"%d" % i for i in range(3000)]))) == 3000
    assert time.process_time() - start < 3


def test_digests_of_long_contents(spark, monkeypatch):
    monkeypatch.setattr(blake3, "SEGMENT", 2048)
    data = bytes(i % 251 for i in range(9000))
    rows = [("a", "a", 0, 9000, data), ("b", "b", 3, 2048, data), ("c", "c", 0, 0, b"")]
    ranges = spark.createDataFrame(rows, "artifact string, path string, begin long, len long, content binary")
    got = {r["artifact"]: r["digest"] for r in readers.range_digests(ranges, ["artifact"]).collect()}
    monkeypatch.undo()
    assert got == {a: blake3.hexdigest(d[b : b + n]) for a, _, b, n, d in rows}


def test_pickles_are_read_once(spark, tmp_path):
    # every finding made and read all files again.
    spark.range(1, 25).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    got = QUERIES["pickle_container"](spark, str(tmp_path))
    assert "MapInArrow" not in plan(got)
    assert {r["artifact"] for r in got.collect()} == {str(i) for i in range(1, 25)}


def test_sizes_are_rounded_as_the_sql_does(spark, tmp_path):
    # halves went up, and sizes from 1024 GiB on were in TiB.
    import duckdb

    near = [1280, 1792, 1100 * 2**30, 5 * 2**40 + 2**28, 2**20 - 1, 2**20 - 52, 2**30 - 1, 1023, 1024, 2**53 + 1, 9 * 10**15 + 7]
    rows = [(n, m) for n in (1, 2, 3, 7, 64, 1000, 2**20, 3 * 2**18, 10**7 + 1, 2**30 + 2**19) for m in range(256)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    want = db.sql(ORACLE_SQL["human_sizes"]).fetchall()
    got = QUERIES["human_sizes"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want) and any("GiB" in w[1] and float(w[1].split()[0]) >= 1024 for w in want)
    shown = spark.createDataFrame([(n,) for n in near], "n long").select(C.human_size(F.col("n")).alias("s"), C.human_size(F.col("n"), C.UNITS[:3]).alias("g")).collect()
    expected = [f"{n} B" if n < 1024 else next(f"{n / 1024**i:.1f} {u}" for i, u in enumerate(C.UNITS, 1) if n < 1024 ** (i + 1) or u == "TiB") for n in near]
    assert [r["s"] for r in shown] == expected and [r["s"] for r in shown][:3] == ["1.2 KiB", "1.8 KiB", "1.1 TiB"] and shown[2]["g"] == "1100.0 GiB"


def test_rows_are_read_in_runs(spark, tmp_path):
    # every row was a batch of its own, and all columns of the table went to Python.
    batch = pa.RecordBatch.from_pylist([{"k": i, "b": bytes(1000)} for i in range(5000)])
    runs = list(readers._runs(batch))
    assert [r["k"] for run in runs for r in run] == list(range(5000)) and 5 <= len(runs) <= 10
    big = pa.RecordBatch.from_pylist([{"k": i, "b": bytes(readers.BYTES if i == 2 else 10)} for i in range(5)])
    assert max(map(len, readers._runs(big))) < 5 and sum(map(len, readers._runs(big))) == 5
    spark.range(1, 9).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey", "'x' AS o_unread").write.parquet(f"{tmp_path}/orders.parquet")
    assert "o_unread" not in plan(QUERIES["pickle_streams"](spark, str(tmp_path))).split("Relation")[0]


def test_entropy_of_a_tensor_is_one_row(spark, monkeypatch):
    # a tensor of one part was 256 rows of counts, each of them shuffled.
    monkeypatch.setattr(readers, "PART", 100)
    data = [("a", bytes(range(100)) * 3), ("b", b"xy" * 50), ("c", b""), ("d", b"ab" * 65)]
    t = spark.createDataFrame([(k, k, 2, len(x), b"##" + x) for k, x in data], "artifact string, path string, start long, byte_len long, content binary")
    made = readers.byte_entropies(t, ["artifact"])
    assert "posexplode" not in plan(made)
    assert {r["artifact"]: round(r["entropy"], 9) for r in made.collect()} == {"a": round(np.log2(100), 9), "b": 1, "c": 0, "d": 1}


def test_regions_are_not_joined_to_themselves(spark, monkeypatch):
    # F8: regions, with their files' bytes, were made again and joined to what was seen in them.
    monkeypatch.setattr(readers, "PART", 16)
    rows = [("a", 0, "a", 3, 40, "x", b"###" + bytes(40)), ("a", 1, "a", 0, 50, None, b"\x7fELF" + bytes(46)), ("b", 0, "b", 0, 40, "y", bytes(39) + b"z"), ("c", 0, "c", 4, 0, "e", b"head")]
    t = spark.createDataFrame(rows, "artifact string, idx long, path string, start long, len long, place string, content binary")
    made = readers.look_at(t, ["artifact", "idx"])
    assert "Join" not in plan(made) and set(made.columns) == {*t.columns, "all_zero", "magic", "preview"} - {"content"}
    got = {(r["artifact"], r["idx"]): (r["start"], r["len"], r["place"], r["all_zero"], r["magic"]) for r in made.collect()}
    assert got == {("a", 0): (3, 40, "x", True, None), ("a", 1): (0, 50, None, False, "an ELF executable"), ("b", 0): (0, 40, "y", False, None), ("c", 0): (4, 0, "e", True, None)}


def test_manifests_are_hashed_together(spark):
    # every artifact was a group and a hash of its own.
    t = spark.createDataFrame([("m", "b", "F32", [2, 3]), ("m", "a", "I64", []), ("n", "é", "U8", [1])], "artifact string, name string, type_name string, shape array<bigint>")
    digests = t.select("artifact", "name", F.concat("name", F.lit("-digest")).alias("digest"))
    made = scan.manifests(t, digests, b"tag")
    assert "FlatMapGroups" not in plan(made)
    size = lambda b: len(b).to_bytes(8, "little") + b
    entry = lambda n, k, s: size(n.encode()) + size(k.encode()) + b"".join(x.to_bytes(8, "little") for x in (len(s), *s)) + size(f"{n}-digest".encode())
    want = {"m": b"tag" + entry("a", "I64", []) + entry("b", "F32", [2, 3]), "n": b"tag" + entry("é", "U8", [1])}
    assert {r["artifact"]: r["manifest"] for r in made.collect()} == {k: f"blake3:{blake3.hexdigest(v)}" for k, v in want.items()}


def test_statistics_read_stored_tensors(spark, tmp_path):
    # files were made and read again for each of the steps of the statistics.
    spark.range(1, 12).selectExpr("id AS s_suppkey", "concat('s', id) AS s_name").write.parquet(f"{tmp_path}/supplier.parquet")
    made = QUERIES["deferred_types"](spark, str(tmp_path))
    assert plan(made).count("MapInArrow") <= 1  # outliers alone
    assert sorted(map(tuple, made.collect())) == sorted((str(k), "" if k % 10 == 0 else "Q4_K", 5) for k in range(1, 12))


def test_next_offsets_of_gguf(spark):
    t = [(0, "a", "", 0, [64], 64, None, None), (1, "b", "", 0, [64], 0, None, None), (2, "c", "", 0, [64], 64, None, None), (3, "d", "", 0, [64], 900, None, None)]
    facts = spark.createDataFrame([("x", "gguf", None, 8, 400, None, 32, t, b"#" * 408)], "artifact string, format string, header_error string, data_start long, seg_len long, info_end long, alignment long, tensors array<struct<ord: int, name: string, dtype: string, type_id: int, shape: array<bigint>, begin: bigint, end: bigint, problem: string>>, content binary")
    got = {r["name"]: (r["avail_len"], r["status"], len(r["content"])) for r in scan.tensors_of(facts, ("gguf",)).collect()}
    assert got == {"b": (64, "ok", 408), "a": (0, "ok", 408), "c": (836, "ok", 408), "d": (0, "out_of_bounds", 408)}


def test_entropy_looks_once_a_character(spark):
    # every distinct character of a token was compared with all, each time split anew.
    texts = ["", "a", "aab", "é€é𝄞", "x" * 40, "".join(chr(33 + i % 90) for i in range(300))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.shannon_entropy(F.col("t")).alias("b")).collect()
    want = {t: -sum(t.count(c) / len(t) * np.log2(t.count(c) / len(t)) for c in set(t)) for t in texts}
    assert all(r["b"] == pytest.approx(want[r["t"]]) for r in got)
    long = spark.createDataFrame([("".join(chr(256 + i) for i in range(3000)),)], "t string")
    start = time.monotonic()
    assert long.select(C.shannon_entropy(F.col("t"))).first()[0] == pytest.approx(np.log2(3000))
    assert time.monotonic() - start < 5


def test_first_of_a_kind(spark):
    rows = [(1, "A", "low", "d", "late", 7), (1, "A", "high", "d", None, 2), (1, "B", None, "d", "x", 0), (2, "A", "low", "d", "y", 1)]
    found = spark.createDataFrame(rows, "k long, id string, severity string, detail string, evidence string, pos int")
    got = text.first_of(found, ["k"])
    assert got.columns == ["k", "id", "severity", "detail", "evidence"] and "Window" not in plan(got)
    assert sorted(map(tuple, got.collect()), key=str) == [(1, "A", "high", "d", None), (1, "B", None, "d", "x"), (2, "A", "low", "d", "y")]


def test_obfuscation_looks_at_lengths_first(spark):
    # each line was tried for a run of 200 from every one of its characters.
    run = "A" * 200
    cases = ["x" * 199, run, "é" + run, run + "=" + run, "a = '" + run + "'", ("b" * 199 + " ") * 3, "\\x", "plain", "", None, "é" * 250]
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.may_matter(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == [None if t is None else "\\x" in t or bool(re.search("[A-Za-z0-9+/=]{200}", t)) for t in cases]
    hard = spark.createDataFrame([(("c" * 199 + " ") * 100_000,)], "t string").select(text.may_matter(F.col("t")))
    start = time.monotonic()
    assert hard.first()[0] is False
    assert time.monotonic() - start < 5


def test_lines_are_passed_over_as_they_are(spark):
    # each line had its indent and end cut by two patterns, once for each condition on it.
    code = "import os\r\n  os.system(1)\r\n\t\x0b# eval(1)\r\n\r\r\nxeval(1)\n\n exec(2)\r\r\nm.eval(3);eval(4)\n#exec(1)\n eval(5)\nhttpx.get\nos.execve(1) subprocess.run\n"
    texts = spark.createDataFrame([(1, code), (2, "nothing (here)\n"), (3, None)], "k long, text string")
    got = text.python_findings(texts, ["k"])
    assert "RLIKE(text" not in plan(got)
    rows = sorted((r["line_no"], r["needle"]) for r in got.collect())
    assert rows == [(2, "os.system("), (7, "exec("), (8, "eval("), (10, "eval("), (11, "httpx."), (12, "os.execv"), (12, "subprocess.")]
    assert [r["line"] for r in text.code_lines(texts.where("k = 1"), ["k"]).orderBy("line_no").collect()][:3] == ["import os", "os.system(1)", "xeval(1)"]


def test_pickles_are_read_where_they_are_made(spark, tmp_path):
    # files went through the JVM between two Python workers, and all facts of them came back.
    spark.range(1, 9).selectExpr("id AS o_orderkey", "id % 7 AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    seen = plan(QUERIES["pickle_streams"](spark, str(tmp_path)))
    assert seen.count("MapInArrow") == 1 and "tail_preview" not in seen


def zip_of(*members, method=zipfile.ZIP_DEFLATED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members:
            info = zipfile.ZipInfo(name)
            info.compress_type, info.external_attr = method, 0o600 << 16
            z.writestr(info, body)
        z.comment = comment
    return out.getvalue()


def test_common_zips_are_read_at_once(monkeypatch):
    # a zip of one short pickle was made and read by zipfile, at some 180 microseconds.
    body = b"\x80\x04\x8c\x02os\x8c\x06system\x93."
    assert container_queries._zip_of_one("a/data.pkl", body) == zip_of(("a/data.pkl", body))
    common = [zip_of(("a.pkl", body), ("b.txt", b"x"), ("C.PICKLE", b"" if m else body), method=m) for m in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED)]
    flipped = bytearray(common[1])
    flipped[38] ^= 1
    other = [zip_of(("a.pkl", body), method=zipfile.ZIP_BZIP2), zip_of(("é.pkl", body)), zip_of(("a.pkl", body), comment=b"c"), b"PK\3\4" + common[0], bytes(flipped)]
    assert all(containers._simple_zip(z, 1 << 20) is None for z in other)
    assert [containers.read_pickle(z)["container"] for z in other] == ["zip", "zip", "zip", "zip", "unreadable"]
    want = [(i.filename, zipfile.ZipFile(io.BytesIO(z)).read(i)) for z in common for i in zipfile.ZipFile(io.BytesIO(z)).infolist() if i.filename != "b.txt"]
    monkeypatch.setattr(zipfile, "ZipFile", None)
    assert [x for z in common for x in containers._zip_pickles(z, 1 << 20)] == want


def test_references_are_numbered_through():
    # Those of one stream had the numbers 0, 2, 4, so that they came among those of the next.
    one = b"\x80\x02cos\na\ncos\nb\ncos\nc\n."
    assert [(r["ord"], r["name"]) for r in containers.read_pickle(one * 2)["refs"]] == list(enumerate("abcabc"))


def test_short_pickles_are_read_many_at_a_time(spark):
    # pickles were read one by one, at some 45 microseconds each, and made rows one by one.
    ref = b"\x80\x04\x8c\x02os\x8c\x06system\x93"
    short = [
        b"\x80\x02cos\nsystem\nU\x02id\x85R.", ref + b".", b"\x80\x02cos\na\n." + ref + b"R.", ref + b".\x7fELF" + bytes(70), ref, b"\x80", b"\x80\x02\xff",
        b"\x80\x02]q\x00." * 3 + b"\x80\x02co", b"\x80\x02.\x80", b"\x80\x02.x", b"\x80\x02(ios\nb\n.", b"\x80\x02\x93\x93.", b"\x80\x02X\x02\0\0\0os\x8d\x01\0\0\0\0\0\0\0x\x93b.",
        b"\x80\x02U\x01a" * 3 + b"\x93\x93.", b"\x80\x02U\x09abc.", b"\x80\x02\x8d\x01\0\0\0\0\0\0\x01x.", b"\x80\x02Va\n.", b"\x80\x02Fa",
        zip_of(("a.pkl", ref + b".")), zip_of(("a.pkl", ref + b"." + ref + b".")), zip_of(("a.pkl", b"")), zip_of(("a.txt", b"x")), b"PK\3\4junk",
    ]
    other = [
        b"\x80\x02\x8a\x0al\xfc\x9cF\xf9 j\xa8P\x19.\x80\x02." + bytes(9), b"\x80\x02" + b"U\x01a" * 20 + b"\x93.", b"\x80\x02" + b"0" * 99 + b".", "\x80\x02cos\né\n.".encode("latin-1"), b"\x80\x02S'os'\nS'b'\n\x93.",
        zip_of(("a.pkl", ref + b"."), ("b.pkl", b"\x80\x02.")), zip_of(("a.pkl", ref), comment=b"c"), zip_of(("a.pkl", ref))[:-1],
    ]
    files = [{"artifact": str(i), "content": c} for i, c in enumerate([*short, *other])]
    target = readers._arrow(StructType.fromDDL(readers.FACTS))
    got, left = pickles.read(files, target)
    got.validate(full=True)
    assert all(pickles.fits(f["content"]) for f in files) and left == files[len(short) :]
    assert got.to_pylist() == pa.RecordBatch.from_pylist([readers._fact(f) for f in files[: len(short)]], target).to_pylist()
    assert not pickles.fits(b"\x80\x02" + bytes(pickles.SHORT)) and not pickles.fits(b"cos\n") and not pickles.fits(b"")
    mixed = [*short, *other, b"\x80\x02" + b"0" * pickles.SHORT + b".", b"cos\n", b"", b"GGUF"]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(mixed)], "i int, c binary")
    facts = readers.facts_of(rows, lambda r: {"artifact": str(r["i"]), "content": r["c"]}, "artifact", "container", "refs", "header_error").collect()
    want = [readers._fact({"artifact": str(i), "content": c}) for i, c in enumerate(mixed)]
    assert sorted((int(r["artifact"]), r["container"], [x.asDict() for x in r["refs"] or []], r["header_error"]) for r in facts) == [(i, w.get("container"), w.get("refs", []), w.get("header_error")) for i, w in enumerate(want)]
    start = time.process_time()
    assert pickles.read([{"artifact": str(i), "content": short[i % 3]} for i in range(10_000)], target)[0].num_rows == 10_000
    assert time.process_time() - start < 0.4
