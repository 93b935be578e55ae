"""Queries that make containers of table rows, read them with the scanner's readers, and say the same in SQL.

Each row becomes a small file's bytes, in a binary column; what the readers
find in it, and what its values decode to, follows from the row.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope.functions import columns as C
from weightscope.functions import ed25519
from weightscope.operators import drift, signature, text
from weightscope.plans import scan
from weightscope.queries import _V, _r, _t, _values, query
from weightscope.sources import readers
from weightscope.sources.tables import join_hot, stored


def _spread(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out to all tasks by ``key``."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def _files(rows: DataFrame, make: Callable[[dict], bytes], key: str) -> DataFrame:
    """``artifact`` (the key as text) and ``content`` of a file for each row.

    Rows are dealt out while they are small; files then stay where they are made.
    """

    def work(row: dict) -> Iterator[dict]:
        yield {"artifact": str(row[key]), "content": make(row)}

    return readers._map_rows(_spread(rows, key), work, "artifact string, content binary")


def _tensors(files: DataFrame, kind: str = "safetensors") -> DataFrame:
    """The tensors of ``files``."""
    return scan.tensors_of(readers.facts(files), (kind,))


def _payloads(files: DataFrame, kind: str = "safetensors") -> DataFrame:
    """The tensors of ``files``, each with its own bytes as ``content``, in which it starts at 0."""
    t = scan.tensors_of(readers.facts(files, keep=True), (kind,))
    return readers.cut_content(t, F.col("start"), F.coalesce("avail_len", "byte_len")).withColumn("start", F.lit(0).cast("bigint"))


def _moments(tensors: DataFrame, *keys: str) -> DataFrame:
    """n, min, max and total of the decoded values of sound tensors."""
    t = tensors.where("decode is not null").withColumns({"path": F.col("artifact"), "elements": C.product(F.col("shape")).cast("bigint"), "byte_len": F.coalesce("avail_len", "byte_len")})
    m = readers.chunk_moments(t, list(keys))
    return m.select(*keys, "n", "min", "max", F.round(F.col("mean") * F.col("n"), 6).alias("total"))


def _safetensors(tensors: dict[str, tuple[str, list[int], bytes]], meta: dict[str, str] | None = None, width: int = 512) -> bytes:
    """A safetensors file whose header is padded to ``width`` bytes."""
    header, body = {"__metadata__": meta} if meta else {}, b""
    for name, (dtype, shape, data) in tensors.items():
        header[name] = {"dtype": dtype, "shape": shape, "data_offsets": [len(body), len(body) + len(data)]}
        body += data
    return struct.pack("<Q", width) + json.dumps(header).encode().ljust(width) + body


# ------------------------------------------------------------ safetensors


def _embedding(row: dict) -> bytes:
    n = len(row["embedding"])
    wrong = row["vec_id"] % 5  # every fifth file has one fault of each kind in turn
    tensors = {"emb": ("F32", [n], struct.pack(f"<{n}f", *row["embedding"])), "lab": ("I64", [1], struct.pack("<q", row["label"]))}
    data = bytearray(_safetensors(tensors, {"label": str(row["label"])}))
    if wrong == 1:
        data = data.replace(b'"F32"', b'"X32"')
    if wrong == 2:
        data = data[: 8 + 512 + 4 * n]
    return bytes(data)


_EMB = "e AS (SELECT vec_id::VARCHAR AS artifact, vec_id % 5 AS k, label, len(embedding) AS n, embedding FROM embeddings)"


@query(
    f"""WITH {_EMB}, t AS (SELECT artifact, k, 'emb' AS name, CASE WHEN k = 1 THEN 'X32' ELSE 'F32' END AS dtype, n::VARCHAR AS shape, 0 AS "begin", n * 4 AS "end", n FROM e UNION ALL SELECT artifact, k, 'lab', 'I64', '1', n * 4, n * 4 + 8, n FROM e)
SELECT artifact, name, dtype, shape, "begin"::BIGINT AS "begin", "end"::BIGINT AS "end", 520 + "begin"::BIGINT AS start, (n * 4 + CASE WHEN k = 2 THEN 0 ELSE 8 END)::BIGINT AS seg_len,
 CASE WHEN k = 2 AND name = 'lab' THEN 'out_of_bounds' WHEN k = 1 AND name = 'emb' THEN 'unknown_dtype' ELSE 'ok' END AS status FROM t"""
)
def safetensors_read(spark, d):
    """Headers and specs, sound and faulty."""
    t = _tensors(_files(_t(spark, d, "embeddings"), _embedding, "vec_id"))
    return t.select("artifact", "name", F.col("type_name").alias("dtype"), F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "begin", "end", "start", "seg_len", "status")


@query(f"WITH {_EMB} SELECT artifact, 'metadata.label' AS key, label::VARCHAR AS text FROM e")
def safetensors_metadata(spark, d):
    """Metadata of text only."""
    f = readers.facts(_files(_t(spark, d, "embeddings"), _embedding, "vec_id"))
    return f.select("artifact", F.explode("kv").alias("v")).select("artifact", "v.key", "v.text")


@query(
    f"""WITH {_EMB}, v AS (SELECT artifact, unnest(embedding)::DOUBLE AS x FROM e WHERE k <> 1)
SELECT artifact, 'emb' AS name, count(*) AS n, min(x) AS "min", max(x) AS "max", round(sum(x), 6) + 0 AS total FROM v GROUP BY artifact
UNION ALL SELECT artifact, 'lab', 1, label, label, label FROM e WHERE k <> 2"""
)
def safetensors_values(spark, d):
    """Values of sound tensors, those of no known type deferred."""
    t = _payloads(_files(_t(spark, d, "embeddings"), _embedding, "vec_id")).where("status <> 'out_of_bounds'")
    return _r(_moments(t, "artifact", "name"), "total")


def _dtypes(row: dict) -> bytes:
    """Two values, a whole one and a quarter, in every type that holds them."""
    a, q = int(row["p_size"]), (row["p_partkey"] % 9 - 4) / 4
    pack = lambda f, *x: struct.pack(f"<{len(x)}{f}", *x)
    bf = b"".join(struct.pack("<f", x)[2:] for x in (a, q))
    whole = {"I64": "q", "I32": "i", "I16": "h", "I8": "b"}
    tensors = {"F64": pack("d", a, q), "F32": pack("f", a, q), "F16": pack("e", a, q), "BF16": bf, **{k: pack(f, a, -a) for k, f in whole.items()}, "U8": pack("B", a, 255), "BOOL": bytes([a % 2, 7])}
    return _safetensors({k: (k, [2], v) for k, v in tensors.items()}, width=1000)


@query(
    """WITH p AS (SELECT p_partkey::VARCHAR AS artifact, p_size::DOUBLE AS a, (p_partkey % 9 - 4) / 4 AS q FROM part),
v AS (SELECT artifact, unnest(['F64', 'F32', 'F16', 'BF16']) AS name, a AS x, q AS y FROM p UNION ALL SELECT artifact, unnest(['I64', 'I32', 'I16', 'I8']), a, -a FROM p
 UNION ALL SELECT artifact, 'U8', a, 255 FROM p UNION ALL SELECT artifact, 'BOOL', a % 2, 1 FROM p)
SELECT artifact, name, 2::BIGINT AS n, least(x, y)::DOUBLE AS "min", greatest(x, y)::DOUBLE AS "max", round(x + y, 6) + 0 AS total FROM v"""
)
def dtype_decode(spark, d):
    """The ten element types to doubles."""
    return _r(_moments(_payloads(_files(_t(spark, d, "part").select("p_partkey", "p_size"), _dtypes, "p_partkey")), "artifact", "name"), "total")


@query(
    """WITH o AS (SELECT doc_id::VARCHAR AS artifact, text FROM documents), b AS (SELECT artifact, unnest(regexp_extract_all(hex(encode(text)), '..')) AS c FROM o), n AS (SELECT artifact, c, count(*) AS k FROM b GROUP BY ALL),
s AS (SELECT artifact, sum(k) AS total FROM n GROUP BY artifact)
SELECT artifact, round(-sum(k / total * log2(k / total)), 6) + 0 AS entropy FROM n JOIN s USING (artifact) GROUP BY artifact UNION ALL SELECT artifact, 0 FROM o WHERE coalesce(text, '') = ''"""
)
def tensor_entropy(spark, d):
    """Bits a byte of whole texts as tensors of bytes."""
    f = _files(_t(spark, d, "documents").select("doc_id", "text"), lambda r: _safetensors({"t": ("U8", [len((r["text"] or "").encode())], (r["text"] or "").encode())}), "doc_id")
    t = _payloads(f).withColumn("path", F.col("artifact"))
    return _r(readers.byte_entropies(t, ["artifact"]), "entropy")


# ------------------------------------------------------------------- GGUF


def _string(x: str) -> bytes:
    return struct.pack("<Q", len(x.encode())) + x.encode()


#: Name, type number and how many different numbers the quants of the query take.
_BLOCKS = (("Q4_0", 2, 16), ("Q4_1", 3, 16), ("Q5_0", 6, 32), ("Q5_1", 7, 32), ("Q8_0", 8, 200))


def _block(name: str, quants: list[int], scale: float, offset: float) -> bytes:
    """32 numbers packed by a legacy block format."""
    out = struct.pack("<e", scale)
    if name == "Q8_0":
        return out + bytes((q - 100) & 255 for q in quants)
    if name.endswith("_1"):
        out += struct.pack("<e", offset)
    if name.startswith("Q5"):
        out += struct.pack("<I", sum((q >> 4) << i for i, q in enumerate(quants)))
    return out + bytes((quants[i] & 15) | (quants[i + 16] & 15) << 4 for i in range(16))


def _gguf(row: dict) -> bytes:
    k = int(row["s_suppkey"])
    blocks = [(name, type_id, _block(name, [(k * 7 + i * 3) % m for i in range(32)], 0.5, (k % 5) / 2)) for name, type_id, m in _BLOCKS]
    kv = [("general.architecture", 8, _string("llama")), ("general.name", 8, _string(row["s_name"])), ("general.alignment", 4, struct.pack("<I", 64)), ("tokens", 9, struct.pack("<IQ", 8, 2) + _string("a") + _string("bc")), ("llama.block_count", 4, struct.pack("<I", k))]
    out = b"GGUF" + struct.pack("<IQQ", 3, len(blocks) + 1, len(kv)) + b"".join(_string(n) + struct.pack("<I", t) + v for n, t, v in kv)
    for i, (name, type_id, _) in enumerate(blocks):
        out += _string(f"blk.{i}.{name}") + struct.pack("<IQIQ", 1, 32, type_id, 64 * i)
    out += _string("blk.9.late") + struct.pack("<IQIQ", 1, 256, 12, 64 * len(blocks) if k % 10 else 1 << 40)
    out += b"\0" * (-len(out) % 64)
    return out + b"".join(data.ljust(64, b"\0") for _, _, data in blocks) + bytes(144)


_SUP = """s AS (SELECT s_suppkey::VARCHAR AS artifact, s_suppkey AS k, s_name FROM supplier),
b(i, name, type_id, m, size) AS (VALUES (0, 'Q4_0', 2, 16, 18), (1, 'Q4_1', 3, 16, 20), (2, 'Q5_0', 6, 32, 22), (3, 'Q5_1', 7, 32, 24), (4, 'Q8_0', 8, 200, 34))"""


@query(
    f"""WITH {_SUP} SELECT artifact, 'blk.' || i || '.' || name AS name, name AS type_name, '32' AS shape, (64 * i)::BIGINT AS "begin", size::BIGINT AS byte_len, 'ok' AS status FROM s, b
UNION ALL SELECT artifact, 'blk.9.late', 'Q4_K', '256', CASE WHEN k % 10 > 0 THEN 320 ELSE 1099511627776 END, 144, CASE WHEN k % 10 > 0 THEN 'ok' ELSE 'out_of_bounds' END FROM s"""
)
def gguf_read(spark, d):
    """A8, A9, B3, B5, B6, C5, C6, D-9: tensors of GGUF files."""
    t = _tensors(_files(_t(spark, d, "supplier").select("s_suppkey", "s_name"), _gguf, "s_suppkey"), "gguf")
    return t.select("artifact", "name", "type_name", F.array_join(F.col("shape").cast("array<string>"), "x").alias("shape"), "begin", "byte_len", "status")


@query(f"WITH {_SUP} SELECT artifact, unnest(['general.architecture', 'general.name', 'general.alignment', 'tokens', 'llama.block_count']) AS key, unnest(['llama', s_name, NULL, NULL, NULL]) AS text, unnest([NULL, NULL, 64, NULL, k]) AS number FROM s")
def gguf_metadata(spark, d):
    """Metadata values; arrays are passed over."""
    f = readers.facts(_files(_t(spark, d, "supplier").select("s_suppkey", "s_name"), _gguf, "s_suppkey"))
    return f.select("artifact", F.explode("kv").alias("v")).select("artifact", "v.key", "v.text", "v.number")


@query(
    f"""WITH {_SUP}, q AS (SELECT artifact, i, name, k, (k * 7 + j * 3) % m AS q FROM s, b, range(32) r(j)),
v AS (SELECT artifact, 'blk.' || i || '.' || name AS name, CASE name WHEN 'Q4_0' THEN (q - 8) * 0.5 WHEN 'Q5_0' THEN (q - 16) * 0.5 WHEN 'Q8_0' THEN (q - 100) * 0.5 ELSE q * 0.5 + (k % 5) / 2 END::DOUBLE AS x FROM q)
SELECT artifact, name, count(*) AS n, min(x) AS "min", max(x) AS "max", round(sum(x), 6) + 0 AS total FROM v GROUP BY artifact, name"""
)
def block_decode(spark, d):
    """Values of the legacy block types."""
    return _r(_moments(_payloads(_files(_t(spark, d, "supplier").select("s_suppkey", "s_name"), _gguf, "s_suppkey"), "gguf"), "artifact", "name"), "total")


@query(f"WITH {_SUP} SELECT artifact, 'Q4_K' AS types, 5::BIGINT AS decoded FROM s WHERE k % 10 > 0 UNION ALL SELECT artifact, '', 5 FROM s WHERE k % 10 = 0")
def deferred_types(spark, d):
    """Which sound tensors have statistics, and the types of those that have none."""
    st = scan.tensor_statistics(stored(_payloads(_files(_t(spark, d, "supplier").select("s_suppkey", "s_name"), _gguf, "s_suppkey"), "gguf"), "tensors"))
    late = F.array_sort(F.collect_set(F.when(F.col("quality") != "full", F.col("type_name"))))
    return st.groupBy("artifact").agg(F.array_join(late, ", ").alias("types"), F.count_if((F.col("quality") == "full") & (F.col("n") == 32)).alias("decoded"))


# ---------------------------------------------------------------- pickles

_ELF = b"\x7fELF" + b"p" * 20


def _zip_of_one(name: str, body: bytes) -> bytes:
    """A zip with one short deflated member, as ``zipfile`` writes it but for the time, which is 1980."""
    deflate = zlib.compressobj(-1, zlib.DEFLATED, -9, 1)  # no more memory than short bodies need
    packed = deflate.compress(body) + deflate.flush()
    path = name.encode()
    known = struct.pack("<4H3L2H", 0, 8, 0, 33, zlib.crc32(body), len(packed), len(body), len(path), 0)
    local = struct.pack("<4sH", b"PK\3\4", 20) + known + path
    central = struct.pack("<4s2BH", b"PK\1\2", 20, 3, 20) + known + struct.pack("<3H2L", 0, 0, 0, 0o600 << 16, 0) + path
    return local + packed + central + struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, 1, 1, len(central), len(local) + len(packed), 0)


def _pickle(row: dict) -> bytes:
    k = row["o_orderkey"] % 8
    if k == 0:
        return b"\x80\x02]q\x00."
    if k == 6:
        return b"PK\x03\x04" + b"junk" * 9
    name = f"C{row['o_custkey']}".encode()
    old = b"\x80\x02cos\n%b\n" % name
    if k == 1:
        return old + b"U\x02id\x85R."
    if k == 5:
        return old + b"U\x02id\x85R"
    new = b"\x80\x04\x8c\x07pathlib\x8c%c%b\x93." % (len(name), name)
    if k == 2:
        return new
    if k == 3:
        return old + b"." + new
    if k == 4:
        return new + _ELF
    return _zip_of_one("a/data.pkl" if row["o_custkey"] % 2 else "a/data.txt", new)


_ORD = """o AS (SELECT o_orderkey::VARCHAR AS artifact, o_orderkey % 8 AS k, 'C' || o_custkey AS c, o_custkey % 2 AS odd FROM orders)"""


def _pickles(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """The facts ``names`` of a pickle for each order."""
    rows = _spread(_t(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    return readers.facts_of(rows, lambda row: {"artifact": str(row["o_orderkey"]), "content": _pickle(row)}, *names)


@query(
    f"""WITH {_ORD} SELECT artifact, CASE WHEN k = 4 THEN 'tail' WHEN k = 5 THEN 'truncated' WHEN k = 6 THEN 'unreadable' WHEN k = 7 AND odd = 1 THEN 'zip' WHEN k = 7 THEN 'no_pickle' ELSE 'plain' END AS container,
 CASE WHEN k = 3 THEN 2 WHEN k = 6 OR (k = 7 AND odd = 0) THEN 0 ELSE 1 END::INT AS n_streams,
 CASE WHEN k IN (1, 5) THEN 'GLOBAL os.' || c WHEN k IN (2, 4) OR (k = 7 AND odd = 1) THEN 'STACK_GLOBAL pathlib.' || c WHEN k = 3 THEN 'GLOBAL os.' || c || ',STACK_GLOBAL pathlib.' || c ELSE '' END AS refs,
 CASE WHEN k IN (1, 5) THEN 'REDUCE' ELSE '' END AS ops, CASE WHEN k = 4 THEN 24 WHEN k = 5 OR k = 6 OR k = 7 THEN NULL ELSE 0 END::BIGINT AS tail_len, CASE WHEN k = 4 THEN 'an ELF executable' END AS tail_magic FROM o"""
)
def pickle_streams(spark, d):
    """Opcodes, references and containers of pickles."""
    f = _pickles(spark, d, "artifact", "container", "streams", "refs", "tail_len", "tail_magic")
    listed = F.array_join(F.transform("refs", lambda r: F.concat(r["opcode"], F.lit(" "), r["module"], F.lit("."), r["name"])), ",")
    ops = F.array_join(F.flatten(F.transform("streams", lambda x: x["exec_ops"])), ",")
    whole = F.when(~F.col("container").isin("truncated", "zip", "no_pickle", "unreadable"), F.col("tail_len"))
    return f.select("artifact", "container", F.size("streams").alias("n_streams"), listed.alias("refs"), ops.alias("ops"), whole.alias("tail_len"), "tail_magic")


@query(
    f"""WITH {_ORD}, r AS (SELECT artifact, k, CASE WHEN k IN (1, 3, 5) THEN 'PICKLE_RCE_RISK' WHEN k IN (2, 4) OR (k = 7 AND odd = 1) THEN 'PICKLE_GLOBAL_REF' ELSE 'PICKLE_UNTRUSTED' END AS id FROM o)
SELECT artifact, id, CASE WHEN id = 'PICKLE_RCE_RISK' THEN 'high' ELSE 'medium' END AS severity FROM r
UNION ALL SELECT artifact, 'PICKLE_TRAILING_DATA', 'high' FROM o WHERE k = 4 UNION ALL SELECT artifact, 'PICKLE_TRUNCATED', 'medium' FROM o WHERE k = 5
UNION ALL SELECT artifact, 'PICKLE_CONTAINER_UNREADABLE', 'medium' FROM o WHERE k = 6 UNION ALL SELECT artifact, 'PICKLE_CONTAINER_NO_PICKLE', 'medium' FROM o WHERE k = 7 AND odd = 0"""
)
def pickle_container(spark, d):
    """Findings on pickles and on what stands beside them."""
    f = _pickles(spark, d, "artifact", "format", "size", "io_error", "container", "detail", "tail_at", "tail_len", "tail_magic", "tail_preview", "streams", "refs")
    return scan.pickle_findings(stored(f, "facts")).select("artifact", "id", "severity")


# ---------------------------------------------------- digests and regions


def _alike(made: DataFrame, key: str) -> DataFrame:
    """Each artifact of a stored table and how many have its ``key``, which may be very many."""
    return join_hot(made, made.groupBy(key).agg(F.count(F.lit(1)).alias("alike")), key, "alike").select("artifact", "alike")


@query("SELECT doc_id::VARCHAR AS artifact, count(*) OVER (PARTITION BY coalesce(text, '')) AS alike FROM documents")
def file_digests(spark, d):
    """BLAKE3 of whole texts; equal ones, and no others, have one digest."""
    f = _files(_t(spark, d, "documents").select("doc_id", "text"), lambda r: (r["text"] or "").encode(), "doc_id")
    ranges = f.select("artifact", F.col("artifact").alias("path"), F.lit(0).cast("bigint").alias("begin"), F.octet_length("content").cast("bigint").alias("len"), "content")
    made = stored(readers.range_digests(ranges, ["artifact"]), "digests")
    return _alike(made, "digest")


@query("SELECT vec_id::VARCHAR AS artifact, count(*) OVER (PARTITION BY embedding, label) AS alike FROM embeddings")
def manifest_hashes(spark, d):
    """Hashes of models by names, types, shapes and contents of their tensors."""
    make = lambda r: _safetensors({"emb": ("F32", [len(r["embedding"])], struct.pack(f"<{len(r['embedding'])}f", *r["embedding"])), "lab": ("I64", [1], struct.pack("<q", r["label"]))}, {"id": str(r["vec_id"])})
    t = stored(_payloads(_files(_t(spark, d, "embeddings"), make, "vec_id")), "tensors")
    ranges = t.select("artifact", "name", F.col("artifact").alias("path"), F.col("start").alias("begin"), F.col("byte_len").alias("len"), "content")
    made = stored(scan.manifests(t, readers.range_digests(ranges, ["artifact", "name"])), "manifests")
    return _alike(made, "manifest")


@query(
    r"""WITH c AS (SELECT c_custkey::VARCHAR AS artifact, c_custkey % 4 AS k, c_name FROM customer)
SELECT artifact, k = 0 AS all_zero, CASE WHEN k = 1 THEN 'an ELF executable' WHEN k = 2 THEN 'a ZIP archive' END AS magic,
 CASE k WHEN 0 THEN repeat('\x00', 20) WHEN 1 THEN '\x7fELF' || repeat('p', 20) WHEN 2 THEN 'PK\x03\x04' || left(c_name, 28) || CASE WHEN length(c_name) > 28 THEN '…' ELSE '' END ELSE left(c_name, 32) || CASE WHEN length(c_name) > 32 THEN '…' ELSE '' END END AS preview FROM c"""
)
def region_bytes(spark, d):
    """What stands in regions that nothing claims."""
    make = lambda r: b"head" + [bytes(20), _ELF, b"PK\x03\x04" + r["c_name"].encode(), r["c_name"].encode()][r["c_custkey"] % 4]
    f = _files(_t(spark, d, "customer").select("c_custkey", "c_name"), make, "c_custkey").withColumns({"path": F.col("artifact"), "start": F.lit(4).cast("bigint"), "len": F.octet_length("content").cast("bigint") - 4})
    return readers.look_at(f, ["artifact"]).select("artifact", "all_zero", "magic", "preview")


# ---------------------------------------------------------- texts and rest


@query(
    """SELECT doc_id, 'EMBEDDED_SECRET' AS id, 'high' AS severity, unnest(CASE doc_id % 4 WHEN 0 THEN ['private key block in d'] WHEN 1 THEN ['service account credentials in d'] WHEN 2 THEN ['private key block in d', 'service account credentials in d'] ELSE [] END) AS detail FROM documents"""
)
def secret_shapes(spark, d):
    """Key blocks and account files in whole texts."""
    k = F.col("doc_id") % 4
    pem, account = "\n-----BEGIN RSA PRIVATE KEY-----\nAA\n", '\n{"type": "service_account", "private_key": "x"}\n'
    body = F.concat(F.coalesce("text", F.lit("")), F.when(k == 0, pem).when(k == 1, account).when(k == 2, pem + account).otherwise("\n-----BEGIN CERTIFICATE-----\n"))
    found = text.secrets(_t(spark, d, "documents").select("doc_id", F.lit("d").alias("source"), body.alias("text")), ["doc_id"])
    return found.where("detail like 'private key%' or detail like 'service%'").select("doc_id", "id", "severity", "detail")


@query("SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN 'signed' WHEN 1 THEN 'signed' WHEN 4 THEN 'no signature' ELSE 'mismatch' END AS status FROM nation")
def detached_signature(spark, d):
    """Ed25519 signatures, raw or in hex, right, of another text, by another key, or cut short."""

    def work(row: dict) -> Iterator[dict]:
        k, message = row["n_nationkey"] % 5, row["n_name"].encode()
        key, made = ed25519.sign(bytes([row["n_nationkey"]]) * 32, message)
        given = [made, made.hex().encode() + b"\n", made, made, made[:40]][k]
        if k == 2:
            message += b"!"
        if k == 3:
            key = ed25519.sign(b"k" * 32, b"")[0]
        raw, known = signature._fixed(given, 64), signature._fixed(key.hex().encode(), 32)
        yield {"id": row["n_nationkey"], "status": "no signature" if raw is None else "signed" if ed25519.verify(known, message, raw) else "mismatch"}

    return readers._map_rows(_t(spark, d, "nation"), work, "id long, status string")


@query(f"WITH {_V}, s AS (SELECT DISTINCT name, vec_id FROM v) SELECT name, CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_known, vec_id % 3 = 0 AS no_values, CASE WHEN vec_id % 3 = 0 THEN 0 END::DOUBLE AS sparsity FROM s")
def all_non_finite(spark, d):
    """Tensors without a finite value have no statistics, and no share of zeros."""
    from weightscope.operators import stats

    v = _values(spark, d).withColumn("value", F.when(F.col("vec_id") % 3 == 0, F.when(F.col("pos") % 2 == 0, float("nan")).otherwise(float("-inf"))).otherwise(F.col("value")))
    st = stats.tensor_stats(v, ["name"])
    none = F.col("mean").isNull() & F.col("std").isNull() & F.col("min").isNull() & F.col("kurtosis").isNull() & (F.col("n") == 0)
    return st.select("name", F.least(F.col("n"), F.lit(1)).cast("bigint").alias("n_known"), none.alias("no_values"), F.when(F.col("n") == 0, F.col("sparsity")).alias("sparsity"))


@query(
    f"WITH {_V}, p AS (SELECT name, vec_id, value AS b, CASE WHEN vec_id % 4 = 0 AND pos = 3 THEN 'NaN'::DOUBLE ELSE value * 2 END AS s FROM v), a AS (SELECT name, any_value(vec_id) AS k, sum(b * b) AS bb, sum(s * b) AS dot, sum(s * s) AS ss, sum((s - b) * (s - b)) AS d2, avg(CASE WHEN abs(s - b) > 1e-6 AND NOT isnan(s) THEN 1.0 ELSE 0.0 END) AS changed_frac FROM p GROUP BY name)"
    " SELECT name, round(CASE WHEN k % 4 = 0 THEN 1 ELSE dot / sqrt(ss) / sqrt(bb) END, 6) + 0 AS cosine, k % 4 = 0 AS no_distance, round(CASE WHEN k % 4 > 0 THEN sqrt(d2) / sqrt(bb) END, 6) + 0 AS rel_l2, round(changed_frac, 6) + 0 AS changed_frac FROM a"
)
def drift_of_nan(spark, d):
    """A NaN in a tensor makes its distance NaN and its norm count as none; its own place counts as unchanged."""
    v = _values(spark, d)
    s = F.when((F.col("vec_id") % 4 == 0) & (F.col("pos") == 3), float("nan")).otherwise(F.col("value") * 2)
    t = drift.tensor_drift(drift.pair_sums(v.select("name", s.alias("s"), F.col("value").alias("b")), ["name"]))
    distance = F.when(~F.isnan("rel_l2"), F.col("rel_l2"))
    return _r(t.select("name", "cosine", F.isnan("rel_l2").alias("no_distance"), distance.alias("rel_l2"), "changed_frac"), "cosine", "rel_l2", "changed_frac")


def _place(k: int) -> str:
    return ["model.safetensors", "sub/x.tar.gz", ".hidden", "noext", "sub.d/Model.GGUF"][k]


@query(
    """WITH o AS (SELECT o_orderkey AS id, '/m/' || o_custkey || '/' || (['model.safetensors', 'sub/x.tar.gz', '.hidden', 'noext', 'sub.d/Model.GGUF'])[1 + o_orderkey % 5] AS path, o_custkey AS c, o_orderkey % 5 AS k FROM orders)
SELECT id, (['safetensors', 'gz', '', '', 'gguf'])[1 + k] AS ext, '/m/' || c || (['', '/sub', '', '', '/sub.d'])[1 + k] AS parent FROM o"""
)
def path_parts(spark, d):
    """Extension and folder of a path."""
    names = F.array(*[F.lit(_place(k)) for k in range(5)])
    path = F.concat(F.lit("/m/"), F.col("o_custkey").cast("string"), F.lit("/"), F.element_at(names, (1 + F.col("o_orderkey") % 5).cast("int")))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"))
    return o.select("id", C.extension(F.col("path")).alias("ext"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("parent"))
