"""Scanning: from a path to findings, verdicts and reports."""

from __future__ import annotations

import os
import struct
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import blake3
from weightscope.functions import columns as C
from weightscope.operators import accounting, rollup, signature, stats, text
from weightscope.sources import readers, walk
from weightscope.sources.tables import all_stored, stored, together

FINDINGS = "artifact string, phase int, ord bigint, id string, severity string, detail string, evidence array<string>"
MANIFEST_TAG = b"weightscope-manifest-v1\n"

# Phases, which order an artifact's findings.
PARSE, ALTERNATIVE, SIGNATURE, VALUES, LAYERS, SECRETS, IDENTITY, ALIASES = range(1, 9)


def _f(df: DataFrame, phase: int, order, id_, severity, detail: Column, *evidence: Column) -> DataFrame:
    """Rows of ``findings``; null evidence is left out."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    ev = F.filter(F.array(*evidence), lambda x: x.isNotNull()) if evidence else F.array().cast("array<string>")
    return df.select("artifact", F.lit(phase).alias("phase"), col(order).cast("bigint").alias("ord"), col(id_).alias("id"), col(severity).alias("severity"), detail.alias("detail"), ev.cast("array<string>").alias("evidence"))


def _s(template: str, *names: str) -> Column:
    """A text with columns in place of {}."""
    return F.format_string(template.replace("%", "%%").replace("{}", "%s"), *[F.col(n).cast("string") for n in names])


@dataclass
class Scan:
    """The tables of a scan."""

    spark: SparkSession
    path: str
    artifacts: DataFrame
    facts: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    findings: DataFrame | None = None
    deep: bool = False

    def register(self, prefix: str = "") -> None:
        """Make the tables temporary views, for Spark SQL."""
        for name, df in {"artifacts": self.artifacts, "facts": self.facts, "findings": self.findings, **self.tables}.items():
            df.createOrReplaceTempView(prefix + name)


def tensors_of(facts: DataFrame, formats: tuple[str, ...] = ("safetensors", "gguf")) -> DataFrame:
    """One row a tensor: its spec, where its bytes start, how they are decoded and whether all is in order.

    ``facts`` is read once for each of ``formats``. Where facts have their
    files' ``content``, tensors have it too.
    """
    names = ["artifact", "format", "ord", "name", "type_name", "decode", "shape", "begin", "end", "byte_len", "start", "status", "problem", "expected", "seg_len", "data_start", "info_end", "alignment", "avail_len", *readers._content(facts)]
    of_file = ["artifact", "format", "data_start", "seg_len", "alignment", "info_end", *readers._content(facts)]
    sound = facts.where("header_error is null and seg_len is not null")
    parts = []
    if "safetensors" in formats:
        t = sound.where("format = 'safetensors'").select(*of_file, F.explode("tensors").alias("t")).select(*of_file, "t.*")
        decode = F.when(F.col("dtype").isin(*K.DECODABLE), F.col("dtype"))
        st = accounting.check_specs(t)
        st = st.withColumn("status", F.when(F.col("problem").isNotNull(), "malformed").otherwise(F.col("status"))).withColumns({"type_name": F.col("dtype"), "decode": decode, "byte_len": F.col("end") - F.col("begin"), "start": F.col("data_start") + F.col("begin")})
        parts.append(st.withColumn("avail_len", F.col("byte_len")).select(*names))
    if "gguf" in formats:
        # Tensors in the order of their offsets, each beside the next one's.
        placed = F.array_sort(F.transform("tensors", lambda t: F.struct(t["begin"].alias("offset"), t["ord"].alias("no"), t.alias("t"))))
        ahead = F.transform(F.slice(placed, F.lit(2), F.greatest(F.size("tensors"), F.lit(1))), lambda x: x["offset"])
        t = sound.where("format = 'gguf'").select(*of_file, F.explode(F.arrays_zip(placed.alias("placed"), ahead.alias("next"))).alias("x")).select(*of_file, "x.placed.t.*", F.col("x.next").alias("next"))
        gg = accounting.byte_lengths(t.withColumn("dims", F.col("shape"))).withColumn("avail_len", F.greatest(F.coalesce("next", "seg_len") - F.col("begin"), F.lit(0).cast("bigint")))
        gg = gg.withColumns({"status": F.when(F.col("begin") > F.col("seg_len"), "out_of_bounds").otherwise("ok"), "expected": F.lit(None).cast("decimal(38,0)"), "start": F.col("data_start") + F.col("begin")})
        parts.append(gg.select(*names))
    return reduce(DataFrame.unionByName, parts)


def safetensors_findings(facts: DataFrame, tensors: DataFrame) -> DataFrame:
    """Structure of safetensors files: headers, specs, overlaps and unclaimed bytes."""
    t = tensors.where("format = 'safetensors'")
    sizes = facts.where("format = 'safetensors' and header_error is null and io_error is null").select("artifact", "seg_len", "data_start")
    bad = facts.where("format = 'safetensors' and header_error is not null")
    order = F.col("ord")
    at = lambda s: t.where(f"status = '{s}'")
    good = t.where("status in ('ok', 'size_mismatch', 'unknown_dtype')")
    regions = accounting.unclaimed(good.select("artifact", "name", "begin", "end"), sizes).join(sizes.select("artifact", "data_start"), "artifact").withColumns({"path": F.col("artifact"), "start": F.col("data_start") + F.col("begin")})
    judged = accounting.judge_regions(readers.look_at(regions, ["artifact", "idx"])).withColumn("stop", F.col("start") + F.col("len"))
    listed, more = accounting.cap_regions(judged)
    what = F.when(F.col("all_zero"), "all zero, as padding would be").when(F.col("magic").isNotNull(), F.concat(F.lit("they begin "), "magic")).otherwise("they are no padding")
    quiet = F.when(~F.col("all_zero"), F.lit(True))
    parts = [
        _f(bad, PARSE, 0, "ST_HEADER_MALFORMED", "high", F.col("header_error")),
        _f(at("malformed"), PARSE, order, "ST_HEADER_MALFORMED", "medium", _s("tensor '{}': {}", "name", "problem")),
        _f(at("reversed"), PARSE, order, "ST_OFFSET_OOB", "high", _s("tensor '{}' begins at {}, after its end {}", "name", "begin", "end")),
        _f(at("out_of_bounds"), PARSE, order, "ST_OFFSET_OOB", "high", _s("tensor '{}' ends at {}, beyond the data segment of {} bytes", "name", "end", "seg_len"), _s("data_offsets [{}, {}]", "begin", "end")),
        _f(at("size_mismatch"), PARSE, order, "ST_DTYPE_SHAPE_MISMATCH", "medium", _s("tensor '{}' of type {} needs {} bytes by its shape but has {}", "name", "type_name", "expected", "byte_len")),
        _f(at("unknown_dtype"), PARSE, order, "ST_DTYPE_UNKNOWN", "low", _s("tensor '{}' is of unknown type '{}'", "name", "type_name")),
        _f(accounting.overlaps(good), PARSE, F.lit(10**6) + F.col("begin_b"), "ST_OFFSET_OVERLAP", "high", _s("tensors '{}' and '{}' share bytes", "name_a", "name_b"), _s("'{}' ends at {}, '{}' begins at {}", "name_a", "end_a", "name_b", "begin_b")),
        _f(
            listed, PARSE, F.lit(10**15) + F.col("idx"), "ST_UNREFERENCED_BYTES", F.col("severity"),
            F.concat(_s("{} byte(s) {} belong to no tensor (file offset {}): ", "len", "placement", "start"), what),
            F.when(quiet, _s("file offsets {}..{}", "start", "stop")), F.when(quiet, _s("first bytes: {}", "preview")),
        ),
        _f(more, PARSE, 10**16, "ST_UNREFERENCED_BYTES", "high", _s("{} regions with {} bytes belong to no tensor; the first are listed", "hidden", "hidden_bytes")),
    ]
    return reduce(DataFrame.union, parts)


def gguf_findings(facts: DataFrame, tensors: DataFrame) -> DataFrame:
    """Structure of GGUF files: headers, offsets, sizes, unclaimed bytes and chat templates."""
    g = facts.where("format = 'gguf'")
    t = tensors.where("format = 'gguf'")
    kv = g.select("artifact", F.posexplode("kv").alias("k", "v")).where(F.col("v.key").contains("chat_template")).select("artifact", "k", F.col("v.key").alias("key"), F.col("v.text").alias("text"))
    shown = C.truncate(F.coalesce("text", F.lit("")), 160)
    found = text.template_findings(text.regions(kv.where("text is not null"), ["artifact", "k"]), ["artifact", "k"])
    oob = t.where("status = 'out_of_bounds'")
    sound = t.join(oob.select("artifact").distinct(), "artifact", "left_anti")
    unsized = sound.groupBy("artifact").agg(F.count_if(F.col("byte_len").isNull()).alias("n"), F.count(F.lit(1)).alias("total"), F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("byte_len").isNull(), F.struct("type_name")))), lambda x: x["type_name"]), ", ").alias("types")).where("n > 0")
    sized = sound.join(unsized.select("artifact"), "artifact", "left_anti").withColumn("offset", F.col("begin"))
    sizes = sized.select("artifact", "seg_len", "data_start", "info_end", "alignment").distinct()
    clash = accounting.contradictions(sized.select("artifact", "name", "offset", "byte_len", "ord"), sizes.select("artifact", "seg_len"))
    clashes = clash.withColumn("what", F.concat(_s("'{}' ({} bytes at {}) runs ", "name", "byte_len", "offset"), F.when(F.col("next_name").isNull(), "past the end of the file").otherwise(_s("into '{}' at {}", "next_name", "next_offset"))))
    clashes = clashes.groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("offset", "what"))), lambda x: x["what"]), 1, K.MAX_CONTRADICTIONS).alias("shown"))
    walked = sized.join(clashes.select("artifact"), "artifact", "left_anti")
    ok = walked.select("artifact").distinct()
    iv = walked.select("artifact", "name", F.col("offset").alias("begin"), (F.col("offset") + F.col("byte_len")).alias("end"))
    inner = accounting.unclaimed(iv, sizes.join(ok, "artifact").select("artifact", "seg_len")).join(sizes, "artifact").select("artifact", "len", F.col("placement"), (F.col("data_start") + F.col("begin")).alias("start"), "alignment", (F.col("idx") + 1).alias("idx"))
    every = sound.select("artifact", "data_start", "info_end", "alignment").distinct()
    head = every.where("data_start > info_end").select("artifact", (F.col("data_start") - F.col("info_end")).alias("len"), F.lit("between the header and the tensor data").alias("placement"), F.col("info_end").alias("start"), "alignment", F.lit(0).alias("idx"))
    regions = accounting.judge_gguf_regions(readers.look_at(inner.union(head).withColumn("path", F.col("artifact")), ["artifact", "idx"]))
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("artifact", F.col("idx") > 0).orderBy("idx"))
    regions = regions.withColumns({"n": F.when(F.col("idx") == 0, 0).otherwise(n), "stop": F.col("start") + F.col("len")})
    rest = regions.where(F.col("n") > K.MAX_REGIONS).groupBy("artifact").agg(F.count(F.lit(1)).alias("more"))
    what = F.when(F.col("magic").isNotNull(), F.concat(F.lit("they begin "), "magic")).when(F.col("all_zero"), "all zero, but more than the alignment needs").otherwise("they are no padding")
    parts = [
        _f(g.where("header_error is not null"), PARSE, 10**15, "GGUF_PARSE_ERROR", "high", F.col("header_error")),
        _f(g.where("bad_version is not null"), PARSE, 0, "GGUF_BAD_VERSION", "high", _s("GGUF version {} is not supported", "bad_version")),
        _f(kv, PARSE, F.col("k") * 100, "GGUF_CHAT_TEMPLATE", "low", F.lit("a chat template is embedded; it is code that every conversation runs"), F.concat("key", F.lit(": "), shown)),
        _f(found, PARSE, F.col("k") * 100 + 1 + F.col("ord"), F.col("id"), F.col("severity"), _s("the embedded chat template, line {}: {}", "line", "what"), F.col("evidence")),
        _f(oob, PARSE, F.lit(10**9) + F.col("ord"), "GGUF_OFFSET_OOB", "high", _s("tensor '{}' starts at {}, beyond the data segment of {} bytes", "name", "begin", "seg_len"), _s("data_start={}, alignment={}", "data_start", "alignment")),
        _f(unsized, PARSE, 10**12, "GGUF_ACCOUNTING_INCOMPLETE", "info", _s("{} of {} tensors are of types whose size isn't known, so bytes between tensors are not accounted for", "n", "total"), F.concat(F.lit("types: "), "types")),
        clashes.select("artifact", F.lit(PARSE).alias("phase"), F.lit(10**12).cast("bigint").alias("ord"), F.lit("GGUF_ACCOUNTING_INCOMPLETE").alias("id"), F.lit("info").alias("severity"), _s("{} computed sizes contradict the declared offsets, so bytes are not accounted for", "n").alias("detail"), F.col("shown").alias("evidence")),
        _f(regions.where(F.col("n") <= K.MAX_REGIONS), PARSE, F.lit(10**11) + F.col("idx"), "GGUF_UNREFERENCED_BYTES", F.col("severity"), F.concat(_s("{} byte(s) {} (file offset {}) belong to no tensor: ", "len", "placement", "start"), what), _s("file offsets {}..{}", "start", "stop"), _s("first bytes: {}", "preview")),
        _f(rest, PARSE, 10**14, "GGUF_UNREFERENCED_BYTES", "high", _s("{} more regions that no tensor claims are not listed", "more")),
    ]
    return reduce(DataFrame.union, parts)


def pickle_findings(facts: DataFrame) -> DataFrame:
    """What pickles can do, and what stands in the file beside them. ``facts`` is read several times."""
    p = facts.where("format = 'pickle' and io_error is null")
    streams = p.select("artifact", "container", "size", F.explode("streams").alias("s")).select("artifact", "container", "size", "s.*")
    refs = p.select("artifact", F.explode("refs").alias("r")).select("artifact", "r.*")
    risk = rollup.pickle_risk(streams, refs)
    empty = p.where("size(streams) = 0").select("artifact", F.lit("PICKLE_UNTRUSTED").alias("id"), F.lit("medium").alias("severity"), F.array().cast("array<string>").alias("evidence"))
    detail = F.when(F.col("id") == "PICKLE_RCE_RISK", "loading this pickle can run code").when(F.col("id") == "PICKLE_GLOBAL_REF", "it names importable objects but runs none").otherwise("a pickle is never safe by itself, though no opcode here runs code")
    risks = risk.union(empty).select("artifact", F.lit(PARSE).alias("phase"), F.lit(10).cast("bigint").alias("ord"), "id", "severity", detail.alias("detail"), "evidence")
    cut = streams.where("truncated")
    tail = p.where("container in ('tail', 'legacy')").withColumn("stop", F.col("size"))
    named, plain = tail.where("tail_magic is not null"), tail.where("tail_magic is null")
    entry = F.when(F.col("entry") == "", "").otherwise(F.concat("entry", F.lit(": ")))
    parts = [
        risks,
        _f(p.where("container = 'no_pickle'"), PARSE, 0, "PICKLE_CONTAINER_NO_PICKLE", "medium", F.lit("the zip holds no pickle")),
        _f(p.where("container = 'unreadable'"), PARSE, 0, "PICKLE_CONTAINER_UNREADABLE", "medium", F.concat(F.lit("the zip can't be read: "), F.coalesce("detail", F.lit("")))),
        _f(cut.where("container = 'zip'"), PARSE, F.lit(20) + F.col("stream_no"), "PICKLE_TRUNCATED", "medium", F.concat(entry, _s("the opcodes break off at byte {}; what follows was not looked at", "end"))),
        _f(cut.where("container <> 'zip'"), PARSE, 20, "PICKLE_TRUNCATED", "medium", _s("the opcodes of stream {} break off at byte {} of {}; what follows was not looked at", "stream_no", "end", "size")),
        _f(named, PARSE, 20, "PICKLE_TRAILING_DATA", "high", _s("{} byte(s) after the last stream (file offset {}) begin {}", "tail_len", "tail_at", "tail_magic"), _s("file offsets {}..{}", "tail_at", "stop"), _s("first bytes: {}", "tail_preview")),
        _f(plain.where("container = 'legacy'"), PARSE, 20, "PICKLE_TORCH_LEGACY", "info", _s("a legacy torch file: its streams end at byte {}, the other {} bytes are tensor storage", "tail_at", "tail_len"), _s("storage at file offsets {}..{}", "tail_at", "stop")),
        _f(plain.where("container = 'tail'"), PARSE, 20, "PICKLE_TRAILING_DATA", "medium", _s("{} byte(s) after the last stream (file offset {}) were not looked at", "tail_len", "tail_at"), _s("first bytes: {}", "tail_preview")),
    ]
    return reduce(DataFrame.union, parts)


def manifests(tensors: DataFrame, digests: DataFrame, tag: bytes = MANIFEST_TAG) -> DataFrame:
    """artifact and manifest: the model's identity by its tensors' names, types, shapes and contents alone.

    The hash is of ``tag``, then for each tensor by name: name, type, shape and
    hex digest with their lengths before them. One row holds one artifact's
    list, an entry a tensor.
    """
    rows = tensors.select("artifact", "name", "type_name", "shape").join(digests, ["artifact", "name"])
    listed = rows.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("name", "type_name", "shape", "digest"))).alias("tensors"))

    def fold(listed: list[dict]) -> list[dict]:
        size = lambda b: struct.pack("<Q", len(b)) + b
        texts = []
        for row in listed:
            out = [tag]
            for r in row["tensors"]:
                out += [size(r["name"].encode()), size(r["type_name"].encode()), struct.pack(f"<{1 + len(r['shape'])}Q", len(r["shape"]), *r["shape"]), size(r["digest"].encode())]
            texts.append(b"".join(out))
        return [{"artifact": row["artifact"], "manifest": f"blake3:{digest}"} for row, digest in zip(listed, blake3.hexdigests(texts), strict=True)]

    return readers._map_runs(listed, fold, "artifact string, manifest string")


def signatures(artifacts: DataFrame, manifest: DataFrame, bundle: str | None, key: str | None) -> DataFrame:
    """artifact, status and finding columns of the signature check of every artifact."""

    def work(row: dict):
        status, found = signature.evaluate(row["artifact"], row["manifest"], bundle, key)
        yield {"artifact": row["artifact"], "status": status, **(found or {})}

    return readers._map_rows(artifacts.select("artifact").join(manifest, "artifact", "left"), work, "artifact string, status string, id string, severity string, detail string, evidence array<string>")


def tensor_statistics(tensors: DataFrame) -> DataFrame:
    """Statistics of every sound tensor; numbers are null where the type isn't decoded."""
    keys = ["artifact", "name"]
    t = tensors.where("status in ('ok', 'size_mismatch', 'unknown_dtype')").withColumns({"path": F.col("artifact"), "elements": F.least(C.product(F.col("shape")), F.lit(9.2e18)).cast("bigint"), "byte_len": F.coalesce("avail_len", "byte_len")})
    t = t.withColumn("element_count", F.col("elements"))
    cols = [*keys, "path", "start", "byte_len", "decode", "elements", *readers._content(t)]
    merged = stats.describe(stats.merge_moments(stored(readers.chunk_moments(t.select(*cols), keys), "moments"), keys).join(t.select(*keys, "element_count"), keys)).drop("element_count")
    out = readers.chunk_outliers(t.select(*cols).join(merged.select(*keys, "std"), keys), keys, stats.OUTLIER_STDS).groupBy(*keys).agg(F.sum("outliers").alias("_out"))
    merged = merged.join(out, keys, "left").withColumn("outlier_mass", F.when(F.col("n") > 0, F.coalesce("_out", F.lit(0)) / F.col("n"))).drop("_out")
    quality = F.when(F.col("decode").isNotNull(), "full").otherwise("deferred_quantized")
    return t.select(*keys, "format", "ord", "type_name", "shape", "element_count", "byte_len", "start", quality.alias("quality")).join(merged, keys, "left")


def deep_findings(spark: SparkSession, facts: DataFrame, tensors: DataFrame, stat: DataFrame, mad_k: float, tensor_entropy: bool) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """Findings of the second phase, the layers' profile and the fingerprints."""
    order = F.col("ord")
    odd = stat.where("nan_count > 0 or inf_count > 0")
    parts = [_f(odd, VALUES, order, "WEIGHT_NAN_INF", "high", _s("tensor '{}' holds {} NaN and {} infinite values", "name", "nan_count", "inf_count"), _s("dtype={}, elements={}", "type_name", "element_count"))]
    late = stat.where("format = 'gguf' and quality <> 'full'").groupBy("artifact").agg(F.array_join(F.array_sort(F.collect_set("type_name")), ", ").alias("types"))
    parts.append(_f(late, VALUES, 10**12, "STATS_DEFERRED_QUANTIZED", "info", F.lit("tensors of some block types are not decoded and have no statistics"), F.concat(F.lit("deferred types: "), "types")))
    if tensor_entropy:
        raw = stat.where(F.col("format").eqNullSafe("safetensors") & F.col("type_name").isin(*K.INTEGER_DTYPES) & (F.col("byte_len") >= 1024))
        high = readers.byte_entropies(raw.select("artifact", "name", "ord", "type_name", "byte_len", F.col("artifact").alias("path"), "start"), ["artifact", "name", "ord", "type_name", "byte_len"]).where("entropy > 7.95")
        parts.append(_f(high, VALUES, order, "TENSOR_ENTROPY_ANOMALY", "info", F.concat(_s("tensor '{}' ({}) has bytes like noise: ", "name", "type_name"), F.format_string("%.2f bits of 8; many harmless tensors do", "entropy")), F.format_string("entropy=%.3f bits/byte over %d bytes", "entropy", "byte_len")))
    profile = stored(stats.layer_profile(stat, ["artifact"]), "profile")
    found = stats.layer_anomalies(profile, ["artifact"], mad_k)
    parts.append(_f(found, LAYERS, F.col("layer"), "WEIGHT_OUTLIER_LAYER", F.col("severity"), F.concat(_s("layer {} stands out by its {}, ", "layer", "metric"), F.format_string("%.1f deviations from the median layer; worth a look, not a verdict", "mads")), F.format_string("metric=%s, value=%.4f, mads=%.2f", "metric", "value", "mads")))

    models = facts.where("format in ('safetensors', 'gguf') and header_error is null and bad_version is null")
    folder = F.regexp_extract("artifact", "^(.*)/[^/]*$", 1)
    here = models.select("artifact", "format", folder.alias("dir"), "kv")
    names = spark.createDataFrame([(i, n) for i, n in enumerate(K.SIBLING_FILES)], "i int, source string")
    sites = here.select("dir").distinct().join(F.broadcast(names)).withColumn("path", F.concat("dir", F.lit("/"), "source"))
    beside = readers.texts(sites.select("dir", "source", "path"), ["dir", "source"], K.MAX_TEXT).where("text is not null")
    inside = here.select("artifact", F.explode("kv").alias("v")).where("v.text is not null").select("artifact", F.col("v.key").alias("source"), F.col("v.text").alias("text"))
    all_texts = inside.union(here.join(beside, "dir").select("artifact", "source", "text"))
    hidden = text.secrets(stored(all_texts, "texts"), ["artifact"])
    parts.append(_f(hidden, SECRETS, F.pmod(F.hash("id", "detail"), F.lit(10**6)), F.col("id"), F.col("severity"), F.col("detail"), F.col("evidence")))

    js = beside.where("source = 'config.json'").select("dir", "text")
    num = lambda *keys: F.coalesce(*[F.get_json_object("text", f"$.{k}").try_cast("bigint") for k in keys])
    config = js.select("dir", F.get_json_object("text", "$.model_type").alias("c_declared"), num("num_hidden_layers", "n_layer").alias("c_layers"), num("hidden_size", "n_embd").alias("c_hidden"), num("num_attention_heads", "n_head").alias("c_heads"), num("vocab_size").alias("c_vocab"))
    gguf = here.select("artifact", F.expr("get(filter(kv, v -> v.key = 'general.architecture' and v.text is not null), 0).text").alias("g_declared"), *[F.expr(f"get(filter(kv, v -> endswith(v.key, '{s}') and v.number is not null), 0).number").alias(n) for s, n in ((".block_count", "g_layers"), (".embedding_length", "g_hidden"), (".attention.head_count", "g_heads"), (".vocab_size", "g_vocab"))])
    both = here.select("artifact", "format", "dir").join(config, "dir", "left").join(gguf, "artifact")
    side = lambda n: F.when(F.col("format") == "gguf", F.col(f"g_{n}")).otherwise(F.col(f"c_{n}"))
    given = both.select("artifact", side("declared").alias("declared"), side("layers").alias("given_layers"), side("hidden").alias("hidden"), side("heads").alias("n_heads"), side("vocab").alias("vocab"))
    prints = text.fingerprint(tensors.where("status <> 'malformed'"), given, ["artifact"]).withColumn("layer_count", F.coalesce("given_layers", "layer_count")).drop("given_layers")
    bad = F.col("finding") == "ARCH_MISMATCH"
    shown = lambda n: F.coalesce(F.col(n).cast("string"), F.lit("-"))
    detail = F.when(bad, _s("it is declared as '{}', but its tensors are named as in {}", "declared", "scheme")).otherwise(F.concat(F.lit("built as "), F.coalesce("family", F.lit("unknown")), F.lit(" ("), "scheme", F.lit(")")))
    evidence = F.when(bad, F.concat(F.lit("scheme="), "scheme", F.lit(", declared="), shown("declared"))).otherwise(F.concat(F.lit("layers="), shown("layer_count"), F.lit(", hidden="), shown("hidden"), F.lit(", heads="), shown("n_heads"), F.lit(", vocab="), shown("vocab")))
    parts.append(_f(prints, IDENTITY, 0, F.col("finding"), F.when(bad, "medium").otherwise("info"), detail, evidence))
    *kept, prints = all_stored("findings", [*parts, prints])
    return kept, profile, prints


def repository_findings(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Findings of code, loader maps and templates in a repository, and a table (artifact, format, digest, verdict) of the files that have any."""
    base = walk.base_of(path)
    py, configs = walk.repository(path)
    stem = lambda p: os.path.splitext(os.path.basename(p))[0]
    modules = spark.createDataFrame([(p, stem(p), os.path.getsize(p) if os.path.exists(p) else 0, p) for p in py], "artifact string, module string, size long, path string")
    code = stored(readers.texts(modules.where(F.col("size") <= K.MAX_TEXT), ["artifact", "module"], K.MAX_TEXT, True), "code")
    sources = spark.createDataFrame([(os.path.basename(p), p) for p in configs], "source string, path string")
    entries = stored(text.loader_entries(readers.texts(sources, ["source"], None).where("text is not null").select("source", F.col("text").alias("json"))), "entries")
    role = F.concat("role", F.lit(" -> "), "target")

    routed = entries.join(modules.select("artifact", "module"), "module").groupBy("artifact").agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("via"), F.array_sort(F.collect_list(role)).alias("roles"))
    calls = text.python_findings(code.where("text is not null").select("artifact", "text"), ["artifact"])
    labels = F.create_map(*[F.lit(x) for pair in K.PY_CALLS for x in pair])
    when = F.when(F.col("severity") == "high", " at module level, so on import").otherwise(" in a function")
    what = F.when(F.col("line_no").isNull(), F.col("evidence")).when(F.col("id") == "PY_OBFUSCATION", F.col("needle")).otherwise(F.concat(F.coalesce(labels[F.col("needle")], F.lit("")), F.lit(" through "), F.rtrim(F.col("needle"), F.lit("(.")), when))
    unread = modules.join(code.where("text is not null").select("artifact"), "artifact", "left_anti")
    lost = text.unresolved(entries, modules).withColumn("artifact", F.concat(F.lit(base + "/"), "source"))
    far = entries.where("external").withColumn("artifact", F.concat(F.lit(base + "/"), "source"))
    parts = [
        routed.select("artifact", F.lit(PARSE).alias("phase"), F.lit(0).cast("bigint").alias("ord"), F.lit("REMOTE_CODE_AUTO_MAP").alias("id"), F.lit("high").alias("severity"), _s("{} sends {} loader entries to this file, which runs on import", "via", "n").alias("detail"), F.col("roles").alias("evidence")),
        _f(calls, PARSE, F.lit(1) + F.col("ord"), F.col("id"), F.col("severity"), what, F.when(F.col("line_no").isNotNull(), F.col("evidence"))),
        _f(unread, PARSE, 1, "PY_NOT_READ", "medium", _s("{} bytes, which is too long to be read or can't be read; not looked at", "size")),
        _f(far, PARSE, 0, "REMOTE_CODE_EXTERNAL", "high", _s("{} maps {} to code in another repository", "source", "role"), role),
        lost.select("artifact", F.lit(PARSE).alias("phase"), F.lit(1).cast("bigint").alias("ord"), F.lit("REMOTE_CODE_UNRESOLVED").alias("id"), F.lit("medium").alias("severity"), _s("{} maps {} loader entries to module '{}', which isn't here", "source", "n_refs", "module").alias("detail"), F.col("roles").alias("evidence")),
    ]
    found = stored(reduce(DataFrame.union, parts), "findings")
    silent = modules.join(found.select("artifact").distinct(), "artifact", "left_anti")
    found = found.union(_f(silent, PARSE, 0, "REMOTE_CODE_PRESENT", "low", F.lit("Python code ships with the weights; no configuration loads it, but an import would run it")))

    wanted = [(os.path.join(base, n), n) for n in (*K.TEMPLATE_FILES, "tokenizer_config.json") if os.path.isfile(os.path.join(base, n))]
    files = stored(readers.texts(spark.createDataFrame([(p, n, p) for p, n in wanted], "artifact string, source string, path string"), ["artifact", "source"], None).where("text is not null"), "templates")
    js = F.get_json_object("text", "$.chat_template")
    named = F.transform(F.from_json(F.coalesce(js, F.when(F.ltrim("text").startswith("["), F.col("text"))), "array<struct<template: string>>"), lambda x: x["template"])
    # A value that is a JSON list holds named templates; a root that is a string is the template itself.
    root = F.when(js.isNull() & F.trim("text").startswith('"'), F.from_json(F.concat(F.lit("["), "text", F.lit("]")), "array<string>")[0])
    body = F.when(F.col("source").endswith(".json"), F.when(js.isNotNull() & ~F.ltrim(js).startswith("["), js).otherwise(F.coalesce(root, F.array_join(named, "\n")))).otherwise(F.col("text"))
    templates = files.select("artifact", "source", body.alias("text")).where("text is not null")
    tf = text.template_findings(text.regions(templates, ["artifact", "source"]), ["artifact", "source"])
    tfound = stored(_f(tf, PARSE, F.lit(1000) + F.col("ord"), F.col("id"), F.col("severity"), _s("the chat template in {}, line {}: {}", "source", "line", "what"), F.concat("source", F.lit(" line "), F.col("line").cast("string"), F.lit(": "), "evidence")), "findings")

    rank = C.severity_rank(F.col("severity"))
    risky = lambda df, least: df.groupBy("artifact").agg(F.max(rank).alias("r"), F.bool_or((F.col("id") == "PY_DANGEROUS_CALL") & (rank >= 3)).alias("runs"), F.bool_or(F.col("id") == "REMOTE_CODE_AUTO_MAP").alias("routed"))  # noqa: E731, ARG005
    py_rows = modules.select("artifact", F.lit("python").alias("format")).join(code.select("artifact", "digest"), "artifact", "left").join(risky(found, 0), "artifact", "left")
    py_rows = py_rows.select("artifact", "format", "digest", F.when(F.col("runs") | F.col("routed"), "untrusted").otherwise("clean").alias("verdict"), F.lit(2).alias("kind"))
    cfg = found.where("id in ('REMOTE_CODE_EXTERNAL', 'REMOTE_CODE_UNRESOLVED')").select("artifact").distinct().withColumn("path", F.col("artifact"))
    cfg_rows = readers.texts(cfg, ["artifact"], None, True).select("artifact", F.lit("config").alias("format"), "digest", F.lit("untrusted").alias("verdict"), F.lit(3).alias("kind"))
    t_rows = files.join(risky(tfound, 2), "artifact").select("artifact", F.when(F.col("source") == "tokenizer_config.json", "config").otherwise("template").alias("format"), "digest", F.when(F.col("r") >= 2, "untrusted").otherwise("clean").alias("verdict"), F.lit(4).alias("kind"))
    tagged = found.withColumn("kind", F.when(F.col("id").isin("REMOTE_CODE_EXTERNAL", "REMOTE_CODE_UNRESOLVED"), 3).otherwise(2)).union(tfound.withColumn("kind", F.lit(4)))
    return tagged, py_rows.union(cfg_rows).union(t_rows)


def run(spark: SparkSession, path: str, *, deep: bool = False, mad_k: float = 5.0, tensor_entropy: bool = False, bundle: str | None = None, key: str | None = None, manifest_tag: bytes = MANIFEST_TAG, only: list[str] | None = None) -> Scan:
    """All tables of a scan of ``path``, or of the artifacts in it that ``only`` names. The main steps are computed at once and stored.

    Findings of the second phase (``deep``) never change a verdict. Nothing of
    the artifacts is loaded or executed.
    """
    deep = deep or tensor_entropy
    found = walk.artifacts(spark, path, only)
    facts = stored(readers.facts(found), "facts")
    tensors = stored(tensors_of(facts), "tensors")
    sound = tensors.where("format = 'safetensors' and status in ('ok', 'size_mismatch', 'unknown_dtype')")

    def hashes() -> tuple[DataFrame, DataFrame, DataFrame]:
        parts = sound.select("artifact", "name", F.col("artifact").alias("path"), F.col("start").alias("begin"), F.col("byte_len").alias("len"))
        made = stored(readers.range_digests(parts, ["artifact", "name"]), "tensor-digests")
        manifest = stored(manifests(sound, made, manifest_tag), "manifests")
        return made, manifest, stored(signatures(facts.where("io_error is null"), manifest, bundle, key), "signatures")

    def values() -> tuple | None:
        if not deep:
            return None
        stat = stored(tensor_statistics(tensors), "tensor-stats")
        return stat, *deep_findings(spark, facts, tensors, stat, mad_k, tensor_entropy)

    unread = [
        _f(facts.where("io_error is not null"), PARSE, 0, "IO_ERROR", "high", F.concat(F.lit("it can't be read: "), "io_error")),
        _f(facts.where("format = 'unknown' and io_error is null"), PARSE, 0, "UNKNOWN_FORMAT", "medium", F.lit("it is no safetensors, GGUF or pickle file")),
    ]
    readable = facts.where("io_error is null").select("artifact", F.col("artifact").alias("path"), F.lit(0).cast("bigint").alias("begin"), F.col("size").alias("len"))
    # Steps that need facts and tensors alone, side by side: most of a small scan is planning.
    (tensor_digests, manifest, sig), deeper, (repo, repo_rows), digests, *parse = together(
        hashes,
        values,
        lambda: repository_findings(spark, path),
        lambda: stored(readers.range_digests(readable, ["artifact"]), "digests"),
        lambda: stored(gguf_findings(facts, tensors), "findings"),
        lambda: stored(safetensors_findings(facts, tensors), "findings"),
        lambda: stored(pickle_findings(facts), "findings"),
        lambda: stored(reduce(DataFrame.union, unread), "findings"),
    )
    parse = reduce(DataFrame.union, parse)
    has = facts.agg(F.coalesce(F.bool_or(F.col("artifact").endswith(".safetensors")), F.lit(False)).alias("has"))
    safer = facts.where("format = 'pickle'").join(F.broadcast(has)).where("has")
    more = [
        _f(safer, ALTERNATIVE, 0, "SAFE_ALTERNATIVE_AVAILABLE", "info", F.lit("a safetensors file is here too; prefer it")),
        sig.where("id is not null").select("artifact", F.lit(SIGNATURE).alias("phase"), F.lit(0).cast("bigint").alias("ord"), "id", "severity", "detail", "evidence"),
    ]
    scan = Scan(spark, path, found, facts, deep=deep)
    scan.tables = {"tensors": tensors, "digests": digests, "tensor_digests": tensor_digests, "manifests": manifest, "signatures": sig}
    if deeper:
        stat, extra, profile, prints = deeper
        more += extra
        scan.tables |= {"tensor_stats": stat, "layer_profile": profile, "layer_anomalies": stats.layer_anomalies(profile, ["artifact"], mad_k), "fingerprints": prints}
    other = found.where("size(aliases) > 0").withColumn("n", F.size("aliases"))
    names = F.concat(F.slice("aliases", 1, K.MAX_ALIASES), F.when(F.col("n") > K.MAX_ALIASES, F.array(F.format_string("and %d more", F.col("n") - K.MAX_ALIASES))).otherwise(F.array().cast("array<string>")))
    more.append(other.select("artifact", F.lit(ALIASES).alias("phase"), F.lit(0).cast("bigint").alias("ord"), F.lit("ALIASED_ARTIFACT").alias("id"), F.lit("info").alias("severity"), _s("{} other path(s) lead to the same file; it was read once", "n").alias("detail"), names.alias("evidence")))
    rank = C.severity_rank(F.col("severity"))
    worst = parse.groupBy("artifact").agg(F.max(rank).alias("r"))
    verdict = (
        F.when(F.col("io_error").isNotNull(), "error")
        .when((F.col("format") == "unknown") | F.col("header_error").isNotNull() | F.col("bad_version").isNotNull(), "malformed")
        .when((F.col("format") == "pickle") | (F.col("r") >= 2), "untrusted")
        .otherwise("clean")
    )
    own = facts.join(worst, "artifact", "left").join(digests, "artifact", "left").select("artifact", "format", "digest", verdict.alias("verdict"), F.lit(1).alias("kind"))
    scan.tables["reports"] = own.union(repo_rows)
    scan.findings = parse.withColumn("kind", F.lit(1)).union(reduce(DataFrame.union, more).withColumn("kind", F.lit(1))).union(repo)
    return scan
