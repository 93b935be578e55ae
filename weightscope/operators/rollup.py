"""From findings to verdicts, severities and exit codes; pickle risk; signatures; aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C


def max_severity(findings: DataFrame, keys: list[str]) -> DataFrame:
    """The highest sev_rank of each of ``keys`` and its name."""
    return findings.groupBy(*keys).agg(F.max("sev_rank").alias("sev_rank")).withColumn("severity", C.severity_name(F.col("sev_rank")))


def verdicts(findings: DataFrame, keys: list[str], least: str = "medium") -> DataFrame:
    """untrusted for ``keys`` with a finding of ``least`` severity, else clean."""
    return findings.groupBy(*keys).agg(F.when(F.max("sev_rank") >= K.RANK[least], "untrusted").otherwise("clean").alias("verdict"))


def exit_code(verdict_error: Column, verdict_empty: Column, verdict_malformed: Column, sev_rank: Column, fail_on: str = "high", allow_empty: bool = False) -> Column:
    """3 on an error, 4 if nothing was there (0 if allowed), 2 if malformed, 1 at the threshold, else 0."""
    return F.when(verdict_error, 3).when(verdict_empty, 0 if allow_empty else 4).when(verdict_malformed, 2).when(F.coalesce(sev_rank >= K.RANK[fail_on], F.lit(False)), 1).otherwise(0)


def pickle_risk(streams: DataFrame, refs: DataFrame, key: str = "artifact") -> DataFrame:
    """One of PICKLE_RCE_RISK, PICKLE_GLOBAL_REF and PICKLE_UNTRUSTED for each artifact, with evidence.

    ``streams``: key, entry, exec_ops (in order); ``refs``: key, entry, ord,
    opcode, module, name. At most 32 dangerous references and 32 streams are
    listed.
    """
    label = lambda text: F.concat(F.when(F.col("entry") == "", "").otherwise(F.concat("entry", F.lit(": "))), text)
    bad = C.is_dangerous_global(F.col("module"), F.col("name"))
    marked = refs.withColumns({"bad": bad, "text": label(F.concat(F.lit("opcode "), "opcode", F.lit(" -> "), "module", F.lit("."), "name"))})
    rank = F.row_number().over(Window.partitionBy(key, "bad").orderBy("ord"))
    from_refs = marked.withColumn("_rn", rank).groupBy(key).agg(
        F.bool_or("bad").alias("any_bad"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("bad") & (F.col("_rn") <= K.MAX_EVIDENCE), F.struct("ord", "text")))), lambda x: x["text"]).alias("bad_refs"),
    )
    ops = F.array_distinct("exec_ops")
    from_streams = streams.groupBy(key).agg(
        F.bool_or(F.size("exec_ops") > 0).alias("any_exec"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.when(F.size("exec_ops") > 0, F.struct("stream_no", label(F.concat(F.lit("execution opcodes: "), F.array_join(ops, ", "))).alias("text"))))), lambda x: x["text"]), 1, K.MAX_EVIDENCE).alias("execs"),
    )
    both = from_streams.join(from_refs, key, "full_outer")
    risky = F.coalesce("any_bad", F.lit(False)) | F.coalesce("any_exec", F.lit(False))
    none = F.array().cast("array<string>")
    return both.select(
        key,
        F.when(risky, "PICKLE_RCE_RISK").when(F.col("any_bad").isNotNull(), "PICKLE_GLOBAL_REF").otherwise("PICKLE_UNTRUSTED").alias("id"),
        F.when(risky, "high").otherwise("medium").alias("severity"),
        F.when(risky, F.concat(F.coalesce("bad_refs", none), F.coalesce("execs", none))).otherwise(none).alias("evidence"),
    )


def aliases(files: DataFrame) -> DataFrame:
    """One artifact for each canonical file: the first path, the other paths as aliases."""
    return files.groupBy("canonical").agg(F.array_sort(F.collect_set("path")).alias("_p")).select(F.col("_p")[0].alias("artifact"), "canonical", F.slice("_p", F.lit(2), F.size("_p")).alias("aliases"))


def signature_status(kind: Column, expected: Column, computed: Column) -> Column:
    """Status of a signature by the kind of bundle: none, sigstore, transparency, unknown or detached without a key."""
    return (
        F.when(kind.isNull(), "unsigned")
        .when(kind == "sigstore", "unverified (sigstore)")
        .when((kind == "transparency") & computed.isNull(), "unverified")
        .when((kind == "transparency") & (computed == expected), "signed")
        .when(kind == "transparency", "signature-mismatch")
        .otherwise("unverified")
    )


def bundle_kind(text: Column) -> Column:
    """What kind of bundle a JSON text is."""
    has = lambda k: F.get_json_object(text, f"$.{k}").isNotNull()
    sigstore = has("verificationMaterial") | has("messageSignature") | has("tlogEntries") | F.coalesce(F.get_json_object(text, "$.mediaType").contains("sigstore"), F.lit(False))
    return F.when(text.isNotNull(), F.when(sigstore, "sigstore").when(has("manifest"), "transparency").otherwise("unknown"))
