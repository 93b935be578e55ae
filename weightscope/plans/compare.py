"""Comparison of two models: from two paths to drift, divergences and a report."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C
from weightscope.operators import drift, text
from weightscope.plans import report as R
from weightscope.plans.scan import tensors_of
from weightscope.sources import readers, walk

DRIFT = ("cosine", "rel_l2", "changed_frac", "delta_max_abs", "delta_rms", "delta_std", "delta_kurtosis")


@dataclass
class Comparison:
    """The report of a comparison."""

    doc: dict

    def exit_code(self, fail_on: str = "high") -> int:
        """1 if any finding is at the threshold."""
        return int(max((K.RANK[f["severity"]] for f in self.doc["findings"]), default=-1) >= K.RANK[fail_on.strip().lower()])

    def to_json(self) -> str:
        """The report as it is."""
        return json.dumps(R.plain(self.doc), indent=2, ensure_ascii=False)

    def to_human(self, color: bool = False) -> str:
        """A few lines, the layers as bars."""
        d, style = self.doc, R.Style(color)
        s = d["summary"]
        out = [f"{style.bold(d['subject'])}\n  against {d['baseline']}", f"  architecture: {d['arch']['subject']} / {d['arch']['baseline']} ({'same' if d['arch']['match'] else 'different'})"]
        out += [f"  {n}" for n in d.get("normalization", [])]
        out.append(f"  matched {s['matched']}, identical {s['identical_fraction']:.0%}, structural {s['structural']}, worst rel_l2 {s['worst_drift']:.4f}")
        if d["layer_drift"]:
            values = [p["rel_l2"] for p in d["layer_drift"]]
            out.append(f"  {R.bars([min(v, 1e308) for v in values])}  rel_l2 by layer, {min(values):.4f} to {max(values):.4f}")
        for f in d["findings"]:
            out.append(f"  [{style.severity(f['severity'])}] {style.bold(f['id'])}: {f['detail']}")
            out += [f"      - {e}" for e in f.get("evidence", [])]
        return "\n".join(out) + "\n"

    def svg(self) -> str | None:
        """A picture of the layers' drift."""
        points = self.doc["layer_drift"]
        return R.draw("rel_l2 by layer", [min(p["rel_l2"], 1e308) for p in points], {i: p["anomaly"]["mads"] for i, p in enumerate(points) if p["anomaly"]}) if points else None


def _f(id_: str, severity: str, detail: str, *evidence: str) -> dict:
    return {"id": id_, "severity": severity, "detail": detail} | ({"evidence": list(evidence)} if evidence else {})


def _error(subject: str, baseline: str, message: str) -> Comparison:
    return Comparison(_doc(subject, baseline, {"subject": "unknown", "baseline": "unknown", "match": False}, [], [_f("COMPARE_ERROR", "high", message)]))


def _doc(subject: str, baseline: str, arch: dict, normalization: list[str], findings: list[dict], **more) -> dict:
    doc = {"subject": subject, "baseline": baseline, "arch": arch}
    if normalization:
        doc["normalization"] = normalization
    empty = {"matched": 0, "identical_fraction": 0.0, "structural": 0, "worst_drift": 0.0}
    return doc | {"structural_divergences": [], "tensor_drift": [], "layer_drift": [], "findings": findings, "summary": empty} | more


def _side(tensors: DataFrame, path: str) -> DataFrame:
    good = (F.col("status") == "ok") | F.col("status").isin("size_mismatch", "unknown_dtype")
    t = tensors.where((F.col("artifact") == path) & good)
    elements = F.least(C.product(F.col("shape")), F.lit(9.2e18)).cast("bigint")
    return t.select("name", "shape", "ord", F.col("decode").isNotNull().alias("decodable"), F.col("artifact").alias("path"), "start", F.coalesce("avail_len", "byte_len").alias("byte_len"), "decode", elements.alias("elements"))


def run(spark: SparkSession, subject: str, baseline: str, *, mad_k: float = 5.0, epsilon: float = 1e-6, force: bool = False) -> Comparison:
    """Compare two models.

    Other architectures are refused unless ``force``: that is decided from the
    headers alone, before any values are read.
    """
    try:
        subject, baseline = walk.resolve_model(subject), walk.resolve_model(baseline)
    except (ValueError, OSError) as e:
        return _error(subject, baseline, str(e))
    paths = [subject, baseline]
    facts = readers.facts(spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "artifact string")).cache()
    heads = {r["artifact"]: r for r in facts.select("artifact", "format", "io_error", "header_error", "bad_version").collect()}
    if any(heads[p]["io_error"] for p in paths):
        return _error(subject, baseline, "one of the files can't be read")
    kinds = {heads[p]["format"] for p in paths}
    if len(kinds) > 1 or not kinds <= {"safetensors", "gguf"}:
        return _error(subject, baseline, "both must be safetensors, or both GGUF")
    for p in paths:
        if heads[p]["header_error"] or heads[p]["bad_version"]:
            return _error(subject, baseline, heads[p]["header_error"] or "unsupported version")
    tensors = tensors_of(facts).cache()
    s, b = _side(tensors, subject), _side(tensors, baseline)

    normalization, prints = [], []
    for tag, side, path in (("subject", s, subject), ("baseline", b, baseline)):
        names = side.select(C.canonical_name(F.col("name")).alias("name"), F.col("name").alias("was"))
        n = names.where("name <> was").count()
        if n:
            normalization.append(f"wrapper prefixes were taken off {n} names of the {tag}")
        kv = facts.where(F.col("artifact") == path)
        declared = kv.select(F.lit(1).alias("m"), F.expr("get(filter(kv, v -> v.key = 'general.architecture'), 0).text").alias("declared"), F.expr("get(filter(kv, v -> endswith(v.key, '.block_count') and v.number is not null), 0).number").alias("blocks"))
        row = text.fingerprint(names.withColumn("m", F.lit(1)), declared, ["m"]).first()
        prints.append((row["scheme"], row["family"], row["blocks"] if row["blocks"] is not None else row["layer_count"]) if row else ("unknown", None, None))
    same = (prints[0][0], prints[0][2]) == (prints[1][0], prints[1][2])
    arch = {"subject": prints[0][1] or prints[0][0], "baseline": prints[1][1] or prints[1][0], "match": same}
    if not same and not force:
        detail = f"{arch['subject']} with {prints[0][2] or 0} layers and {arch['baseline']} with {prints[1][2] or 0} are different architectures, whose drift means nothing; force the comparison to see it all the same"
        return Comparison(_doc(subject, baseline, arch, normalization, [_f("ARCH_MISMATCH", "high", detail)]))
    findings = [] if same else [_f("ARCH_MISMATCH", "medium", "the architectures differ; what follows was forced and is not reliable")]

    aligned = drift.align(s, b).cache()
    pick = lambda side, t: side.select(*[F.col(c).alias(f"{t}_{c}") for c in ("name", "path", "start", "byte_len", "decode", "elements")])
    pairs = aligned.where("kind = 'drift'").select("canonical_name", "s_name", "b_name").join(pick(s, "s"), "s_name").join(pick(b, "b"), "b_name")
    drifts = _drift(pairs, ["canonical_name", "s_name"], epsilon).withColumnRenamed("s_name", "name").cache()

    ties = []
    for t, side, other in (("s", s, "subject"), ("b", b, "baseline")):
        lone = aligned.where(F.col("kind") == f"only_in_{other}").select("canonical_name", F.col(f"{t}_name").alias("name")).where(F.col("canonical_name").isin(*K.TIED))
        has = aligned.where(F.col(f"{t}_name").isNotNull()).select(F.col("canonical_name").alias("c2"), F.col(f"{t}_name").alias("other"))
        table = spark.createDataFrame([(a, c) for a, cs in K.TIED.items() for c in cs], "canonical_name string, c2 string")
        cand = lone.join(F.broadcast(table), "canonical_name").join(has, "c2").join(pick(side, "s"), F.col("name") == F.col("s_name")).join(pick(side, "b"), F.col("other") == F.col("b_name"))
        shapes = side.select(F.col("name"), F.col("shape").alias("sh1")), side.select(F.col("name").alias("other"), F.col("shape").alias("sh2"))
        cand = cand.join(shapes[0], "name").join(shapes[1], "other").where("sh1 = sh2")
        known = cand.where("s_decode is not null and b_decode is not null")
        equal = _drift(known, ["name", "other"], epsilon).where(F.col("rel_l2") < drift.SAME).select("name", "other")
        ties.append(equal.union(cand.where("s_decode is null or b_decode is null").select("name", "other")).withColumn("side", F.lit(t)))
    tied = drift.tied(aligned, ties[0].union(ties[1])).cache()

    for r in tied.orderBy("canonical_name").collect():
        findings.append(_f("TIED_WEIGHT", "info", f"'{r['name']}' is tied to '{r['tied_to']}' and was only stored once on the other side", "the same side holds both with equal values"))
    lost = aligned.where("kind not in ('drift', 'deferred')").join(tied.select("canonical_name"), "canonical_name", "left_anti")
    details = {"only_in_subject": "the baseline lacks it", "only_in_baseline": "the subject lacks it"}
    structural = []
    for r in lost.orderBy("canonical_name").collect():
        detail = details.get(r["kind"]) or f"subject {list(r['s_shape'])}, baseline {list(r['b_shape'])}"
        structural.append({"name": r["s_name"] or r["b_name"], "kind": r["kind"], "detail": detail})
    findings += [_f("STRUCTURAL_DIVERGENCE", "high", f"{x['kind']}: {x['name']}", x["detail"]) for x in structural]
    layers = []
    for r in drift.layer_drift(drifts, [], mad_k).orderBy("layer").collect():
        anomaly = None
        if r["severity"]:
            anomaly = {"mads": r["mads"], "severity": r["severity"]}
            findings.append(_f("LAYER_DRIFT_OUTLIER", r["severity"], f"layer {r['layer']} moved more than the others (rel_l2={r['rel_l2']:.3f}, {r['mads']:.1f} deviations above the median); worth a look, not a verdict", f"dominant tensor: {r['dominant'] or ''}"))
            if r["dominant"]:
                findings.append(_f("TENSOR_DRIFT", r["severity"], f"tensor '{r['dominant']}' makes up most of the drift of layer {r['layer']}"))
        layers.append({"layer": r["layer"], "rel_l2": r["rel_l2"], "anomaly": anomaly})
    summary = drift.summary(drifts, lost).first()
    if summary["identical"]:
        findings.append(_f("IDENTICAL", "info", "all matched tensors are the same"))
    deferred = aligned.where("kind = 'deferred'").count()
    if deferred:
        findings.append(_f("DRIFT_DEFERRED_QUANTIZED", "info", f"{deferred} matched pairs of block types that aren't decoded were passed over"))
    rows = [{"name": r["name"]} | {k: r[k] for k in DRIFT} for r in drifts.orderBy("name").collect()]
    numbers = {k: summary[k] for k in ("matched", "identical_fraction", "structural", "worst_drift")}
    return Comparison(_doc(subject, baseline, arch, normalization, findings, structural_divergences=structural, tensor_drift=rows, layer_drift=layers, summary=numbers))


def _drift(pairs: DataFrame, keys: list[str], epsilon: float) -> DataFrame:
    parts = readers.chunk_pairs(pairs, keys, epsilon)
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "dot", "diff2", "changed", *[f"{t}{k}" for t in "sb" for k in (1, 2, 3, 4)])], F.max("max_s").alias("max_s"), F.max("max_b").alias("max_b"))
    return drift.tensor_drift(sums)


def exists(path: str) -> bool:
    """Is there something at a path?"""
    return os.path.exists(path)
