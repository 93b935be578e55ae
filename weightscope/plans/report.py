"""Reports: what the driver shows of a scan or a comparison, or executors write of very many artifacts."""

from __future__ import annotations

import json
import math
import os
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.plans.scan import Scan
from weightscope.sources.tables import together

STATS = ("nan_count", "inf_count", "min", "max", "max_abs", "mean", "std", "l2_norm", "rms", "kurtosis", "sparsity", "outlier_mass")
PROFILE = ("layer", "l2", "mean_kurtosis", "max_abs", "params", "sparsity")
#: Columns whose numbers may be none, and how Spark writes those as JSON.
NUMBERS = frozenset((*STATS, *PROFILE, "mads"))
UNREAL = {"NaN": math.nan, "Infinity": math.inf, "-Infinity": -math.inf}


def plain(x):
    """JSON has no NaN and no infinity: they become null."""
    if isinstance(x, float) and not math.isfinite(x):
        return None
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


@dataclass
class Report:
    """All reports of a scan, in order, and whether there was nothing to scan."""

    artifacts: list[dict]
    nothing_scanned: bool = False
    svg_points: list[dict] = field(default_factory=list)

    def max_severity(self) -> int:
        """The highest rank of any finding; -1 without any."""
        return max((K.RANK[f["severity"]] for a in self.artifacts for f in a["findings"]), default=-1)

    def exit_code(self, fail_on: str = "high", allow_empty: bool = False) -> int:
        """3 on an error, 4 if nothing was there (0 if allowed), 2 if malformed, 1 at the threshold, else 0."""
        verdicts = [a["verdict"] for a in self.artifacts]
        if "error" in verdicts:
            return 3
        if verdicts and set(verdicts) == {"empty"}:
            return 0 if allow_empty else 4
        if "malformed" in verdicts:
            return 2
        return int(self.max_severity() >= K.RANK[fail_on.strip().lower()])

    def to_json(self) -> str:
        """One artifact as it is, several in a wrapper."""
        doc = self.artifacts[0] if len(self.artifacts) == 1 else {"artifacts": self.artifacts}
        return json.dumps(plain(doc), indent=2, ensure_ascii=False)

    def to_human(self, color: bool = False) -> str:
        """A block for each artifact and a last line."""
        style = Style(color)
        out = []
        for a in self.artifacts:
            out.append(f"{style.bold(a['artifact'])}  {style.dim('[' + a['format'] + ']')}  {style.dim('->')} {style.verdict(a['verdict'])}")
            hashes = a.get("hashes", {})
            out += [f"  {style.dim(k + ': ' + hashes[k])}" for k in ("manifest", "file") if k in hashes]
            out.append(f"  {style.dim('signature:')} {a['signature']}")
            for f in a["findings"]:
                out.append(f"  [{style.severity(f['severity'])}] {style.bold(f['id'])}: {f['detail']}")
                out += [f"      - {e}" for e in f.get("evidence", [])]
            out.append("")
        verdicts, worst = [a["verdict"] for a in self.artifacts], self.max_severity()
        if "error" in verdicts:
            last = style.verdict("error", "nothing scanned: there is no such path" if self.nothing_scanned else "an internal error occurred")
        elif self.nothing_scanned:
            last = style.verdict("empty", "nothing scanned: the path holds no artifact")
        elif "malformed" in verdicts:
            last = style.verdict("malformed", "some artifacts are malformed")
        else:
            last = f"worst finding: {style.severity(K.SEVERITIES[worst])}" if worst >= 0 else style.verdict("clean")
        out.append(last if self.nothing_scanned else f"scanned {len(self.artifacts)} artifact(s); {last}")
        return "\n".join(out) + "\n"

    def sparklines(self, color: bool = False) -> str:
        """The layers' profile of each artifact that has one."""
        return "".join(sparkline(a["artifact"], a["layer_profile"], color) for a in self.artifacts if a.get("layer_profile"))

    def svg(self) -> str | None:
        """A picture of the first profile."""
        for a in self.artifacts:
            if a.get("layer_profile"):
                points = a["layer_profile"]
                return draw(f"{os.path.basename(a['artifact'])}: l2 by layer", [p["l2"] for p in points], {i: p["anomaly"]["mads"] for i, p in enumerate(points) if p["anomaly"]})
        return None


class Style:
    """ANSI styles, or none."""

    SEVERITY = {"critical": "1;35", "high": "1;31", "medium": "33", "low": "36", "info": "2"}
    VERDICT = {"clean": "32", "untrusted": "31", "malformed": "33", "empty": "33", "error": "1;31"}

    def __init__(self, on: bool):
        self.on = on

    def _wrap(self, codes: str, text: str) -> str:
        return f"\x1b[{codes}m{text}\x1b[0m" if self.on else text

    def bold(self, text: str) -> str:
        return self._wrap("1", text)

    def dim(self, text: str) -> str:
        return self._wrap("2", text)

    def severity(self, name: str) -> str:
        return self._wrap(self.SEVERITY[name], name)

    def verdict(self, name: str, text: str | None = None) -> str:
        return self._wrap(self.VERDICT[name], text or name)


BARS = "▁▂▃▄▅▆▇█"


def bars(values: list[float]) -> str:
    """Numbers as one character each; all lowest if flat."""
    if not values:
        return ""
    low, span = min(values), max(values) - min(values)
    return "".join(BARS[math.floor((v - low) / span * 7 + 0.5) if span > 0 else 0] for v in values)


def sparkline(title: str, points: list[dict], color: bool = False, metric: str = "l2") -> str:
    """A profile in two or three lines."""
    style, values = Style(color), [p[metric] for p in points]
    odd = [f"layer {p['layer']} ({p['anomaly']['metric']}, {p['anomaly']['mads']:.1f} MADs)" for p in points if p.get("anomaly")]
    line = f"{style.bold(title)}  {metric} by layer\n  {bars(values)}  {min(values):.4g} to {max(values):.4g}\n"
    return line + (f"  {style.severity('medium') if color else 'anomalous:'} {', '.join(odd)}\n" if odd else "")


def draw(title: str, values: list[float], odd: dict[int, float]) -> str:
    """A line chart, 900 by 320, from zero."""
    width, height, pad = 900, 320, 40
    low, high = min([0.0, *values]), max([0.0, *values])
    span = high - low or 1.0
    x = lambda i: pad + (width - 2 * pad) * (i / max(1, len(values) - 1))
    y = lambda v: height - pad - (height - 2 * pad) * ((v - low) / span)
    escaped = title.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    dots = "".join(f'<circle cx="{x(i):.1f}" cy="{y(values[i]):.1f}" r="5" fill="#c0392b"><title>{m:.1f} MADs</title></circle>' for i, m in sorted(odd.items()))
    line = " ".join(f"{x(i):.1f},{y(v):.1f}" for i, v in enumerate(values))
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" viewBox="0 0 {width} {height}"><rect width="{width}" height="{height}" fill="white"/>'
        f'<text x="{pad}" y="24" font-family="sans-serif" font-size="14">{escaped}</text><line x1="{pad}" y1="{y(0):.1f}" x2="{width - pad}" y2="{y(0):.1f}" stroke="#999"/>'
        f'<polygon points="{x(0):.1f},{y(0):.1f} {line} {x(len(values) - 1):.1f},{y(0):.1f}" fill="#2c5d8a" fill-opacity="0.12"/><text x="{pad}" y="{height - 12}" font-family="sans-serif" font-size="11" fill="#666">{min(values):.4g} to {max(values):.4g}</text>'
        f'<polyline points="{line}" fill="none" stroke="#2c5d8a" stroke-width="2"/>{dots}</svg>\n'
    )


def _finding(r) -> dict:
    out = {"id": r["id"], "severity": r["severity"], "detail": r["detail"]}
    return out | ({"evidence": list(r["evidence"])} if r["evidence"] else {})


#: The tables that a report is made of, and what orders their rows in it.
PARTS = {
    "reports": (), "findings": ("phase", "ord", "id", "detail"), "manifests": (), "signatures": (), "tensor_digests": ("name",), "tensor_stats": ("ord",),
    "layer_profile": ("layer",), "layer_anomalies": ("layer",), "fingerprints": (),
}


def _assemble(parts: dict[str, list]) -> dict:
    """The report of one artifact from its rows of each table, which are mappings."""
    rows = {name: sorted(parts.get(name, ()), key=lambda r: tuple(r[c] for c in order)) for name, order in PARTS.items()}  # noqa: B023
    r, hashes = rows["reports"][0], {}
    one = lambda name, column: rows[name][0][column] if rows[name] else None
    if one("manifests", "manifest"):
        hashes["manifest"] = one("manifests", "manifest")
    if r["digest"]:
        hashes["file"] = f"blake3:{r['digest']}"
    if rows["tensor_digests"]:
        hashes["per_tensor"] = {t["name"]: f"blake3:{t['digest']}" for t in rows["tensor_digests"]}
    doc = {"artifact": r["artifact"], "format": r["format"], "verdict": r["verdict"], "findings": [_finding(f) for f in rows["findings"]]}
    if hashes:
        doc["hashes"] = hashes
    doc["signature"] = one("signatures", "status") or "unsigned"
    if rows["tensor_stats"]:
        doc["stats"] = {"per_tensor": [_tensor(t) for t in rows["tensor_stats"]]}
    if rows["layer_profile"]:
        bad = {a["layer"]: {"metric": a["metric"], "mads": a["mads"], "severity": a["severity"]} for a in rows["layer_anomalies"]}
        doc["layer_profile"] = [{k: p[k] for k in PROFILE} | {"anomaly": bad.get(p["layer"])} for p in rows["layer_profile"]]
    if rows["fingerprints"]:
        p = rows["fingerprints"][0]
        doc["fingerprint"] = {"scheme": p["scheme"], "detected_family": p["family"], "declared": p["declared"], "layer_count": p["layer_count"], "hidden": p["hidden"], "n_heads": p["n_heads"], "vocab": p["vocab"]}
    return doc


def _tables(scan: Scan) -> dict[str, DataFrame]:
    """The tables of ``PARTS`` that a scan has; those without a kind are about artifacts, which are of the first."""
    tables = {"findings": scan.findings, **scan.tables}
    return {n: tables[n] if "kind" in tables[n].columns else tables[n].withColumn("kind", F.lit(1)) for n in PARTS if n in tables}


def collect(scan: Scan) -> Report:
    """The report of a scan, on the driver: for as many artifacts as a reader can look through. ``documents`` is for more."""
    tables, by = _tables(scan), {}
    for name, rows in zip(tables, together(*[t.collect for t in tables.values()]), strict=True):
        for r in rows:
            by.setdefault((r["kind"], r["artifact"]), {}).setdefault(name, []).append(r)
    out = [_assemble(by[key]) for key in sorted(by) if "reports" in by[key]]
    if out:
        return Report(out)
    there = os.path.exists(scan.path)
    one = {"id": "NO_ARTIFACTS", "severity": "info", "detail": "no model artifact is at the path"} if there else {"id": "PATH_NOT_FOUND", "severity": "high", "detail": "there is no such path"}
    return Report([{"artifact": scan.path, "format": "unknown", "verdict": "empty" if there else "error", "findings": [one], "signature": "unsigned"}], True)


def documents(scan: Scan) -> DataFrame:
    """artifact, kind and report: one JSON text an artifact, as in ``collect``, put together by the executors.

    The rows about an artifact are dealt to one task, which holds one report at
    a time; write the result wherever reports of very many artifacts belong.
    """
    parts = [t.select("kind", "artifact", F.lit(n).alias("part"), F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("row")) for n, t in _tables(scan).items()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for (kind, artifact), own in groupby(rows, key=lambda r: (r["kind"], r["artifact"])):
            held: dict[str, list] = {}
            for r in own:
                held.setdefault(r["part"], []).append({k: UNREAL.get(v, v) if k in NUMBERS and isinstance(v, str) else v for k, v in json.loads(r["row"]).items()})
            if "reports" in held:
                yield pa.RecordBatch.from_pylist([{"artifact": artifact, "kind": kind, "report": json.dumps(plain(_assemble(held)), ensure_ascii=False)}], schema)

    schema = pa.schema([("artifact", pa.string()), ("kind", pa.int32()), ("report", pa.string())])
    return reduce(DataFrame.union, parts).repartition("kind", "artifact").sortWithinPartitions("kind", "artifact").mapInArrow(run, "artifact string, kind int, report string")


def _tensor(r) -> dict:
    out = {"name": r["name"], "dtype": r["type_name"], "shape": list(r["shape"]), "element_count": r["element_count"], "byte_size": r["byte_len"], "quality": r["quality"]}
    return out | ({k: r[k] for k in STATS if r[k] is not None} if r["quality"] == "full" else {})


def human_size(n: int) -> str:
    """Bytes in IEC units."""
    v, u = float(n), 0
    while v >= 1024 and u < 4:
        v, u = v / 1024, u + 1
    return f"{n} B" if not u else f"{v:.1f} {('KiB', 'MiB', 'GiB', 'TiB')[u - 1]}"


def human_duration(seconds: float) -> str:
    """Milliseconds below a second, else seconds."""
    return f"{int(seconds * 1000)}ms" if seconds < 1 else f"{seconds:.2f}s"
