"""Text that ships with models: secrets, URLs, Python, templates, loader maps."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weightscope import constants as K
from weightscope.functions import columns as C


def secrets(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Secrets and URLs in texts (keys, source, text): keys, id, severity, detail, evidence.

    One row for each id and detail of ``keys``, the first found: an info for
    URLs, by confidence for tokens, high for key blocks and account files.
    """
    tok = texts.select(*keys, "source", F.posexplode(C.tokens(F.col("text"))).alias("pos", "token"))
    label, conf = C.secret_label(F.col("token"))
    tok = tok.withColumns({"label": label, "severity": conf}).where("label is not null")
    found = tok.select(*keys, F.lit("EMBEDDED_SECRET").alias("id"), "severity", F.concat(F.lit("possible "), "label", F.lit(" in "), "source").alias("detail"), C.redact(F.col("token")).alias("evidence"), "pos")
    url = texts.select(*keys, "source", F.posexplode(C.urls(F.col("text"))).alias("pos", "url"))
    url = url.select(*keys, F.lit("SUSPICIOUS_URL"), F.lit("info"), F.concat(F.lit("external URL in "), "source"), C.truncate(F.col("url"), 120), "pos")
    t = F.col("text")
    pem = texts.where(t.contains("-----BEGIN") & t.contains("PRIVATE KEY-----")).select(*keys, F.lit("EMBEDDED_SECRET"), F.lit("high"), F.concat(F.lit("private key block in "), "source"), F.lit(None).cast("string"), F.lit(0))
    account = texts.where(t.contains('"type"') & t.contains("service_account") & t.contains("private_key")).select(
        *keys, F.lit("EMBEDDED_SECRET"), F.lit("high"), F.concat(F.lit("service account credentials in "), "source"), F.lit(None).cast("string"), F.lit(0)
    )
    return first_of(reduce(DataFrame.union, (found, url, pem, account)), keys)


def first_of(found: DataFrame, keys: list[str]) -> DataFrame:
    """One row by keys, id and detail, the first by ``pos``."""
    rest = [c for c in found.columns if c not in (*keys, "id", "detail", "pos")]
    first = found.groupBy(*keys, "id", "detail").agg(F.min_by(F.struct(*rest), F.col("pos")).alias("_first"))
    return first.select(*[F.col("_first")[c].alias(c) if c in rest else F.col(c) for c in found.columns if c != "pos"])


def code_lines(texts: DataFrame, keys: list[str], matters: Callable[[Column], Column] | None = None) -> DataFrame:
    """Lines of Python texts that aren't blank or comments: keys, line_no, line (no indent), module_level.

    Lines of which ``matters`` is false, with indent and all, are passed over first.
    """
    lines = texts.select(*keys, F.posexplode(F.split("text", "\n")).alias("i", "raw"))
    if matters:
        lines = lines.where(matters(F.col("raw")))
    raw = F.regexp_replace("raw", "\r$", "")
    line = F.regexp_replace(raw, r"^\s+", "")
    return lines.select(*keys, (F.col("i") + 1).alias("line_no"), line.alias("line"), (F.length(raw) == F.length(line)).alias("module_level")).where((F.col("line") != "") & ~F.col("line").startswith("#"))


def may_matter(text: Column) -> Column:
    """Can a text hold a dangerous call or something hidden? Wrong for no text that does; one look instead of one a rule.

    Patterns are tried only where a plain search or the length says that they can fit.
    """
    names = [n for n, _ in K.PY_CALLS]
    calls = r"(^|[^A-Za-z0-9_.])(?:" + "|".join(map(re.escape, names)) + ")"
    may_call = reduce(lambda a, b: a | b, map(text.contains, names))
    run = "[A-Za-z0-9+/=]"
    return (may_call & text.rlike(calls)) | text.contains("\\x") | ((F.octet_length(text) >= 200) & text.rlike(f"(?<!{run}){run}{{200}}"))


def python_findings(texts: DataFrame, keys: list[str], most: int = K.MAX_PY) -> DataFrame:
    """Dangerous calls and obfuscation by line: keys, ord, id, severity, needle, line_no, evidence.

    At most ``most`` rows by keys, and one more that counts the rest. Lines that
    can't have any are passed over before the rules are looked at one by one;
    one window numbers and counts what is found.
    """
    lines = code_lines(texts, keys, may_matter)
    hits = F.filter(F.array(*[F.when(C.is_call(F.col("line"), n), F.lit(n)) for n, _ in K.PY_CALLS]), lambda x: x.isNotNull())
    hidden = C.py_obfuscation(F.col("line"))
    items = F.concat(F.transform(hits, lambda n: F.struct(F.lit("PY_DANGEROUS_CALL").alias("id"), n.alias("needle"))), F.when(hidden.isNotNull(), F.array(F.struct(F.lit("PY_OBFUSCATION").alias("id"), hidden.alias("needle")))).otherwise(F.array().cast("array<struct<id: string, needle: string>>")))
    long = lines.select(*keys, "line_no", "line", "module_level", F.posexplode(items).alias("_k", "item"))
    w = Window.partitionBy(*keys)
    found = long.withColumns({"ord": F.row_number().over(w.orderBy("line_no", "_k")), "_all": F.count(F.lit(1)).over(w)}).where(F.col("ord") <= most + 1)
    more = F.col("ord") > most
    severity = F.when(more | ((F.col("item.id") == "PY_DANGEROUS_CALL") & F.col("module_level")), "high").otherwise("medium")
    shown = F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), C.truncate(F.col("line"), 120))
    return found.select(
        *keys,
        "ord",
        F.when(more, "PY_DANGEROUS_CALL").otherwise(F.col("item.id")).alias("id"),
        severity.alias("severity"),
        F.when(more, "(more)").otherwise(F.col("item.needle")).alias("needle"),
        F.when(~more, F.col("line_no")).alias("line_no"),
        F.when(more, F.concat((F.col("_all") - most).cast("string"), F.lit(" more not listed"))).otherwise(shown).alias("evidence"),
    )


def regions(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Expressions and statements of templates: keys, ord, line (where they start), region; comments are left out."""
    part = r"(?s)\{\{.*?(?:\}\}|\z)|\{%.*?(?:%\}|\z)|\{#.*?(?:#\}|\z)"
    found = F.regexp_extract_all("text", F.lit(part), 0)
    gaps = F.split("text", part, -1)
    newlines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    walk = F.aggregate(
        F.arrays_zip(gaps.alias("g"), found.alias("m")),
        F.struct(F.lit(1).alias("line"), F.array().cast("array<struct<line: int, region: string>>").alias("out")),
        lambda a, x: F.struct(
            (a["line"] + newlines(x["g"]) + F.coalesce(newlines(x["m"]), F.lit(0))).alias("line"),
            F.when(x["m"].isNull() | x["m"].startswith("{#"), a["out"]).otherwise(F.concat(a["out"], F.array(F.struct((a["line"] + newlines(x["g"])).alias("line"), x["m"].alias("region"))))).alias("out"),
        ),
        lambda a: a["out"],
    )
    return texts.select(*keys, F.posexplode(walk).alias("ord", "r")).select(*keys, "ord", "r.line", "r.region")


def template_findings(found: DataFrame, keys: list[str], most: int = K.MAX_TEMPLATE) -> DataFrame:
    """Findings of template regions (keys, ord, line, region), one a region at most and ``most`` by keys.

    In order: names that reach into Python (high), pivots (medium), computed
    attributes (medium, high if also hidden), hidden names (medium).
    """
    r = F.col("region")
    gadgets = F.filter(F.array(*[F.when(C.has_token(r, g), F.lit(g)) for g in K.TEMPLATE_GADGETS]), lambda x: x.isNotNull())
    pivots = F.filter(F.array(*[F.when(C.has_token(r, g), F.lit(g)) for g in K.TEMPLATE_GLOBALS]), lambda x: x.isNotNull())
    dynamic = reduce(lambda c, d: c.when(r.contains(d), d), K.TEMPLATE_DYNAMIC[1:], F.when(r.contains(K.TEMPLATE_DYNAMIC[0]), K.TEMPLATE_DYNAMIC[0]))
    hidden = C.template_obfuscation(r)
    rows = found.withColumns({"_g": gadgets, "_p": pivots, "_d": F.trim(dynamic), "_h": hidden})
    rows = rows.withColumns(
        {
            "id": F.when(F.size("_g") > 0, "TEMPLATE_SANDBOX_ESCAPE").when(F.size("_p") > 0, "TEMPLATE_GADGET_GLOBAL").when(F.col("_d").isNotNull(), "TEMPLATE_DYNAMIC_ATTRIBUTE").when(F.col("_h").isNotNull(), "TEMPLATE_OBFUSCATION"),
            "severity": F.when(F.size("_g") > 0, "high").when(F.size("_p") > 0, "medium").when(F.col("_d").isNotNull() & F.col("_h").isNotNull(), "high").otherwise("medium"),
            "what": F.when(F.size("_g") > 0, F.array_join("_g", ", ")).when(F.size("_p") > 0, F.array_join("_p", ", ")).otherwise(F.coalesce("_d", "_h")),
        }
    ).where("id is not null")
    w = Window.partitionBy(*keys).orderBy("ord")
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= most).select(*keys, "ord", "line", "id", "severity", "what", C.truncate(F.trim(F.regexp_replace("region", r"\s+", " ")), 140).alias("evidence"))


def loader_entries(configs: DataFrame) -> DataFrame:
    """Entries (source, role, target, external, module) of auto_map and custom_pipelines in config texts (source, json)."""
    out = []
    for key in ("auto_map", "custom_pipelines"):
        roles = configs.select("source", F.explode(F.from_json(F.get_json_object("json", f"$.{key}"), "map<string,string>")).alias("role", "value"))
        many = F.from_json("value", "array<string>")
        out.append(roles.select("source", "role", F.explode(F.when(F.col("value").startswith("["), many).otherwise(F.array("value"))).alias("target")))
    both = out[0].union(out[1]).where("target is not null")
    return both.withColumns({"external": F.col("target").contains("--"), "module": C.local_module(F.col("target"))})


def referenced(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """Modules that loaders run: (module, n_refs, via) for local entries that have a module."""
    local = entries.where("module is not null").join(modules.select("module").distinct(), "module")
    return local.groupBy("module").agg(F.count(F.lit(1)).alias("n_refs"), F.min("source").alias("via"))


def unresolved(entries: DataFrame, modules: DataFrame) -> DataFrame:
    """Local entries whose module isn't there: (source, module, n_refs, roles)."""
    lost = entries.where("not external and module is not null").join(modules.select("module").distinct(), "module", "left_anti")
    return lost.groupBy("source", "module").agg(F.count(F.lit(1)).alias("n_refs"), F.array_sort(F.collect_list(F.concat("role", F.lit(" -> "), "target"))).alias("roles"))


def fingerprint(tensors: DataFrame, declared: DataFrame, keys: list[str]) -> DataFrame:
    """Naming scheme, family and contradiction of models from tensors (keys, name) and declared (keys, declared)."""
    n = F.col("name")
    has = lambda *parts: F.bool_or(reduce(lambda a, b: a | b, [n.contains(p) for p in parts]))
    scheme = F.when(has("blk."), "gguf-blk").when(has("model.layers."), "hf-llama").when(has("transformer.h.", "h."), "gpt2").otherwise("unknown")
    out = tensors.groupBy(*keys).agg(scheme.alias("scheme"), (F.max(C.layer_index(n)) + 1).alias("layer_count"))
    out = out.join(declared, keys, "left").withColumn("family", C.family(F.col("scheme"), F.col("declared")))
    bad = (F.col("scheme") != "unknown") & C.arch_mismatch(F.col("scheme"), F.col("declared"))
    return out.withColumn("finding", F.when(bad, "ARCH_MISMATCH").otherwise("ARCH_DETECTED"))
