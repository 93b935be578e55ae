"""Scalar functions over Spark columns; all of them built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weightscope import constants as K


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def layer_index(name: Column) -> Column:
    """The layer that a tensor name says it is in; null if none."""
    found = F.regexp_extract(name, r"(?:^|\.)(?:layers|h|blk|block|layer)\.(\d+)(?:\.|$)", 1)
    return F.nullif(found, F.lit("")).try_cast("bigint")


def canonical_name(name: Column) -> Column:
    """A tensor name without wrapper prefixes."""
    return F.regexp_replace(name, r"^(?:(?:transformer|model|module|_orig_mod)\.)+", "")


def detect_format(head_hex: Column, path: Column) -> Column:
    """The container format by leading bytes (hex, lower case), then extension, then shape."""
    ext = extension(path)
    by_ext = (
        F.when(ext == "safetensors", "safetensors")
        .when(ext == "gguf", "gguf")
        .when(ext.isin("bin", "pt", "pth", "ckpt", "pkl", "pickle"), "pickle")
    )
    # Little-endian length in the first 8 bytes: 0 < n < 2^32, then an opening brace.
    shape = (F.length(head_hex) >= 18) & (F.substring(head_hex, 9, 8) == "00000000") & (F.substring(head_hex, 1, 8) != "00000000") & (F.substring(head_hex, 17, 2) == "7b")
    return (
        F.when(head_hex.startswith("47475546"), "gguf")
        .when(head_hex.startswith("504b0304"), "pickle")
        .when(head_hex.startswith("80"), "pickle")
        .otherwise(F.coalesce(by_ext, F.when(shape, "safetensors"), F.lit("unknown")))
    )


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, lower case; '' if nothing does."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def is_candidate(path: Column) -> Column:
    """Does the extension say that a file is a model artifact?"""
    return extension(path).isin(*K.EXTENSIONS)


def identify(head_hex: Column) -> Column:
    """What leading bytes (hex, lower case) begin; null if nothing known."""
    return reduce(lambda c, m: c.when(head_hex.startswith(m[0]), m[1]), K.MAGICS[1:], F.when(head_hex.startswith(K.MAGICS[0][0]), K.MAGICS[0][1]))


def urls(text: Column) -> Column:
    """Distinct URLs in a text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[^\s\"'<)]*"), 0)))


def tokens(text: Column) -> Column:
    """Runs of token characters of length 8 at least."""
    return F.filter(F.split(text, r"[^A-Za-z0-9_+/=-]"), lambda x: F.length(x) >= 8)


def shannon_entropy(text: Column) -> Column:
    """Bits a character of a text; 0 if empty."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.length(text)
    # Each distinct character is counted by taking it away: one pass, not a look at every pair.
    counts = F.transform(F.array_distinct(chars), lambda c: (n - F.length(F.replace(text, c, F.lit("")))).cast("double"))
    return F.aggregate(counts, F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))


def secret_label(token: Column) -> tuple[Column, Column]:
    """Label and confidence of a token, by the first rule that fits; null if none does. Both are fields of one expression."""
    found = F
    for name, prefixes, least, exact, rest, sure in K.SECRET_RULES:
        # The rest's make-up is checked after whichever prefix it has.
        fits = _any(token.rlike(f"^{re.escape(p)}{rest}*$") if rest else token.startswith(p) for p in prefixes)
        if least:
            fits &= F.length(token) >= least
        if exact:
            fits &= F.length(token) == exact
        found = found.when(fits, F.struct(F.lit(name).alias("label"), F.lit(sure).alias("conf")))
    name, least, bits, sure = K.GENERIC_SECRET
    plain = (F.length(token) >= least) & token.rlike(r"^[A-Za-z0-9_+/=-]+$") & (shannon_entropy(token) > bits)
    found = found.when(plain, F.struct(F.lit(name).alias("label"), F.lit(sure).alias("conf")))
    return found["label"], found["conf"]


def redact(token: Column) -> Column:
    """A token's ends only."""
    n = F.length(token)
    return F.when(n <= 8, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.substring(token, 1, 4), F.lit("…"), F.right(token, F.lit(2)), F.lit(" ("), n.cast("string"), F.lit(" chars)")))


def truncate(text: Column, most: int) -> Column:
    """At most ``most`` characters, and an ellipsis if that cuts."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def is_call(line: Column, needle: str) -> Column:
    """Is ``needle`` in a line with no name or attribute right before it?"""
    return line.rlike(r"(^|[^A-Za-z0-9_.])" + re.escape(needle))


def has_token(text: Column, needle: str) -> Column:
    """Is ``needle`` in a text with no name character right before it?"""
    return text.rlike(r"(^|[^A-Za-z0-9_])" + re.escape(needle))


def py_obfuscation(line: Column) -> Column:
    """How a line of Python hides what it does; null if it doesn't."""
    literals = F.filter(F.transform(F.split(line, "[\"']"), lambda x, i: F.when(i % 2 == 1, x)), lambda x: x.isNotNull())
    return F.when(F.regexp_count(line, F.lit(r"\\x")) >= 12, "many hex escapes").when(F.exists(literals, lambda x: x.rlike("^[A-Za-z0-9+/=]{200,}$")), "a long encoded literal")


def template_obfuscation(text: Column) -> Column:
    """How a template region hides a name; null if it doesn't."""
    compact = F.regexp_replace(text, r"\s", "")
    split = _any(compact.contains(s) for s in ("'+'", "'~'", '"+"', '"~"')) & compact.contains("__")
    return (
        F.when(text.contains("chr("), "character codes")
        .when(F.regexp_count(text, F.lit(r"\\x")) >= 4, "hex escapes")
        .when(split, "a name in pieces")
        .when(compact.contains("|join") & compact.contains("__"), "a joined name")
    )


def is_dangerous_global(module: Column, name: Column) -> Column:
    """Does a pickle global run code or reach the system?"""
    root = F.split(module, r"\.")[0]
    return root.isin(*K.DANGEROUS_MODULES) | (root.isin("builtins", "__builtin__") & name.isin(*K.DANGEROUS_BUILTINS))


def local_module(target: Column) -> Column:
    """The module of a loader target: what stands before the last dot; null if none."""
    return F.nullif(F.regexp_extract(target, r"^(.*)\.[^.]*$", 1), F.lit(""))


def family(scheme: Column, declared: Column) -> Column:
    """Architecture family from the naming scheme and what is declared."""
    low = F.lower(declared)
    llama = reduce(lambda c, n: c.when(low.contains(n), n), ("mistral", "gemma", "phi", "llama"), F.when(low.contains("qwen"), "qwen"))
    return F.when(scheme.isin("hf-llama", "gguf-blk"), F.coalesce(llama, F.lit("llama-family"))).when(scheme == "gpt2", "gpt2")


def arch_mismatch(scheme: Column, declared: Column) -> Column:
    """Does the declared architecture contradict the naming scheme?"""
    low = F.lower(declared)
    gpt2 = low.contains("gpt2") | low.contains("gpt-2")
    return F.coalesce(((scheme == "gpt2") & (declared != "") & ~gpt2) | (scheme.isin("hf-llama", "gguf-blk") & (gpt2 | low.contains("bert"))), F.lit(False))


def severity_rank(name: Column) -> Column:
    """0 for info to 4 for critical, whatever the case and blanks; null for anything else."""
    low = F.lower(F.trim(name))
    return reduce(lambda c, s: c.when(low == s, K.RANK[s]), K.SEVERITIES, F.when(F.lit(False), 0))


def severity_name(rank: Column) -> Column:
    """The name of a severity rank."""
    return F.element_at(F.array(*map(F.lit, K.SEVERITIES)), rank.cast("int") + 1)


#: Units of sizes, each 1024 of the one before.
UNITS = ("KiB", "MiB", "GiB", "TiB")


def human_size(n: Column, units: tuple[str, ...] = UNITS) -> Column:
    """Bytes (a long, not negative) in IEC units with one decimal; the last of ``units`` has no end.

    A size halfway between two decimals gets the even one, as C and Rust print it.
    """
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    near = n.cast("double").cast("bigint")  # what a division in doubles starts from
    for k, unit in enumerate(units, 1):
        one = 1024**k
        tenths = F.pmod(near, F.lit(one)) * 10
        down = F.shiftright(tenths, 10 * k)
        rest = F.pmod(tenths, F.lit(one))
        up = (rest > one // 2) | ((rest == one // 2) & (down % 2 == 1))
        digit = down + F.when(up, 1).otherwise(0)
        text = F.concat((F.shiftright(near, 10 * k) + F.when(digit == 10, 1).otherwise(0)).cast("string"), F.lit("."), (digit % 10).cast("string"), F.lit(f" {unit}"))
        out = out.when(n < 1024 ** (k + 1), text) if unit != units[-1] else out.otherwise(text)
    return out


def human_duration(ms: Column) -> Column:
    """Milliseconds below a second, else seconds with two decimals."""
    return F.when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", ms / 1000))


def align_up(v: Column, to: Column) -> Column:
    """The next multiple of ``to``."""
    return F.when(to <= 0, v).otherwise(F.ceil(v / to) * to)


def product(shape: Column) -> Column:
    """Elements of a shape, capped at what a long holds."""
    return F.aggregate(shape, F.lit(1).cast("double"), lambda a, x: a * x)


def spark_bar(values: Column) -> Column:
    """An array of numbers as one character each, lowest to highest; all lowest if flat."""
    low, high = F.array_min(values), F.array_max(values)
    blocks = F.array(*[F.lit(c) for c in "▁▂▃▄▅▆▇█"])
    step = lambda v: F.when(high > low, F.round((v - low) / (high - low) * 7)).otherwise(F.lit(0.0))
    return F.array_join(F.transform(values, lambda v: F.element_at(blocks, 1 + step(v).cast("int"))), "")
