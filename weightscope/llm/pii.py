"""Personal data by weak supervision, in DataFrame and SQL operations only.

Patterns find the base kinds. Further candidate spans (credentials, accounts,
names with capitals, addresses) are put to labelers (a pattern, a gazetteer,
the context and the make-up of the span) that vote for, against or abstain. Expectation-maximisation over the counts of vote patterns
estimates how reliable each labeler is; its posteriors train a naive Bayes
classifier over features of the span, which has the last word.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import boxed, stored

#: Base kinds, in the order that ties at one start take, and their patterns.
#: Each is the plain pattern made linear in Java: possessive where nothing that
#: follows could use what is given back, and started only where a match can
#: begin (at the start of a run, or where the last match ended).
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts that can't match are told apart before the pattern runs.
MAY_MATCH = {"email": "contains({t}, '@')", "ip": r"{t} rlike '[0-9][.][0-9]'", "card": r"{t} rlike '[0-9](?:[ -]?[0-9]){{11}}'", "phone": "contains({t}, '+')"}

#: Candidates beyond the base kinds: runs of letters, digits and signs with a digit in them.
CANDIDATE = r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{8,}+"
MAY_BE_CANDIDATE = r"{t} rlike '[0-9]'"
#: And what people write with blanks in it: accounts in groups of four, addresses, words with capitals in a row. Each
#: starts with a class of one character, which Java looks for fast.
_UP, _LOW = "[A-ZÀ-ÖØ-Þ]", "[a-zß-öø-ÿ]"
_DOTTED = "Mr|Mrs|Ms|Dr|Prof|Mme|Sr|Sra"  # after these a full stop ends no sentence
HUMAN = "|".join(
    (
        rf"[A-Z](?<![A-Za-z0-9].)[A-Z][0-9]{{2}}(?: [A-Z0-9]{{4}}){{2,7}}+(?: [A-Z0-9]{{1,3}}+)?+(?![A-Za-z0-9])",
        rf"[0-9](?<![A-Za-z0-9].)[0-9]{{0,4}}+(?: (?:{_UP}{_LOW}++ ){{1,3}}?(?:Street|St|Avenue|Ave|Road|Rd|Lane|Drive|Boulevard|Blvd|Court|Square|Way)|,? (?:rue|avenue|boulevard|place)(?: de| du| des| la| le)*+ {_UP}{_LOW}++)(?!{_LOW})",
        rf"{_UP}(?<!{_LOW}.)(?:{_LOW}+?(?:straße|strasse|weg|platz|allee|gasse)|(?<=C)alle(?: de| del| la)*+ {_UP}{_LOW}++,?|(?<=A)venida(?: de| del| la)*+ {_UP}{_LOW}++,?) [0-9]{{1,4}}+(?![A-Za-z0-9])",
        rf"{_UP}(?<!{_LOW}.){_LOW}++(?:(?<={_DOTTED})\.)?+ (?:{_UP}{_LOW}++(?:(?<={_DOTTED})\.)?+ ){{0,2}}{_UP}{_LOW}++",
    )
)
MAY_BE_HUMAN = " OR ".join(
    (
        *(f"{{t}} rlike '{r}'" for r in (f"{_UP}{_LOW}++ {_UP}", f"[0-9],? (?:rue|avenue|boulevard|place|{_UP})", "[eßgz] [0-9]", "[A-Z]{{2}}[0-9]{{2}} [A-Z0-9]{{4}}")),
        *(f"contains({{t}}, '{w}. ')" for w in _DOTTED.split("|")),
        *(f"contains({{t}}, '{w} ')" for w in ("Calle", "Avenida")),
    )
)
BEFORE = 32  # characters of context that the context labeler sees

#: How issued credentials begin.
ISSUED = ("AKIA", "ASIA", "AIza", "api_org_", "dckr_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "hf_", "sk-", "xoxb-", "xoxp-", "xoxa-", "xoxr-", "eyJ")
#: Names that look like candidates and are harmless.
HARMLESS = ("covid-19", "iso-8859-1", "iso-8859-15", "utf-16le", "utf-16be", "windows-1252", "base64url", "x86_64-linux")
#: Given names, a short list for each language of the corpus, and titles.
GIVEN = tuple(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Thomas Sarah Charles Karen Anna Hans Peter Wolfgang Klaus Jürgen Dieter"
    " Ursula Helga Monika Sabine Petra Karin Renate Stefan Andreas Pierre Jean Marie Michel Philippe Nathalie Isabelle Sylvie Catherine Françoise Nicolas José Antonio Manuel Francisco"
    " Juan Carmen María Ana Isabel Dolores Pilar Carlos Luis Miguel Javier Laura Lucía Emma Julia Paul Martin Daniel".split()
)
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra")
SECRET_CUE = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|private[_ -]?key|credential|auth|bearer|ssn|social security|iban|account|passport|licen[cs]e no)\W{0,4}(?:is|no|nr)?\W{0,4}$"
HARMLESS_CUE = r"(?i)(?:version|commit|rev(?:ision)?|page|isbn|issn|doi|arxiv|https?:\S*|www\.\S*|build|chapter|section|figure|table|sha256|md5)\W{0,4}$"
PERSON_CUE = r"(?i)(?:name|named|called|contact|signed|sincerely|regards|dear|address|lives at|resides at|patient|adresse|anschrift|wohnhaft|nom|nombre|direcci[oó]n|domicilio)\W{0,4}(?:is|was|ist|est|es)?\W{0,4}$"
SHAPES = {
    "national_id": r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{1,4}){2,8})$",
    "address": r"^(?:[0-9]{1,5},? .+|.+ [0-9]{1,4})$",
    "person": rf"^(?:{_UP}{_LOW}+\.? )+{_UP}{_LOW}+$",
    "hex": r"^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$",
    "date": r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}(?:T[0-9]+)?|[0-9]{2}-[0-9]{2}-[0-9]{4}|[0-9]{4}/[0-9]{2}/[0-9]{2})$",
    "number": r"^[0-9+/=_-]+$",
    "word": r"^[A-Za-z]+[-_/]?[0-9]{1,4}$",
    "mixed": r"",
}
LABELERS = ("pattern", "gazetteer", "context", "make-up")
ROUNDS = 20  # of expectation-maximisation
#: What a labeler is taken for before its votes are seen: right so often, weighing as so many votes for each that it gave;
#: and how often it is right at the least. Candidates are taken to be harmless half of the time at least.
TRUSTED, TRUST, LEAST_TRUSTED = 0.85, 0.2, 0.7
ACCEPT = 0.9  # least probability of an added span


@dataclass(frozen=True)
class Model:
    """What was learnt: class weights of features, the prior's log odds, and labelers' accuracies."""

    weights: dict[str, float]
    prior: float
    accuracies: dict[str, float]


def _spans(text: str, pattern: str, may: str, kind: str) -> Column:
    """Array of struct(start, end, kind, value) of the matches in SQL expression ``text``.

    The gaps between matches come from splitting by the same pattern; adding up
    their lengths and the matches' gives the places in code points.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    empty = "CAST(array() AS array<struct<start: int, end: int, kind: string, value: string>>)"
    return F.expr(
        f"""CASE WHEN {may.format(t=text)} THEN aggregate(
            zip_with(split({text}, '{quoted}', -1), regexp_extract_all({text}, '{quoted}', 0), (g, m) -> struct(g, m)),
            struct(0 AS at, {empty} AS found),
            (a, x) -> struct(
              a.at + length(x.g) + coalesce(length(x.m), 0) AS at,
              CASE WHEN x.m IS NULL THEN a.found
                   ELSE concat(a.found, array(struct(a.at + length(x.g) AS start, a.at + length(x.g) + length(x.m) AS end, '{kind}' AS kind, x.m AS value))) END AS found),
            a -> a.found)
        ELSE {empty} END"""
    )


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, '[.]'), p -> length(trim(LEADING '0' FROM p)) <= 3 AND coalesce(try_cast(trim(LEADING '0' FROM p) AS int), 0) <= 255)",
    "card": f"""length({_DIGITS}) BETWEEN 12 AND 19 AND aggregate(
        zip_with(split(reverse({_DIGITS}), ''), sequence(1, length({_DIGITS})), (c, i) -> struct(CAST(c AS int) AS d, i AS i)), 0,
        (a, x) -> a + CASE WHEN x.d IS NULL OR x.i IS NULL THEN 0 WHEN x.i % 2 = 1 THEN x.d WHEN x.d > 4 THEN 2 * x.d - 9 ELSE 2 * x.d END) % 10 = 0""",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
}


def _base(text: str) -> Column:
    """Array of struct(start, k, end, kind) of valid base spans, by start, then kind as listed."""
    parts = [
        F.expr(f"transform(filter(_{kind}, s -> {_VALID[kind]}), s -> struct(s.start AS start, {k} AS k, s.end AS end, s.kind AS kind))") for k, kind in enumerate(KINDS)
    ]
    return F.array_sort(F.concat(*parts))


def _candidates(text: str) -> Column:
    """Candidates that overlap no base span, with votes and features."""
    listed = lambda values: "(" + ", ".join(f"'{v}'" for v in values) + ")"
    quote = lambda r: "'" + r.replace("\\", "\\\\").replace("'", "\\'") + "'"
    shape = "CASE " + " ".join(f"WHEN s.value rlike {quote(r)} THEN '{k}'" for k, r in SHAPES.items()) + " END"
    before = f"substring({text}, greatest(1, s.start - {BEFORE - 1}), least(s.start, {BEFORE}))"
    issued = " OR ".join(f"startswith(s.value, '{p}')" for p in ISSUED)
    words = "split(s.value, '[.]? ')"
    # The check number of an account: what stands first goes last, letters count from 10, and 97 leaves 1.
    moved = "regexp_replace(concat(substring(replace(s.value, ' ', ''), 5), substring(s.value, 1, 4)), '[^A-Z0-9]', '')"
    check = f"aggregate(split({moved}, ''), 0L, (a, c) -> CASE WHEN c = '' THEN a WHEN c >= 'A' THEN (a * 100 + ascii(c) - 55) % 97 ELSE (a * 10 + ascii(c) - 48) % 97 END) = 1"
    step = f"""transform(filter(_candidate, s -> NOT exists(_base, b -> b.start < s.end AND s.start < b.end)), s -> struct(
        s.start AS start, s.end AS end, s.value AS value, {shape} AS shape, ({issued}) AS issued,
        lower(s.value) IN {listed(HARMLESS)} AS harmless, {before} AS before, length(s.value) AS n, size(array_distinct(split(s.value, ''))) AS variety,
        exists({words}, w -> w IN {listed(GIVEN)}) AS given, exists({words}, w -> w IN {listed(TITLES)}) AS title, {check} AS checked))"""
    secret, harmless, person = (f"s.before rlike {quote(r)}" for r in (SECRET_CUE, HARMLESS_CUE, PERSON_CUE))
    human = "s.shape IN ('address', 'person')"
    votes = f"""transform({step}, s -> struct(
        s.start AS start, s.end AS end, s.shape AS shape,
        array(
          CASE WHEN s.shape IN ('national_id', 'hex', 'address') OR (s.shape = 'iban' AND s.checked) OR (s.shape = 'person' AND s.title) THEN 1
               WHEN s.shape IN ('date', 'number', 'word') THEN -1 ELSE 0 END,
          CASE WHEN s.issued OR (s.shape = 'person' AND s.given) THEN 1 WHEN s.harmless OR (s.shape = 'person' AND NOT s.title) THEN -1 ELSE 0 END,
          CASE WHEN {secret} OR ({human} AND {person}) THEN 1 WHEN {harmless} THEN -1 ELSE 0 END,
          CASE WHEN {human} THEN 0 WHEN s.n >= 20 AND s.variety >= 10 AND s.value rlike '[a-zA-Z]' THEN 1 WHEN s.n < 12 OR s.variety < 6 THEN -1 ELSE 0 END) AS votes,
        filter(array(
          CASE WHEN s.shape = 'person' THEN concat('person=', s.given, ',', s.title, ',', {person}) ELSE concat('shape=', s.shape) END,
          CASE WHEN NOT {human} THEN concat('length=', least(6, s.n DIV 8)) END, CASE WHEN NOT {human} THEN concat('variety=', least(5, s.variety DIV 4)) END,
          CASE WHEN s.shape <> 'person' THEN concat('cue=', CASE WHEN {secret} THEN 'secret' WHEN {human} AND {person} THEN 'person' WHEN {harmless} THEN 'harmless' ELSE 'none' END) END,
          CASE WHEN s.shape = 'iban' THEN concat('checked=', s.checked) END,
          concat('assigned=', s.before rlike '[=:]\\\\s*[\"\\']?$'), concat('issued=', s.issued)), f -> f IS NOT NULL) AS features))"""
    return F.expr(votes)


def extract(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_text`` (null as empty), ``_base`` and ``_cand``: names that its own columns mustn't have."""
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    found = {f"_{k}": _spans("_text", PATTERNS[k], MAY_MATCH[k], k) for k in KINDS}
    out = out.withColumns(found | {"_candidate": F.concat(_spans("_text", CANDIDATE, MAY_BE_CANDIDATE, "candidate"), _spans("_text", HUMAN, MAY_BE_HUMAN, "candidate"))})
    return out.withColumn("_base", _base("_text")).withColumn("_cand", _candidates("_text")).drop("_candidate", *found)


def fit(extracted: DataFrame) -> Model:
    """Learn from all candidates of all documents.

    They are counted by votes and features before anything moves: there are at
    most 3 to the number of labelers vote patterns and a fixed set of feature
    values, so what follows is small whatever the corpus. The counts are stored,
    so the corpus is read once. Without candidates the model accepts nothing.
    """
    counts = extracted.select(F.explode("_cand").alias("c")).groupBy("c.votes", "c.features").agg(F.count(F.lit(1)).cast("double").alias("n"))
    counts = stored(counts, "votes")
    # One row: the vote patterns with their counts, and the fold of ROUNDS steps over their posteriors.
    patterns = counts.groupBy("votes").agg(F.sum("n").alias("n")).agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("p"))
    start = "transform(p, x -> CASE WHEN aggregate(x.votes, 0, (a, v) -> a + v) > 0 THEN 0.9D WHEN aggregate(x.votes, 0, (a, v) -> a + v) < 0 THEN 0.1D ELSE 0.3D END)"
    total = "aggregate(zip_with(p, {r}, (x, w) -> x.n * {w}), 0D, (a, y) -> a + y)"
    yes, no = total.format(r="r", w="w"), total.format(r="r", w="(1 - w)")
    # A labeler's reliability is the share of its votes that agree with the posteriors, and of as many others as TRUST says
    # a share TRUSTED of good ones; one that abstains says nothing. Without the bounds, candidates that one labeler alone
    # has a word on would let the two classes run into one.
    right = "aggregate(zip_with(p, r, (x, w) -> x.n * CASE x.votes[{j}] WHEN 1 THEN w WHEN -1 THEN 1 - w ELSE 0D END), 0D, (a, y) -> a + y)"
    voted = "aggregate(p, 0D, (a, x) -> a + x.n * abs(x.votes[{j}]))"
    good = f"least(0.99D, greatest({LEAST_TRUSTED}D, ({right} + {TRUSTED} * ({TRUST} * {voted} + 2)) / ({1 + TRUST} * {voted} + 2)))"
    theta = f"struct(least(0D, ln(({yes} + 1) / ({no} + 1))) AS prior, transform(array({', '.join(good.format(j=j) for j in range(len(LABELERS)))}), g -> ln(g / (1 - g))) AS odds)"
    score = f"t.prior + aggregate(sequence(0, {len(LABELERS) - 1}), 0D, (a, j) -> a + x.votes[j] * t.odds[j])"
    step = f"transform(array({theta}), t -> transform(p, x -> 1 / (1 + exp(-({score})))))[0]"
    learnt = patterns.select("p", F.expr(f"aggregate(sequence(1, {ROUNDS}), {start}, (r, i) -> {step})").alias("r"))
    posterior = learnt.select(F.explode(F.expr("zip_with(p, r, (x, w) -> struct(x.votes AS votes, x.n AS n, w AS w))")).alias("y")).select("y.votes", "y.n", "y.w")
    totals = posterior.agg(F.sum(F.col("n") * F.col("w")).alias("yes"), F.sum(F.col("n") * (1 - F.col("w"))).alias("no")).first()
    if totals["yes"] is None:
        return Model({}, -math.inf, {})
    soft = counts.join(posterior.select("votes", "w"), "votes").select(F.explode("features").alias("f"), (F.col("n") * F.col("w")).alias("y"), (F.col("n") * (1 - F.col("w"))).alias("z"))
    weights = {r["f"]: math.log(((r["y"] + 1) / (totals["yes"] + 8)) / ((r["z"] + 1) / (totals["no"] + 8))) for r in soft.groupBy("f").agg(F.sum("y").alias("y"), F.sum("z").alias("z")).collect()}
    right = [
        F.sum(F.when(F.col("votes")[j] == 1, F.col("n") * F.col("w")).when(F.col("votes")[j] == -1, F.col("n") * (1 - F.col("w")))) / F.sum(F.when(F.col("votes")[j] != 0, F.col("n")))
        for j in range(len(LABELERS))
    ]
    accuracies = dict(zip(LABELERS, posterior.agg(*[r.alias(str(j)) for j, r in enumerate(right)]).first(), strict=True))
    return Model(weights, min(0.0, math.log((totals["yes"] + 1) / (totals["no"] + 1))), accuracies)


def detect(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with a column ``spans``: array of struct(start, k, end, kind, base).

    ``docs`` needs ``text``; all other columns stay, except that one called
    ``spans`` is replaced. Spans are by start, then kind as listed; start and
    end are code points, end exclusive; ``base`` tells pattern spans from the
    classifier's, which never overlap them. A null text counts as empty and has
    none; equal rows give equal rows; an empty table gives an empty one. With a
    ``model`` that is one pass; without, another pass before it fits one. Texts
    never move.
    """
    kept = docs.drop("spans")
    inner, text = boxed(kept)
    extracted = extract(inner, text)
    return classify(extracted, model or fit(extracted)).select(*inner.columns, "spans").toDF(*kept.columns, "spans")


def classify(extracted: DataFrame, model: Model) -> DataFrame:
    """``extracted`` (of ``extract``) with ``spans``, by the classifier's word."""
    least = math.log(ACCEPT / (1 - ACCEPT))
    base = F.expr("transform(_base, b -> struct(b.start AS start, b.k AS k, b.end AS end, b.kind AS kind, true AS base))")
    if not model.weights:
        return extracted.withColumn("spans", base)
    weigh = reduce(lambda a, kv: f"{a} WHEN '{kv[0]}' THEN {kv[1]!r}D", sorted(model.weights.items()), "CASE f")
    good = f"{model.prior!r}D + aggregate(c.features, 0D, (a, f) -> a + {weigh} ELSE 0D END) >= {least!r}D"
    kind = "CASE WHEN c.shape IN ('national_id', 'iban', 'address', 'person') THEN c.shape ELSE 'secret' END"
    added = F.expr(f"transform(filter(_cand, c -> {good}), c -> struct(c.start AS start, {len(KINDS)} AS k, c.end AS end, {kind} AS kind, false AS base))")
    return extracted.withColumn("spans", F.array_sort(F.concat(base, added)))


def _listed(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each row of ``detect``."""
    counts = [F.expr(f"CAST(size(filter(spans, s -> s.base AND s.kind = '{k}')) AS bigint)").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(_listed("filter(spans, s -> s.base)"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets.

    Where spans overlap, the replaced stretch ends with the last of them and
    takes the first one's kind. Columns and rows are else as they were, a null
    text stays null.
    """
    inner, text = boxed(docs)
    extracted = extract(inner, text)
    found = classify(extracted, model or fit(extracted))
    clean = F.expr(
        f"""aggregate(spans, struct(0 AS at, CAST('' AS string) AS out),
             (a, s) -> CASE WHEN s.start < a.at THEN struct(greatest(a.at, s.end) AS at, a.out AS out)
                            ELSE struct(s.end AS at, concat(a.out, substring({text}, a.at + 1, s.start - a.at), '[', upper(s.kind), ']') AS out) END,
             a -> concat(a.out, substring({text}, a.at + 1)))"""
    )
    return found.withColumn(text, F.when(F.size("spans") == 0, F.col(text)).otherwise(clean)).select(*inner.columns).toDF(*docs.columns)
