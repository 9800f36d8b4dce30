"""Personal data: spans by fixed rules, and further ones that boosted trees choose among generated candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.trees import ensemble, ensemble_sql
from gridloom.llm.common import text_of, without, written

#: In the order of the contract; a kind's number is its place.
KINDS = ("email", "ip", "card", "phone")
OUT = (*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added")

# The base patterns. Each begins where no match could have begun earlier and never gives back what it
# took, which finds the same spans as the plain patterns, in time linear in the text.
BASE = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"@"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]\.[0-9]"),
    ("card", r"(?=[0-9])(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])", r"[0-9]"),
    ("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
)
_AT = r"(?:@| ?[\[({<] ?(?:at|@) ?[\])}>] ?| (?:at|@) )"
_DOT = r"(?:\.| ?[\[({<] ?(?:dot|\.) ?[\])}>] ?| (?:dot|\.) )"
#: High-recall generators: what looks at all like a span of the kind, disguised forms included. Each has a cheap test for
#: texts that cannot hold one.
GENERATORS = (
    ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{{1,64}}+{_AT}[a-z0-9-]{{1,63}}+(?:{_DOT}[a-z0-9-]{{1,63}}+)++", r"(?i)@|[ \[({<]at[ \])}>]"),
    ("ip", rf"(?i)(?=[0-9])(?<![0-9a-z.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}+(?![0-9a-z])", r"[0-9]"),
    ("ip", r"(?i)(?=[0-9a-f:])(?<![0-9a-z:.])[0-9a-f]{0,4}+(?::[0-9a-f]{0,4}+){2,7}+(?![0-9a-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    ("card", r"(?=[0-9])(?<![0-9])(?<![0-9][ ._/-])[0-9](?:[ ._/-]{0,2}+[0-9]){11,18}+(?![0-9])", r"[0-9]"),
    ("phone", r"(?=[+(0-9])(?<![0-9A-Za-z_.])[+(]?[0-9](?:[ ()./-]{0,3}+[0-9]){6,14}+(?![0-9A-Za-z])", r"[0-9]"),
)
AROUND = 40  # characters of context on either side

# Words of the context that speak for a kind, or against all.
LEADS = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|correo|courriel|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|client|login|logged)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|telephone|phone|call|mobile|cell|fax|sms|whatsapp|dial|telefon|handy|tél|móvil)\b",
    "none": r"(?i)\b(?:version|isbn|order|invoice|ref|page|pages|chapter|section|token|key|hash|sha|md5|ratio|score|date|time|total|id)\b",
}
_COUNT = "CAST(length(x.v) - length(regexp_replace(x.v, '{}', '')) AS DOUBLE)"
_HIT = "CAST(x.{} RLIKE '{}' AS INT)"
#: Features of a candidate x: kind number k, value v, digits d, groups of digits g, context before b and after a.
FEATURES: tuple[tuple[str, str], ...] = (
    ("is_email", "CAST(x.k = 0 AS INT)"), ("is_ip", "CAST(x.k = 1 AS INT)"), ("is_card", "CAST(x.k = 2 AS INT)"), ("is_phone", "CAST(x.k = 3 AS INT)"),
    ("chars", "length(x.v)"), ("digits", "length(x.d)"), ("letters", _COUNT.format("[A-Za-z]")), ("spaces", _COUNT.format(" ")), ("dots", _COUNT.format("[.]")),
    ("hyphens", _COUNT.format("-")), ("brackets", _COUNT.format(r"[\\[\\](){}<>]")), ("colons", _COUNT.format(":")), ("slashes", _COUNT.format("[/_]")),
    ("plus", "CAST(x.v LIKE '+%' AS INT)"), ("double_zero", "CAST(x.v LIKE '00%' AS INT)"), ("lead_zero", "CAST(x.v RLIKE '^[(]?0[1-9]' AS INT)"), ("empty_group", "CAST(x.v LIKE '%::%' AS INT)"),
    ("at_sign", "CAST(x.v LIKE '%@%' AS INT)"), ("at_bracket", r"CAST(x.v RLIKE '(?i)[\\[({<] ?(?:at|@) ?[\\])}>]' AS INT)"), ("at_word", "CAST(x.v RLIKE '(?i) at ' AS INT)"),
    ("dot_bracket", r"CAST(x.v RLIKE '(?i)[\\[({<] ?(?:dot|[.]) ?[\\])}>]' AS INT)"), ("dot_word", "CAST(x.v RLIKE '(?i) dot ' AS INT)"), ("dot_spaced", "CAST(x.v LIKE '% . %' AS INT)"),
    ("tail_letters", "length(regexp_extract(x.v, '([A-Za-z]*)$', 1))"), ("tail_known", "CAST(x.v RLIKE '(?i)[^a-z](?:com|org|net|edu|gov|info|io|de|fr|es|uk|eu|co|it|nl|ch|at)$' AS INT)"),
    ("luhn", "CAST(coalesce({luhn}, false) AS INT)"), ("groups", "size(x.g)"), ("longest", "coalesce(array_max(transform(x.g, y -> length(y))), 0)"), ("shortest", "coalesce(array_min(transform(x.g, y -> length(y))), 0)"),
    ("first", "coalesce(length(get(x.g, 0)), 0)"), ("last", "coalesce(length(get(x.g, size(x.g) - 1)), 0)"), ("octets", "CAST(forall(x.g, y -> length(y) <= 3 AND CAST(y AS INT) <= 255) AS INT)"),
    ("distinct", "size(array_distinct(split(x.d, '')))"), ("year", r"CAST(x.v RLIKE '(?:^|[^0-9])(?:19|20)[0-9]{2}(?:[^0-9]|$)' AS INT)"), ("issuer", "CAST(x.d RLIKE '^[3-6]' AS INT)"),
    ("word_before", "CAST(x.b RLIKE '[A-Za-z0-9]$' AS INT)"), ("mark_before", r"CAST(x.b RLIKE '[=:#\"/_.-]$' AS INT)"), ("word_after", "CAST(x.a RLIKE '^[A-Za-z0-9]' AS INT)"), ("mark_after", r"CAST(x.a RLIKE '^[=:#\"/_-]' AS INT)"),
    *((f"lead_{k}", _HIT.format("b", p.replace("\\", "\\\\"))) for k, p in LEADS.items()),
)
_LUHN = "length({d}) BETWEEN 12 AND 19 AND aggregate(transform(sequence(1, length({d})), i -> CAST(substring({d}, -i, 1) AS INT) * IF(i % 2 = 0, 2, 1)), 0, (s, y) -> s + IF(y > 9, y - 9, y)) % 10 = 0"


def luhn(digits: str) -> str:
    """SQL: 12 to 19 digits whose Luhn sum ends in 0."""
    return _LUHN.format(d=digits)


def _sql(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def _before(sizes: str, blocks: str) -> str:
    """SQL: for each element of ``sizes`` the sum of those before it; ``blocks`` holds the sums before each 256 of them."""
    part = f"aggregate(slice({sizes}, (i DIV 256) * 256 + 1, i % 256), 0, (s, y) -> s + y)"
    return f"transform({sizes}, (z, i) -> {blocks}[i DIV 256] + {part})"


def _held(x: Column) -> Column:
    """``x``, but not deterministic to the optimizer: a filter above must not be pushed below the search, where every step
    would be spelled out again in full for each mention."""
    return F.when(F.monotonically_increasing_id() >= 0, x)


def find(df: DataFrame, text: str, patterns: Sequence[tuple[str, str, str]], prefix: str) -> DataFrame:
    """Add {prefix}0, {prefix}1, ...: for each (kind, pattern, test) the non-overlapping matches of the whole text, left to right, as
    array<struct<k, s, e, v, b, a>>: kind's number, start and end in code points, the match, and AROUND characters on
    either side. A text that fails ``test`` is not searched.

    Matches alternate with the pieces that a split leaves, so positions are sums of lengths: by blocks of 256, in
    time nearly linear in the matches.
    """
    names = df.columns
    kinds = [KINDS.index(k) for k, _, _ in patterns]
    n = range(len(patterns))
    df = df.withColumns({f"_m{i}": F.expr(f"CASE WHEN `{text}` RLIKE '{_sql(t)}' THEN regexp_extract_all(`{text}`, '{_sql(p)}', 0) ELSE array() END") for i, (_, p, t) in zip(n, patterns, strict=True)})
    df = df.withColumns({f"_p{i}": F.expr(f"CASE WHEN size(_m{i}) > 0 THEN split(`{text}`, '{_sql(p)}', -1) ELSE array() END") for i, (_, p, _) in zip(n, patterns, strict=True)})
    df = df.withColumns({f"_l{i}": F.expr(f"transform(_m{i}, (v, i) -> length(_p{i}[i]) + length(v))") for i in n})
    df = df.withColumns({f"_t{i}": F.expr(f"CASE WHEN size(_l{i}) > 0 THEN transform(sequence(0, (size(_l{i}) - 1) DIV 256), j -> aggregate(slice(_l{i}, j * 256 + 1, 256), 0, (s, y) -> s + y)) ELSE array() END") for i in n})
    df = df.withColumns({f"_b{i}": F.expr(f"transform(_t{i}, (z, j) -> aggregate(slice(_t{i}, 1, j), 0, (s, y) -> s + y))") for i in n})
    # The second mention of an array keeps the optimizer from moving its making into the loop over it.
    df = df.withColumns({f"_s{i}": F.expr(f"CASE WHEN size(_b{i}) > 0 THEN {_before(f'_l{i}', f'_b{i}')} ELSE array() END") for i in n})
    row = "named_struct('k', {k}, 's', _s{i}[i] + length(_p{i}[i]), 'e', _s{i}[i] + length(_p{i}[i]) + length(v), 'v', v, 'b', right(_p{i}[i], {c}), 'a', left(_p{i}[i + 1], {c}))"
    return df.select(*[f"`{c}`" for c in names], *[F.expr(f"CASE WHEN size(_s{i}) > 0 AND size(_p{i}) > 0 THEN transform(_m{i}, (v, i) -> {row.format(i=i, k=k, c=AROUND)}) ELSE array() END").alias(f"{prefix}{i}") for i, k in zip(n, kinds, strict=True)])


def base_spans(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array<struct<s, k, e>> of the base rules' spans, by start, then kind.

    Parts of an address are 255 at most; cards have 12 to 19 digits and a right Luhn sum, phones 9 to 15 digits. A match
    that fails is dropped and not tried again.
    """
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    digits = "regexp_replace(x.v, '[^0-9]', '')"
    good = {"email": "true", "ip": rf"x.v RLIKE '^(?:{octet}\\.){{3}}{octet}$'", "card": luhn(digits), "phone": f"length({digits}) BETWEEN 9 AND 15"}
    found = find(df, text, BASE, "_gl_base")
    kept = [f"transform(filter(_gl_base{i}, x -> {good[k]}), x -> named_struct('s', x.s, 'k', x.k, 'e', x.e))" for i, (k, _, _) in enumerate(BASE)]
    return found.withColumn(out, _held(F.expr(f"sort_array(concat({', '.join(kept)}))"))).drop(*[f"_gl_base{i}" for i in range(len(BASE))])


def candidates(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: array of the generators' candidates, overlapping ones included, with their features (FEATURES, doubles)."""
    df = find(df, text, GENERATORS, "_gl_gen")
    parts = [f"_gl_gen{i}" for i in range(len(GENERATORS))]
    df = df.withColumn("_gl_all", F.expr(f"transform(concat({', '.join(parts)}), x -> named_struct('k', x.k, 's', x.s, 'e', x.e, 'v', x.v, 'b', x.b, 'a', x.a, 'd', regexp_replace(x.v, '[^0-9]', ''), 'g', regexp_extract_all(x.v, '[0-9]+', 0)))")).drop(*parts)
    values = ", ".join(f"'{name}', CAST({sql.replace('{luhn}', luhn('x.d'))} AS DOUBLE)" for name, sql in FEATURES)
    return df.withColumn(out, _held(F.expr(f"transform(_gl_all, x -> named_struct('k', x.k, 's', x.s, 'e', x.e, {values}))"))).drop("_gl_all")


@dataclass(frozen=True)
class PiiModel:
    """``margin``: SQL of the trees' sum over a candidate x; a candidate of kind k counts from ``bars[k]`` on.

    Bars come from Platt scaling on held-out candidates; ``recall`` and ``precision`` by kind are measured on these.
    """

    margin: str
    bars: tuple[float, ...]
    recall: tuple[float, ...]
    precision: tuple[float, ...]


def _number(salt: int, below: int) -> Column:
    return F.pmod(F.xxhash64("i", F.lit(salt)), F.lit(below))


def _digits(salt: int, n: int, low: int = 0) -> Column:
    """n digits made of the row's hash, the first at least ``low``."""
    first = (_number(salt, 10 - low) + low).cast("string")
    return first if n == 1 else F.concat(first, F.lpad(_number(salt + 1, 10 ** (n - 1)).cast("string"), n - 1, "0"))


def _renderings() -> list[tuple[int, int, Column]]:
    """(label, kind, text): forms of personal data (label 1) and of what is often taken for it (0), made of the row's hash
    and of words of its context (w1, w2, w3)."""
    w1, w2, w3 = F.col("w1"), F.col("w2"), F.col("w3")
    cap = F.initcap("w3")
    tld = F.element_at(F.array(*[F.lit(x) for x in ("com", "org", "net", "de", "fr", "es", "info", "co")]), (_number(1, 8) + 1).cast("int"))
    a, b, c, d = (_digits(10 + 3 * k, 3, 2) for k in range(4))
    octets = [_number(30 + k, 256).cast("string") for k in range(4)]
    body = F.concat((_number(40, 4) + 3).cast("string"), _digits(41, 14))  # 15 digits of a card
    total = F.expr("aggregate(transform(sequence(1, length(body)), i -> CAST(substring(body, -i, 1) AS INT) * IF(i % 2 = 1, 2, 1)), 0, (s, y) -> s + IF(y > 9, y - 9, y))")
    good = F.concat(F.col("body"), F.pmod(-total, F.lit(10)).cast("string"))
    bad = F.concat(F.col("body"), F.pmod(-total + 1 + _number(43, 8), F.lit(10)).cast("string"))
    fours = lambda x, sep: F.regexp_replace(x, "([0-9]{4})(?=[0-9])", f"$1{sep}")
    hexes = F.lower(F.hex(F.xxhash64("i", F.lit(50))))
    v6 = [F.substring(F.md5(F.concat(F.lit("v6"), F.col("i").cast("string"))), 1 + 4 * k, 4) for k in range(8)]
    name = F.element_at(F.array(w1, F.concat(w1, F.lit("."), w2), F.concat(w1, F.lit("_"), _digits(60, 2)), F.concat(w1, _digits(62, 2))), (_number(64, 4) + 1).cast("int"))
    date = F.concat_ws("-", F.concat(F.lit("20"), _digits(70, 2)), F.lpad((_number(72, 12) + 1).cast("string"), 2, "0"), F.lpad((_number(73, 28) + 1).cast("string"), 2, "0"))
    join = lambda sep, *x: F.concat_ws(sep, *x)
    L = F.lit
    emails = [F.concat(name, L(at), w2, L(dot), tld) for at, dot in (("@", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "."), ("(at)", "(dot)"), (" at ", " dot "), ("@", " dot "), (" @ ", " . "), (" {at} ", "."), (" <at> ", " <dot> "))]
    phones = [
        F.concat(L("+"), _digits(80, 1, 1), L(" ("), a, L(") "), b, L("-"), _digits(82, 4)), F.concat(L("("), a, L(") "), b, L("-"), _digits(82, 4)), join("-", a, b, _digits(82, 4)), join(".", a, b, _digits(82, 4)),
        F.concat(L("+"), _digits(84, 2, 1), L(" "), a, L(" "), _digits(86, 7)), F.concat(L("00"), _digits(84, 2, 1), L(" "), a, L(" "), _digits(86, 7)), F.concat(L("0"), a, L("/"), _digits(86, 7)), F.concat(L("0"), a, L(" "), _digits(86, 7)),
        join(" ", a, b, _digits(82, 4)), F.concat(L("0"), a, L("-"), _digits(86, 6)),
    ]
    cards = [good, fours(good, " "), fours(good, "-"), fours(good, "."), fours(good, "_"), fours(good, "  ")]
    ips = [join(".", *octets), join("[.]", *octets), join(" dot ", *octets), join("(.)", *octets), join("(dot)", *octets), join(":", *v6), F.concat(v6[0], L(":"), v6[1], L("::"), v6[2]), F.concat(L("2001:db8::"), v6[3], L(":"), v6[4])]
    no_email = [F.concat(w1, L(" at "), w2, L("."), cap), F.concat(w1, L(" at "), w2, L(" . "), cap), F.concat(w1, L(" at "), w2, L("."), w3), F.concat(w1, L(" (at) "), w2, L(". "), cap), F.concat(w1, L(" at "), w2, L("..."), w3)]
    no_phone = [date, F.concat(date, L(" "), _digits(74, 2), L("-"), _digits(76, 2)), F.concat(F.substring(date, 9, 2), L("."), F.substring(date, 6, 2), L("."), F.substring(date, 1, 4)), join(" ", _digits(78, 1, 1), a, b, c), _digits(90, 8, 1), _digits(90, 10, 1), F.concat(_digits(78, 1), L("."), _digits(90, 9)), F.concat(a, L("-"), b, L(" "), c), join("/", a, b, c), hexes, _digits(90, 7, 1), F.concat(a, L(" - "), b, L(" - "), c)]
    no_card = [bad, fours(bad, " "), fours(bad, "-"), fours(bad, "."), _digits(92, 13, 1), F.concat(_digits(92, 13, 1), L("."), _digits(94, 3)), F.concat(hexes, _digits(92, 14), hexes)]
    no_ip = [join(".", _digits(96, 3, 3), *octets[1:]), join(".", *octets[:3], _digits(96, 3, 3)), join(":", _digits(98, 2), _digits(100, 2), _digits(102, 2)), join(":", *[F.substring(v, 1, 2) for v in v6[:6]]), F.concat(a, L(":"), b, L(":"), c), F.concat(w1, L("::"), w2), join(" dot ", _digits(96, 3, 3), *octets[1:])]
    made = [*((1, 0, x) for x in emails), *((1, 1, x) for x in ips), *((1, 2, x) for x in cards), *((1, 3, x) for x in phones)]
    return made + [*((0, 0, x) for x in no_email), *((0, 1, x) for x in no_ip), *((0, 2, x) for x in no_card), *((0, 3, x) for x in no_phone)]


def training_rows(docs: DataFrame, text_col: str = "text", *, texts: int = 2_000, each: int = 12) -> DataFrame:
    """Labelled candidates, written: columns of FEATURES, ``k``, ``label`` (double) and ``held`` (held out).

    From the ``texts`` distinct texts with the smallest hashes: (1) their own candidates, labelled by the base rules (a span that
    a base rule finds is one, others are not); (2) ``each`` short passages of every text around a planted form of
    ``_renderings``, some behind a leading word; the candidate that is exactly the planted span has its label, others that
    overlap a true one teach nothing, the rest are negative. So disguised forms are learnt in the corpus's own words.
    """
    rows = docs.select(text_of(text_col).alias("t")).where(F.length("t") > 0).withColumn("h", F.xxhash64(F.lit(11), "t"))
    keys = rows.select("h").distinct().orderBy("h").limit(texts)
    some = written(rows.join(F.broadcast(keys), "h", "left_semi").groupBy("h").agg(F.first("t").alias("t")), "sample")
    own = base_spans(candidates(some, "t", "c"), "t", "s").select(F.explode_outer("c").alias("c"), "s").where("c IS NOT NULL")
    same = F.exists("s", lambda y: (y["s"] == F.col("c.s")) & (y["e"] == F.col("c.e")) & (y["k"] == F.col("c.k")))
    near = F.exists("s", lambda y: (y["s"] < F.col("c.e")) & (y["e"] > F.col("c.s")))
    own = own.select(F.when(same, 1.0).when(~near, 0.0).alias("label"), F.xxhash64("c").alias("i"), "c")

    w = F.filter(F.split(F.substring("t", 1, 20_000), r"[^\p{L}]+"), lambda x: x != "")
    words = some.withColumn("w", w).where(F.size("w") >= 1).withColumn("i", F.explode(F.transform(F.sequence(F.lit(0), F.lit(each - 1)), lambda k: F.xxhash64("h", k))))
    at = lambda salt: F.lower(F.col("w")[_number(salt, 1 << 31).cast("int") % F.size("w")])
    ascii_ = lambda x, other: F.when(F.regexp_replace(x, "[^a-z]", "") != "", F.regexp_replace(x, "[^a-z]", "")).otherwise(F.lit(other))
    p = (_number(2, 1 << 31).cast("int") % F.size("w")) + 1
    words = words.withColumns({"w1": ascii_(at(3), "ann"), "w2": ascii_(at(4), "home"), "w3": ascii_(at(5), "then"), "left": F.array_join(F.slice("w", F.greatest(p - 6, F.lit(1)), F.least(p, F.lit(6))), " "), "right": F.array_join(F.slice("w", p, F.lit(6)), " ")})
    words = words.withColumn("body", F.concat((_number(40, 4) + 3).cast("string"), _digits(41, 14)))
    forms = _renderings()
    kind_first = [[n for n, (lab, k, _) in enumerate(forms) if lab == want and k == kind] for want in (1, 0) for kind in range(4)]
    pick = F.element_at(F.array(*[F.element_at(F.array(*[F.lit(n) for n in group]), (_number(6, len(group)) + 1).cast("int")) for group in kind_first]), (_number(7, 8) + 1).cast("int"))
    words = words.withColumn("f", pick)
    form = F.element_at(F.array(*[F.struct(F.lit(lab).alias("label"), F.lit(k).alias("k"), x.alias("v")) for lab, k, x in forms]), F.col("f") + 1)
    words = words.withColumn("form", form)
    # Leading words; half of the forms have none, and now and then any of them stands before any form.
    leads = {0: ("e-mail:", "mail", "contact"), 1: ("ip", "host", "server"), 2: ("card", "visa", "credit card"), 3: ("tel.", "phone:", "call"), 4: ("version", "order", "id", "ref", "page", "token =")}
    choice = F.element_at(F.array(*[F.element_at(F.array(*[F.lit(x) for x in v]), (_number(8, len(v)) + 1).cast("int")) for v in leads.values()]), F.when(_number(9, 8) == 0, (_number(103, 5) + 1).cast("int")).when(F.col("form.label") == 1, F.col("form.k") + 1).otherwise(F.lit(5)))
    lead = F.when(_number(104, 2) == 0, F.concat(F.lit(" "), choice, F.lit(" "))).otherwise(F.element_at(F.array(F.lit(" "), F.lit(". "), F.lit(", "), F.lit(" (")), (_number(105, 4) + 1).cast("int")))
    trail = F.element_at(F.array(F.lit(" "), F.lit(". "), F.lit(", "), F.lit(") ")), (_number(106, 4) + 1).cast("int"))
    made = words.withColumns({"lead": lead, "trail": trail}).select("i", "form", "left", "lead", "trail", "right")
    made = written(made.withColumn("before", F.concat("left", "lead")), "passages")  # texts * each rows
    made = made.select("i", "form", F.length("before").alias("from"), F.concat("before", "form.v", "trail", "right").alias("t"))
    made = candidates(made, "t", "c").select("i", "form", F.col("from"), (F.col("from") + F.length("form.v")).alias("to"), F.explode_outer("c").alias("c")).where("c IS NOT NULL")
    exact = (F.col("c.s") == F.col("from")) & (F.col("c.e") == F.col("to"))
    over = (F.col("c.s") < F.col("to")) & (F.col("c.e") > F.col("from"))
    label = F.when(exact & (F.col("form.k") == F.col("c.k")), F.col("form.label").cast("double")).when(exact | ~over | (F.col("form.label") == 0), 0.0)
    rows = own.unionByName(made.select(label.alias("label"), "i", "c")).where("label IS NOT NULL")
    return written(rows.select("label", (F.pmod(F.xxhash64(F.lit(12), "i"), F.lit(4)) == 0).alias("held"), "i", "c.*").repartition(1).sortWithinPartitions("i", "k", "s", "e"), "labelled")


def fit(docs: DataFrame, text_col: str = "text", *, texts: int = 2_000, each: int = 12, trees: int = 20, depth: int = 4, sure: float = 0.95, seed: int = 42) -> PiiModel:
    """Boosted trees on ``training_rows`` (bounded by ``texts`` and ``each``), by Spark ML; every kind's bar is where the
    Platt-scaled probability, fitted on the held-out quarter, reaches ``sure``. A kind without both labels there has no
    bar, so nothing is added to it; no candidates at all give a model that adds nothing."""
    names = [n for n, _ in FEATURES]
    rows = training_rows(docs, text_col, texts=texts, each=each)
    train = rows.where("NOT held")
    found = {r["label"] for r in train.select("label").distinct().collect()}
    if found != {0.0, 1.0}:
        return PiiModel("CAST(0 AS DOUBLE)", (math.inf,) * 4, (0.0,) * 4, (1.0,) * 4)
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(train).select("features", "label").coalesce(1)
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, minInstancesPerNode=3).fit(vectors)
    margin = ensemble_sql(ensemble(model.toDebugString), lambda k: f"x.{names[k]}")
    held = rows.where("held").select("label", "k", F.expr(margin.replace("x.", "")).alias("m")).collect()  # bounded by the sample
    bars, recall, precision = [], [], []
    for k in range(len(KINDS)):
        y, m = (np.array([r[c] for r in held if r["k"] == k], float) for c in ("label", "m"))
        bar = platt_bar(m, y, sure)
        bars.append(bar)
        hits = m >= bar
        recall.append(float(y[hits].sum() / max(y.sum(), 1)))
        precision.append(float(y[hits].mean()) if hits.any() else 1.0)
    return PiiModel(margin, tuple(bars), tuple(recall), tuple(precision))


def platt_bar(margin: np.ndarray, label: np.ndarray, sure: float) -> float:
    """The margin at which sigmoid(a * margin + b), fitted to smoothed labels by Newton steps, is ``sure``; infinite
    without both labels or where the fit does not rise."""
    pos, neg = int(label.sum()), int(len(label) - label.sum())
    if not pos or not neg:
        return math.inf
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, w = np.c_[margin, np.ones(len(margin))], np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target))
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float((math.log(sure / (1 - sure)) - w[1]) / w[0]) if w[0] > 0 else math.inf


def _written_out(spans: str) -> str:
    """SQL: spans as kind:start:end, comma-joined."""
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')"


def mark_spans(docs: DataFrame, model: PiiModel | None = None, *, text_col: str = "text") -> DataFrame:
    """Add n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end in code points, end
    exclusive, by start, then kind) and n_added to every row.

    Base spans are those of ``base_spans``. The model adds candidates that reach their kind's bar, touch no base span, and overlap
    no other such candidate that is better: of greater margin, then longer, earlier, or of an earlier kind. Without a
    model nothing is added. All of it is done within the row, by SQL functions: no shuffle.

    A null or empty text has no span; a text of any length is searched whole; equal texts have equal spans, repeated rows
    stay; an empty table gives an empty one. Input columns named like an output column are replaced, others stay.
    """
    names = [c for c in without(docs, *[c for c in OUT if c != text_col.lower()]).columns]
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_gl_row"), text_of(text_col).alias("_gl_text"))
    df = base_spans(df, "_gl_text", "_gl_base")
    added = "CAST(array() AS array<struct<s:int,k:int,e:int>>)"
    if model is not None and any(math.isfinite(b) for b in model.bars):
        bars = ", ".join(f"CAST({b!r} AS DOUBLE)" if math.isfinite(b) else "CAST('Infinity' AS DOUBLE)" for b in model.bars)
        df = candidates(df, "_gl_text", "_gl_c")
        df = df.withColumn("_gl_c", F.expr(f"transform(_gl_c, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e, 'm', {model.margin}))"))
        df = df.withColumn("_gl_c", F.expr(f"filter(_gl_c, x -> x.m >= array({bars})[x.k] AND NOT exists(_gl_base, y -> y.s < x.e AND x.s < y.e))"))
        # Greatest first: margin, length, earliness, kind.
        better = "struct(y.m, y.e - y.s, -y.s, -y.k) > struct(x.m, x.e - x.s, -x.s, -x.k)"
        df = df.withColumn("_gl_c", F.expr(f"CASE WHEN size(_gl_c) > 1 THEN filter(_gl_c, x -> NOT exists(_gl_c, y -> y.s < x.e AND x.s < y.e AND {better})) ELSE _gl_c END"))
        added = "array_distinct(transform(_gl_c, x -> named_struct('s', x.s, 'k', x.k, 'e', x.e)))"
    df = df.withColumn("_gl_added", F.expr(added))
    counts = {f"n_{k}": F.expr(f"CAST(size(filter(_gl_base, x -> x.k = {i})) AS BIGINT)") for i, k in enumerate(KINDS)}
    out = {**counts, "base_sha256": F.sha2(F.expr(_written_out("_gl_base")), 256), "spans": F.expr(_written_out("sort_array(concat(_gl_base, _gl_added))")), "n_added": F.size("_gl_added").cast("long")}
    df = df.withColumns(out)
    return df.select(*[F.col("_gl_row")[c].alias(c) for c in names], *[_held(F.col(c)).alias(c) for c in OUT])


def redact(marked: DataFrame, *, text_col: str = "text", out: str = "redacted") -> DataFrame:
    """``mark_spans`` rows with ``out``: the text with every span replaced by [EMAIL], [IP], [CARD] or [PHONE]; of spans that
    overlap, what is left of a later one after the earlier one's end is replaced too. Null texts stay null."""
    t, names = f"coalesce(CAST(`{text_col}` AS STRING), '')", ", ".join(f"'{k}', '[{k.upper()}]'" for k in KINDS)
    spans = "transform(filter(split(spans, ','), x -> x <> ''), x -> split(x, ':'))"
    step = f"named_struct('at', greatest(p.at, CAST(x[2] AS INT)), 'o', concat(p.o, substring({t}, p.at + 1, greatest(CAST(x[1] AS INT) - p.at, 0)), IF(CAST(x[2] AS INT) > p.at, map({names})[x[0]], '')))"
    text = f"aggregate({spans}, named_struct('at', 0, 'o', ''), (p, x) -> {step}, p -> concat(p.o, substring({t}, p.at + 1)))"
    return marked.withColumn(out, F.expr(f"CASE WHEN `{text_col}` IS NOT NULL THEN {text} END"))
