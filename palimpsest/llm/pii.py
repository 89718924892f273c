"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Native operator: only DataFrame functions, no Python on the executors.

Per kind, ``split`` and ``regexp_extract_all`` by the same pattern give the text
between and inside the leftmost non-overlapping matches; a running sum of their
lengths (code points) gives positions. Patterns use possessive quantifiers and
look-behinds so that a run of characters is scanned once, also in very long
texts, and ``\\G`` so that a match may begin where the previous one ended; the
matches are those of the plain patterns in ``BASE_PATTERNS``.

Defined results: null text counts as empty (zero spans); repeated rows give
repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

# Plain forms of the base patterns, as the contract states them.
BASE_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

# Lengths of an IBAN by country, from the public IBAN registry (fixed values).
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}


def _by_length() -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        out.setdefault(n, []).append(country)
    return out


IBAN_BODY = "|".join(f"(?:{'|'.join(c)})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in sorted(_by_length().items()))
SSN_BODY = "[0-9]{3}-[0-9]{2}-[0-9]{4}"
_EDGE = (r"(?<![A-Za-z0-9_])(?:", r")(?![A-Za-z0-9_])")

PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": BASE_PATTERNS["phone"],
    "iban": IBAN_BODY.join(_EDGE),
    "ssn": SSN_BODY.join(_EDGE),
}

# What a text must hold for a kind to be possible; saves the slower pattern.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"),
    "iban": lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[ A-Z0-9]"),
    "ssn": lambda t: t.rlike(r"[0-9]-[0-9]{2}-[0-9]"),
}

# Score in percent before context, the bonus for a context word, and the words.
SCORES = {"email": 80, "ip": 60, "card": 70, "phone": 60, "iban": 90, "ssn": 30}
BONUS = 20
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|server|host|address|client",
    "card": "card|visa|credit|amex|kreditkarte|tarjeta|carte",
    "phone": "tel|phone|call|fax|mobile|handy",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security",
}
CONTEXT_CHARS = 40
#: Spans under this score are not reported; base kinds always start above it.
LEAST_SCORE = 50


def luhn(digits: Column) -> Column:
    """Luhn checksum of a string of digits: every second digit from the right is doubled."""
    ds = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(ds, lambda d, i: F.when(i % 2 == 0, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))),
        F.lit(0),
        lambda a, d: a + F.coalesce(d, F.lit(0)),
    )
    return total % 10 == 0


def mod97(iban: Column) -> Column:
    """ISO 13616 check: first four characters last, letters as 10..35, remainder 1 of 97."""
    turned = F.concat(F.substring(iban, 5, 60), F.substring(iban, 1, 4))
    codes = F.transform(F.split(turned, ""), lambda c: F.ascii(c))
    rest = F.aggregate(
        F.filter(codes, lambda a: a > 0),
        F.lit(0),
        lambda r, a: F.when(a >= 65, r * 100 + a - 55).otherwise(r * 10 + a - 48) % 97,
    )
    return rest == 1


def _valid(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    octets = F.transform(F.split(m, r"\."), lambda x: F.regexp_replace(x, "^0+", ""))
    small = F.forall(octets, lambda x: (F.length(x) < 4) & (F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(kind == 0, F.lit(True))
        .when(kind == 1, small)
        .when(kind == 2, F.when((n >= 13) & (n <= 19), luhn(digits)).otherwise(False))
        .when(kind == 3, (n >= 9) & (n <= 15))
        .when(kind == 4, mod97(F.regexp_replace(m, " ", "")))
        .otherwise(
            ~F.substring(m, 1, 3).isin("000", "666")
            & (F.substring(m, 1, 1) != "9")
            & (F.substring(m, 5, 2) != "00")
            & (F.substring(m, 8, 4) != "0000")
        )
    )


def _proposals(k: int) -> Column:
    """Array of (kind, i, before, match, context), one per match of kind k."""
    inside, between = F.col(f"m{k}"), F.col(f"b{k}")
    zipped = F.arrays_zip(inside.alias("m"), between.alias("b"), F.slice(between, F.lit(2), F.size(between)).alias("a"))
    around = lambda z: F.concat_ws(" ", F.right(z["b"], F.lit(CONTEXT_CHARS)), F.left(z["a"], F.lit(CONTEXT_CHARS)))
    return F.transform(
        F.filter(zipped, lambda z: z["m"].isNotNull()),
        lambda z, i: F.struct(
            F.lit(k).alias("kind"),
            i.alias("i"),
            F.length(z["b"]).alias("before"),
            z["m"].alias("m"),
            F.lower(around(z)).alias("ctx"),
        ),
    )


_EMPTY = "array<struct<kind:int,i:int,before:int,m:string,ctx:string>>"


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (kind, start, end, score).

    kind counts KINDS from 0; start and end are code points, end exclusive.
    Spans are sorted by kind, then start.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), common.utf8(text_col).alias("t"))
    base = base.withColumn("rid", F.monotonically_increasing_id())
    # Matches and the text between them, each found once; a null where the kind cannot occur.
    cut = []
    for k, kind in enumerate(KINDS):
        can = _NEEDS[kind](F.col("t"))
        cut.append(F.when(can, F.regexp_extract_all(F.col("t"), F.lit(PATTERNS[kind]), F.lit(0))).alias(f"m{k}"))
        cut.append(F.when(can, F.split(F.col("t"), PATTERNS[kind], -1)).alias(f"b{k}"))
    arrays = base.select("doc_id", "rid", *cut).select("doc_id", "rid", *[_proposals(k).cast(_EMPTY).alias(f"k{k}") for k in range(len(KINDS))])
    flat = arrays.select(
        "doc_id",
        "rid",
        F.explode_outer(F.concat(*[F.coalesce(F.col(f"k{k}"), F.array().cast(_EMPTY)) for k in range(len(KINDS))])).alias("p"),
    ).select("doc_id", "rid", "p.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    size = F.length("m")
    placed = flat.withColumn("end", F.sum(F.col("before") + size).over(upto))
    hit = F.lit(False)
    for k, kind in enumerate(KINDS):
        hit = F.when(F.col("kind") == k, F.col("ctx").rlike(CONTEXT[kind])).otherwise(hit)
    score = F.element_at(F.array(*[F.lit(SCORES[k]) for k in KINDS]), F.col("kind") + 1) + F.when(hit, F.lit(BONUS)).otherwise(0)
    scored = placed.withColumn("score", F.least(score, F.lit(100)))
    good = F.col("kind").isNotNull() & _valid(F.col("kind"), F.col("m")) & (F.col("score") >= LEAST_SCORE)
    span = F.struct("kind", (F.col("end") - size).alias("start"), "end", "score")
    return (
        scored.groupBy("doc_id", "rid")
        .agg(F.sort_array(F.collect_list(F.when(good, span))).alias("spans"))
        .drop("rid")
    )


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(
        ",",
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
    )


def digest(spans: DataFrame) -> DataFrame:
    """Counts of base kinds, hash of base spans and all spans as text, per document."""
    s = F.col("spans")
    of = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return spans.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.filter(s, lambda x: x["kind"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        _joined(s).alias("spans"),
        F.concat_ws(",", F.transform(s, lambda x: x["score"].cast("string"))).alias("scores"),
    )


def _oracle() -> str:
    bodies = {**BASE_PATTERNS, "iban": rf"\b(?:{IBAN_BODY})\b", "ssn": rf"\b{SSN_BODY}\b"}
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for k, kind in enumerate(KINDS):
        body = quote(bodies[kind])
        n, d = "len(regexp_replace(m, '[^0-9]', '', 'g'))", "regexp_replace(m, '[^0-9]', '', 'g')"
        valid = {
            "email": "true",
            "ip": "list_bool_and(list_transform(string_split(m, '.'), lambda x: len(ltrim(x, '0')) < 4 and coalesce(try_cast(ltrim(x, '0') as int), 0) <= 255))",
            "card": f"{n} between 13 and 19 and list_sum(list_transform(string_split(reverse({d}), ''), lambda c, j: case when j % 2 = 1 then c::int when c::int > 4 then c::int * 2 - 9 else c::int * 2 end)) % 10 = 0",
            "phone": f"{n} between 9 and 15",
            "iban": "list_reduce(list_prepend(0::bigint, list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: ascii(c)::bigint)), lambda r, a: case when a >= 65 then (r * 100 + a - 55) % 97 else (r * 10 + a - 48) % 97 end) = 1",
            "ssn": "substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8, 4) <> '0000'",
        }[kind]
        parts.append(f"""
        select rid, {k} as kind, start_, start_ + len(m) as end_, score from (
          select rid, m, (list_sum(list_transform(b[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0))::bigint as start_,
                 least(100, {SCORES[kind]} + case when regexp_matches(lower(right(b[i], {CONTEXT_CHARS}) || ' ' || left(b[i + 1], {CONTEXT_CHARS})), {quote(CONTEXT[kind])}) then {BONUS} else 0 end) as score
          from (select rid, f, b, unnest(f) as m, generate_subscripts(f, 1) as i
                from (select rid, regexp_extract_all(t, {body}) as f, regexp_split_to_array(t, {body}) as b from d))
        ) where {valid} and score >= {LEAST_SCORE}""")
    names = "[" + ", ".join(quote(k) for k in KINDS) + "]"
    return f"""
    with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
    s as ({" union all ".join(parts)}),
    g as (select rid, {", ".join(f"count(*) filter (kind = {k}) as n_{name}" for k, name in enumerate(KINDS))},
      coalesce(string_agg({names}[kind + 1] || ':' || start_ || ':' || end_, ',' order by kind, start_) filter (kind < {len(BASE_KINDS)}), '') as base,
      string_agg({names}[kind + 1] || ':' || start_ || ':' || end_, ',' order by kind, start_) as spans,
      string_agg(score::varchar, ',' order by kind, start_) as scores
      from s group by rid)
    select doc_id, {", ".join(f"coalesce(n_{name}, 0)::bigint as n_{name}" for name in KINDS)},
      sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(scores, '') as scores
    from d left join g using (rid)"""


ORACLE_SQL = _oracle()
