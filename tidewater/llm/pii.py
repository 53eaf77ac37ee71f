"""Operator 11: personal data, by regular expressions that propose, checksums that confirm and context words that weigh.

Rules are rows of a table (`RULES`): a regular expression proposes spans; a check (Luhn for cards, mod-97 and the country's
length for account numbers, number ranges, digit counts) confirms them; words within `NEAR` code points before or after (no
further than the next proposal of the same rule) add to the score. A base rule's spans stay whatever their score; a span of
another rule stays from `KEPT` on, and if no base span of its kind covers its start. Everything is DataFrame functions: no Python on the executors.

Positions come without a loop over the text: ``split`` gives the texts between the matches, ``regexp_extract_all`` the matches,
and a running sum of their lengths over (row, rule) each match's start. Only numbers leave the scan: one row a document and
one a match.

Quantifiers that can't give anything back are possessive and a run is entered at its start only, so a long run of digits or of
name characters is read once; both leave the matches as the plain expressions give them.

Defined results
- null text counts as empty; a document without a span has zero counts, the digest of the empty string, empty ``spans``.
- offsets are code points of the whole text, end exclusive; spans of different kinds may overlap, those of one rule don't.
- rows are told apart by their place in the input: repeated ids, null ids and repeated rows are documents of their own.
- other columns of the input are ignored; an empty table gives an empty result.
- counts and the digest are of base spans; ``spans`` has all, kinds in the order of `KINDS`, then by start.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEAR = 40
KEPT = 0.65
KINDS = ["email", "ip", "card", "phone", "iban", "ssn"]
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"

#: Length of an account number by country.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 "
    "IS26 IT27 KW30 KZ20 LB28 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VG24 XK20"
)
#: Words that speak for a kind, in the languages of the corpus.
WORDS = {
    "email": "mail|contact|kontakt|correo|courriel",
    "ip": "address|host|server|login|adresse|servidor|serveur",
    "card": "card|visa|mastercard|amex|credit|debit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|fax|whatsapp|telefon|llamar|appel",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security",
}
#: First digits and lengths of card numbers.
ISSUERS = "^(?:4[0-9]{12}(?:[0-9]{3})?(?:[0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|3[068][0-9]{12}|6[045][0-9]{14,17})$"


@dataclass(frozen=True)
class Rule:
    kind: str
    base: bool
    pattern: str  # what Spark runs
    hint: str  # text that every match holds
    prior: float  # score of a confirmed match without a context word
    near: float  # added by a context word
    lead: str = ""  # characters that may precede the span inside the match


RULES = [
    Rule("email", True, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, 0.1),
    Rule("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.6, 0.3),
    Rule("card", True, r"[0-9](?:[\x20-]?[0-9]){15,}+", "", 0.7, 0.25),
    Rule("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.7, 0.25),
    # what the base expressions miss
    Rule("email", False, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]++)++", "at", 0.8, 0.2),
    Rule("card", False, r"(?<![0-9])[0-9]{13,19}+(?![0-9])", "", 0.7, 0.25),
    Rule("phone", False, r"(?:^|[^0-9])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}", "", 0.5, 0.25, r"^[^0-9(]|^\(\("),
    Rule("iban", False, r"(?:^|[^A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", "", 0.8, 0.2, "^[^A-Z]"),
    Rule("ssn", False, r"(?:^|[^0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}", "-", 0.4, 0.4, "^[^0-9]"),
]
SOLID = next(n for n, r in enumerate(RULES) if r.kind == "card" and not r.base)


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes; zeros in front change nothing."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, string.digits, "0246813579")
    total = sum((F.ascii(F.substring(doubled if (19 - k) % 2 else padded, k, 1)) for k in range(1, 20)), F.lit(-19 * ord("0")))
    return total % 10 == 0


def mod97(account: Column) -> Column:
    """Remainder of an account number (capitals and digits) whose first four characters were moved to its end."""
    code = lambda c: F.ascii(c)
    step = lambda a, c: F.when(c <= "9", (a * 10 + code(c) - 48) % 97).otherwise((a * 100 + code(c) - 55) % 97)
    return F.aggregate(F.split(account, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c)))


def _proposals(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_row, doc_id and the matches of all rules in ``_all``: rule, k, match, text before, text after."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), text.alias("_text"))
    none = F.array().cast("array<string>")
    seen, parts = {}, {}
    for n, r in enumerate(RULES):
        there = F.col("_text").contains(r.hint) if r.hint else F.col("_text").rlike("[0-9]")
        seen[n] = F.when(there, F.regexp_extract_all("_text", F.lit(r.pattern), 0)).otherwise(none)
        parts[n] = F.when(there, F.split("_text", r.pattern, -1)).otherwise(none)
    rows = rows.select("_row", "doc_id", *[c.alias(f"m{n}") for n, c in seen.items()], *[c.alias(f"p{n}") for n, c in parts.items()])
    zipped = [F.arrays_zip(F.array_repeat(F.lit(n), F.size(f"m{n}")), F.sequence(F.lit(0), F.size(f"m{n}")), f"m{n}", f"p{n}", F.slice(f"p{n}", 2, F.greatest(F.size(f"p{n}"), F.lit(1)))) for n in range(len(RULES))]
    kind = "array<struct<rule:int,k:int,match:string,before:string,after:string>>"
    own = F.array(F.struct(F.lit(-1), F.lit(0), F.lit(""), F.lit(""), F.lit(""))).cast(kind)
    return rows.select("_row", "doc_id", F.explode(F.concat(own, *[z.cast(kind) for z in zipped])).alias("_m")).select("_row", "doc_id", "_m.*").where("match is not null")


def _confirmed() -> tuple[Column, Column, Column]:
    """(whether the match is confirmed, characters before the span in it, length of the span), by rule."""
    m, after = F.col("match"), F.col("after")
    digits = F.regexp_replace(m, "[^0-9]", "")
    ok, lead, length = F.lit(False), F.lit(0), F.length(m)
    lengths = F.create_map(*[F.lit(x) for e in IBAN_LENGTHS.split() for x in (e[:2], int(e[2:]))])
    for n, r in enumerate(RULES):
        at = F.col("rule") == n
        skip = F.when(m.rlike(r.lead), 1).otherwise(0) if r.lead else F.lit(0)
        size = F.length(m) - skip
        span = F.substr(m, skip + 1)
        check = F.lit(True)
        if r.kind == "ip":
            check = m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
        elif r.kind == "card":
            check = F.length(digits).between(16 if r.base else 13, 19) & luhn(F.substring(digits, 1, 19))
            check = check if r.base else check & digits.rlike(ISSUERS)
        elif r.kind == "phone":
            check = F.length(digits).between(8, 15) if r.base else ~after.rlike("^[0-9]")
        elif r.kind == "iban":
            want = lengths[F.substr(span, F.lit(1), F.lit(2))]
            grouped = F.contains(span, F.lit(" "))
            taken = F.when(grouped, want + F.ceil(want / 4).cast("int") - 1).otherwise(want)
            plain = F.replace(F.left(span, taken), F.lit(" "), F.lit(""))
            rest = F.concat(F.substr(span, taken + 1), after)
            check = F.coalesce((F.length(plain) == want) & ~rest.rlike("^[A-Za-z0-9]") & (mod97(F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))) == 1), F.lit(False))
            size = F.coalesce(taken, size)
        elif r.kind == "ssn":
            check = ~after.rlike("^[0-9-]") & span.rlike("^(?:00[1-9]|0[1-9][0-9]|[1-578][0-9]{2}|6[0-57-9][0-9]|66[0-57-9])-(?:0[1-9]|[1-9][0-9])-(?:000[1-9]|00[1-9][0-9]|0[1-9][0-9]{2}|[1-9][0-9]{3})$")
        ok, lead, length = F.when(at, check).otherwise(ok), F.when(at, skip).otherwise(lead), F.when(at, size).otherwise(length)
    return ok, lead, length


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", marks: bool = False) -> DataFrame:
    """_row (a number for each input row), doc_id, kind, base, start, end, score of every span. ``marks`` keeps a row with a
    null kind for every document."""
    ok, lead, size = _confirmed()
    around = F.lower(F.concat(F.right("before", F.lit(NEAR)), F.lit(" "), F.left("after", F.lit(NEAR))))
    word = F.lit(False)
    for n, r in enumerate(RULES):
        word = F.when(F.col("rule") == n, around.rlike(f"(?:{WORDS[r.kind]})")).otherwise(word)
    short = F.when((F.col("rule") == SOLID) & (F.length("match") < 16), 0.2).otherwise(0.0)  # as likely some other number
    of = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.greatest(F.col("rule"), F.lit(0)) + 1)
    seen = _proposals(docs, id_col, text_col).select(
        "_row", "doc_id", "rule", "k", F.length("before").alias("gap"), F.length("match").alias("len"), lead.alias("lead"), size.alias("size"), ok.alias("ok"),
        F.round(of([r.prior for r in RULES]) - short + F.when(word, of([r.near for r in RULES])).otherwise(0.0), 2).alias("score"),
    )
    so_far = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("_row", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = seen.repartition("_row").withColumn("start", so_far - F.col("len") + F.col("lead")).where(F.col("ok") | (F.col("rule") < 0))
    spans = placed.select(
        "_row", "doc_id", F.when(F.col("rule") >= 0, of([r.kind for r in RULES])).alias("kind"), of([r.base for r in RULES]).alias("base"),
        "start", (F.col("start") + F.col("size")).alias("end"), "score",
    )
    # nothing of a kind starts inside a base span of it
    w = Window.partitionBy("_row", "kind").orderBy("start", F.desc("base"), "end").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(w) > F.col("start"), F.lit(False))
    kept = spans.withColumn("_covered", covered).where(F.col("kind").isNull() | F.col("base") | (~F.col("_covered") & (F.col("score") >= KEPT))).drop("_covered")
    return kept if marks else kept.where("kind is not null")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spans = find_pii(docs, id_col, text_col, marks=True)
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    found = F.when(F.col("kind").isNotNull(), F.struct(order.alias("o"), "start", "end", "kind", "base"))
    grouped = spans.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), *[F.count(F.when(F.col("base") & (F.col("kind") == k), 1)).alias(f"n_{k}") for k in KINDS[:4]], F.array_sort(F.collect_list(found)).alias("s"))
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return grouped.select("doc_id", *[f"n_{k}" for k in KINDS[:4]], F.sha2(text(F.filter("s", lambda x: x["base"])), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# Plain expressions with RE2, candidates by unnesting, checks by lists; what a word near a span decides is spelled out by rule.
def _sql_rule(n: int, kind: str, base: bool, pattern: str, ok: str, skip: str = "0", size: str = "length(x) - skip") -> str:
    return f"""
m{n} AS (SELECT row, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS p FROM d),
u{n} AS (SELECT row, unnest(range(len(m))) AS i, unnest(m) AS x, unnest(p[:len(m)]) AS before, unnest(p[2:]) AS after FROM m{n}),
r{n} AS (
  SELECT row, x, after, lower(right(before, 40) || ' ' || left(after, 40)) AS around, {skip} AS skip,
         sum(length(before) + length(x)) OVER (PARTITION BY row ORDER BY i) - length(x) AS pos
  FROM u{n}),
s{n} AS (
  SELECT row, '{kind}' AS kind, {base} AS base, pos + skip AS s, pos + skip + {size} AS e
  FROM (SELECT *, substr(x, skip + 1) AS span, regexp_replace(x, '[^0-9]', '', 'g') AS digits FROM r{n}) WHERE {ok})"""


_LUHN = "list_sum(list_transform(range(length(digits)), lambda k: CASE WHEN k % 2 = 0 THEN digits[length(digits) - k]::INT ELSE [0,2,4,6,8,1,3,5,7,9][digits[length(digits) - k]::INT + 1] END)) % 10 = 0"
_WANT = "map_from_entries([" + ", ".join(f"('{e[:2]}', {e[2:]})" for e in IBAN_LENGTHS.split()) + "])[span[1:2]]"
_TAKEN = f"({_WANT} + CASE WHEN contains(span, ' ') THEN ceil({_WANT} / 4.0)::INT - 1 ELSE 0 END)"
_PLAIN = f"replace(left(span, {_TAKEN}), ' ', '')"
_MOD = f"list_reduce(list_prepend(0, list_transform(string_split({_PLAIN}[5:] || {_PLAIN}[:4], ''), lambda c: CASE WHEN c <= '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END)), lambda a, c: (a * CASE WHEN c < 10 THEN 10 ELSE 100 END + c) % 97) = 1"
_near = lambda kind: f"regexp_matches(around, '{WORDS[kind]}')"
_PARTS = [
    _sql_rule(0, "email", True, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    _sql_rule(1, "ip", True, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_max(list_transform(string_split(x, '.'), lambda y: TRY_CAST(y AS HUGEINT))) <= 255"),
    _sql_rule(2, "card", True, r"[0-9](?:[ -]?[0-9])+", f"length(digits) BETWEEN 16 AND 19 AND {_LUHN}"),
    _sql_rule(3, "phone", True, r"\+[0-9][ ().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15"),
    _sql_rule(4, "email", False, r"[A-Za-z0-9._%+-]+ ?[\[(]at[\])] ?[A-Za-z0-9-]+(?:(?:\.| ?[\[(]dot[\])] ?)[A-Za-z0-9-]+)+", "true"),
    _sql_rule(5, "card", False, "[0-9]+", f"length(x) BETWEEN 13 AND 19 AND regexp_matches(x, '{ISSUERS}') AND {_LUHN} AND (length(x) >= 16 OR {_near('card')})"),
    _sql_rule(6, "phone", False, RULES[6].pattern, f"NOT regexp_matches(after, '^[0-9]') AND {_near('phone')}", "CASE WHEN x[1] BETWEEN '0' AND '9' OR (x[1] = '(' AND x[2] <> '(') THEN 0 ELSE 1 END"),
    _sql_rule(7, "iban", False, RULES[7].pattern, f"length({_PLAIN}) = {_WANT} AND NOT regexp_matches(substr(span, {_TAKEN} + 1) || after, '^[A-Za-z0-9]') AND {_MOD}", "CASE WHEN x[1] BETWEEN 'A' AND 'Z' THEN 0 ELSE 1 END", _TAKEN),
    _sql_rule(8, "ssn", False, RULES[8].pattern, f"NOT regexp_matches(after, '^[0-9-]') AND span[1:3] NOT IN ('000', '666') AND span[1] <> '9' AND span[5:6] <> '00' AND span[8:] <> '0000' AND {_near('ssn')}", "CASE WHEN x[1] BETWEEN '0' AND '9' THEN 0 ELSE 1 END"),
]
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),{",".join(_PARTS)},
u AS ({" UNION ALL ".join(f"SELECT * FROM s{n}" for n in range(len(_PARTS)))}),
v AS (SELECT * FROM u WHERE base OR NOT EXISTS (SELECT 1 FROM u b WHERE b.row = u.row AND b.kind = u.kind AND b.base AND b.s <= u.s AND u.s < b.e)),
w AS (
  SELECT row, count(*) FILTER (base AND kind = 'email') AS n_email, count(*) FILTER (base AND kind = 'ip') AS n_ip,
         count(*) FILTER (base AND kind = 'card') AS n_card, count(*) FILTER (base AND kind = 'phone') AS n_phone,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY list_position({KINDS!r}, kind), s, e) FILTER (base) AS own,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY list_position({KINDS!r}, kind), s, e) AS spans
  FROM v GROUP BY row)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
       sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN w USING (row)
"""
