"""What words say about an article: sentiment by a phrase lexicon, entities with aliases, and its class.

A text is its lower-case runs of letters and digits, joined by single spaces; a phrase counts where it stands between spaces.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Phrases and their weights.
POSITIVE = {
    "beats": 1.0, "beat estimates": 1.2, "upgrade": 1.0, "upgrades": 1.0, "surge": 1.0, "surges": 1.0, "rally": 1.0, "record profit": 1.5,
    "rate cut": 1.0, "outperform": 1.0, "bullish": 1.0, "gains": 0.8, "growth": 0.5, "buyback": 0.8, "dividend hike": 0.8,
    "ceasefire deal": 1.2, "ceasefire holds": 1.1, "ceasefire agreed": 1.2, "peace deal": 1.3, "de-escalation": 1.0, "peace talks": 0.8,
    "troop withdrawal": 0.8, "trade deal": 1.0, "tariff cut": 1.0, "tariffs lifted": 1.1,
}
NEGATIVE = {
    "misses": 1.0, "missed estimates": 1.2, "downgrade": 1.0, "downgrades": 1.0, "plunge": 1.0, "plunges": 1.0, "selloff": 1.0, "default": 1.5,
    "fraud": 1.5, "rate hike": 1.0, "underperform": 1.0, "bearish": 1.0, "losses": 0.8, "slump": 1.0, "probe": 0.8, "recession": 1.2,
    "war": 1.3, "attack": 1.1, "attacks": 1.1, "strike": 0.9, "strikes": 0.9, "airstrike": 1.2, "airstrikes": 1.2, "missile": 1.1,
    "missiles": 1.1, "invasion": 1.3, "invades": 1.3, "escalation": 0.9, "escalates": 0.9, "sanctions": 0.9, "conflict": 0.7,
    "nuclear threat": 1.2, "troops": 0.5, "retaliation": 1.0, "retaliatory": 1.0, "ceasefire collapse": 1.4, "ceasefire collapses": 1.4,
    "ceasefire collapsed": 1.4, "ceasefire over": 1.4, "ceasefire broken": 1.4, "ceasefire violated": 1.4, "truce collapses": 1.4,
    "truce broken": 1.4, "martial law": 1.2, "tariff war": 1.1, "trade war": 1.1, "new tariffs": 1.0, "tariff hike": 1.0,
    "tariffs imposed": 1.0, "retaliatory tariffs": 1.1,
}
# Names by kind, in order of priority.
SECTORS = ["BANKING", "PHARMA", "AUTO", "ENERGY", "FMCG", "METALS", "REALTY", "INFRA", "TELECOM"]
COUNTRIES = ["USA", "AMERICA", "CHINA", "RUSSIA", "IRAN", "ISRAEL", "HONG KONG", "TAIWAN", "UKRAINE", "SAUDI ARABIA", "PAKISTAN"]
LEADERS = ["TRUMP", "PUTIN", "XI JINPING", "ZELENSKYY", "ZELENSKY", "NETANYAHU", "KHAMENEI"]
BANKERS = ["POWELL", "WARSH", "LAGARDE"]
POLICYMAKERS = ["MODI", "SITHARAMAN", "SANJAY MALHOTRA"]
INSTITUTIONS = ["OPEC", "MOODY", "FITCH", "S&P", "IMF", "WORLD BANK", "NATO", "FEDERAL RESERVE", "ECB"]
ALIASES = {"AMBANI": "RELIANCE", "ADANI": "ADANIENT"}
# Keywords of the classes, in the order in which they are tried.
KEYWORDS = {
    "policy": ["rbi", "sebi", "policy", "regulation", "regulator", "budget", "tariff", "ministry", "government"],
    "macro": ["gdp", "inflation", "cpi", "unemployment", "fiscal deficit", "macro", "economy", "recession", "rate hike", "rate cut"],
    "global": ["fed", "federal reserve", "china", "europe", "ecb", "global", "geopolitical", "crude", "treasury", "us markets", "middle east", "opec", "war", "invasion", "sanctions", "conflict"],
    "corporate": ["merger", "acquisition", "earnings", "dividend", "buyback", "ipo", "results", "ceo", "board", "stake"],
}
WATCHLIST = ("RELIANCE", "ADANIENT")  # a caller's own symbols


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1), " "), F.lit(" "))


def _phrase(name: str) -> str:
    return f" {' '.join(re.findall('[a-z0-9]+', name.lower()))} "


def sentiment(spaced: Column) -> Column:
    """(positive - negative) / (positive + negative) of the weighted phrase counts, 0 where there is none."""

    def weight(words: dict[str, float]) -> Column:
        return sum((F.lit(w) * (F.length(spaced) - F.length(F.replace(spaced, F.lit(f" {t} "), F.lit("")))) / (len(t) + 2) for t, w in words.items()), F.lit(0.0))

    up, down = weight(POSITIVE), weight(NEGATIVE)
    some = spaced.rlike(" (" + "|".join(map(re.escape, [*POSITIVE, *NEGATIVE])) + ") ")
    return F.when(some, (up - down) / F.nullif(up + down, F.lit(0.0))).otherwise(0.0)


def entities(spaced: Column, watchlist: Sequence[str] = WATCHLIST) -> Column:
    """Names found, in order of priority; an alias gives the symbol it stands for."""
    names = [*watchlist, *ALIASES, *SECTORS, *COUNTRIES, *LEADERS, *BANKERS, *POLICYMAKERS, *INSTITUTIONS]
    return F.array_compact(F.array(*(F.when(spaced.contains(_phrase(n)), F.lit(ALIASES.get(n, n))) for n in names)))


def article_class(spaced: Column, found: Column, watchlist: Sequence[str] = WATCHLIST) -> Column:
    """stock, sector, global or policy by the entities found, else by keywords, else macro."""
    any_of = lambda names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    out = F.when(any_of(watchlist), "stock").when(any_of(SECTORS), "sector").when(any_of([*COUNTRIES, *LEADERS, *BANKERS, *INSTITUTIONS]), "global").when(any_of(POLICYMAKERS), "policy")
    for name, words in KEYWORDS.items():
        out = out.when(spaced.rlike(" (" + "|".join(words) + ") "), name)
    return out.otherwise("macro")


def read(articles: DataFrame, watchlist: Sequence[str] = WATCHLIST) -> DataFrame:
    """doc_id, sentiment, entities, class of ``articles`` (doc_id, text)."""
    d = articles.select("doc_id", padded(F.col("text")).alias("_p"))
    d = d.select("doc_id", "_p", entities(F.col("_p"), watchlist).alias("entities"))
    return d.select("doc_id", sentiment(F.col("_p")).alias("sentiment"), "entities", article_class(F.col("_p"), F.col("entities"), watchlist).alias("class"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, and headlines that name something: the documents' invented words rarely do."""
    heads = spark.range(len(HEADLINES)).select((F.col("id") - len(HEADLINES)).alias("doc_id"), F.element_at(F.array(*map(F.lit, HEADLINES)), (F.col("id") + 1).cast("int")).alias("text"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(heads)


HEADLINES = [
    "Ambani beats estimates, record profit", "Banking rally after rate cut", "China war escalates: new tariffs", "Modi unveils budget", "Inflation slump", "Crude surges", "Merger probe",
    "Fed rate hike, selloff; losses and losses", "Peace talks hold", "Moody's downgrade of S&P", "autopilot warship", "",
]
QUERIES = {
    "d16_lexicon_sentiment": lambda spark, d: read(_texts(spark, d)).select("doc_id", (F.round(F.col("sentiment") + 1e-9, 6) + 0.0).alias("sentiment")),
    "d18_entities": lambda spark, d: read(_texts(spark, d)).select("doc_id", F.array_join("entities", ",").alias("entities"), F.size("entities").cast("long").alias("found")),
    "d19_classification": lambda spark, d: read(_texts(spark, d)).select("doc_id", "class"),
}


def _quoted(xs: Sequence[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"


#: Long form in DuckDB: one row a document and phrase, then sums, lists and the first class by rank.
_SPACED = f"""t AS (SELECT doc_id, text FROM documents UNION ALL SELECT unnest(range(-{len(HEADLINES)}, 0)), unnest({_quoted(HEADLINES)})),
p AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), ' ') || ' ' AS s FROM t)"""
_NAMED = [(n, k) for k, names in (("stock", WATCHLIST), ("stock", ALIASES), ("sector", SECTORS), ("global", COUNTRIES), ("global", LEADERS), ("global", BANKERS), ("policy", POLICYMAKERS), ("global", INSTITUTIONS)) for n in names]
_FOUND = f"""n AS (SELECT unnest({_quoted([_phrase(n) for n, _ in _NAMED])}) AS phrase, unnest({_quoted([ALIASES.get(n, n) for n, _ in _NAMED])}) AS name,
  unnest({_quoted([k for _, k in _NAMED])}) AS kind, unnest(range({len(_NAMED)})) AS rank),
f AS (SELECT doc_id, name, kind, rank FROM p JOIN n ON contains(s, phrase))"""
ORACLES = {
    "d16_lexicon_sentiment": f"""WITH {_SPACED},
w AS (SELECT unnest({_quoted([*POSITIVE, *NEGATIVE])}) AS phrase, unnest({[*POSITIVE.values(), *(-x for x in NEGATIVE.values())]}) AS w),
c AS (SELECT doc_id, w, (length(s) - length(replace(s, ' ' || phrase || ' ', ''))) / (length(phrase) + 2) AS n FROM p JOIN w ON contains(s, ' ' || phrase || ' '))
SELECT p.doc_id, (round(coalesce(sum(w * n) / nullif(sum(abs(w) * n), 0), 0) + 1e-9, 6) + 0.0) AS sentiment FROM p LEFT JOIN c ON p.doc_id = c.doc_id GROUP BY p.doc_id""",
    "d18_entities": f"WITH {_SPACED}, {_FOUND} SELECT p.doc_id, coalesce(string_agg(name, ',' ORDER BY rank), '') AS entities, count(name) AS found FROM p LEFT JOIN f ON p.doc_id = f.doc_id GROUP BY p.doc_id",
    "d19_classification": f"""WITH {_SPACED}, {_FOUND},
k AS (SELECT doc_id, CASE kind WHEN 'stock' THEN 1 WHEN 'sector' THEN 2 WHEN 'global' THEN 3 ELSE 4 END AS o, kind AS class FROM f
  {" ".join(f"UNION ALL SELECT doc_id, {5 + i}, '{c}' FROM p WHERE len(list_filter({_quoted(words)}, lambda x: contains(s, ' ' || x || ' '))) > 0" for i, (c, words) in enumerate(KEYWORDS.items()))})
SELECT p.doc_id, coalesce(min_by(class, o), 'macro') AS class FROM p LEFT JOIN k ON p.doc_id = k.doc_id GROUP BY p.doc_id""",
}
