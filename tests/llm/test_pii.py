"""Operator 11 against a plain walk over the contract's expressions, and against its SQL on hard texts."""

import hashlib
import random
import re

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.llm import pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HARD = [
    (1, None),
    (2, ""),
    (3, "IBAN: DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432. amex card 378282246310005 x 378282246310005" + " pad" * 30 + " 378282246310005"),
    (4, "ssn 123-45-6789" + " pad" * 30 + " 123-45-6789; ssn 666-45-6789"),
    (4, "a@b.c%d@e.f 1.2.3.4.5.6.7.8 300.1.1.1 010.0.0.255 joe.x [at] site (dot) com"),
    (None, "+1 (743) 555-3824 é 4465758382889437 4465758382889437 \U0001d4b3 4111 1111 1111 1111"),
    (None, "+1 (743) 555-3824 é 4465758382889437 4465758382889437 \U0001d4b3 4111 1111 1111 1111"),
    (7, "7" * 5000 + "@ " + "+" * 1000 + "1 " * 3000),
    (8, "+1 (743) 555-3824 12345678 tel; ((212) 555-0199 phone, 212-555-0199 call"),
    (9, "DE89370400440532013001 XDE89370400440532013000 DE89370400440532013000 IS NL91ABNA0417164300"),
    (10, "a" * 6000 + " " + "a." * 3000 + "@"),
]


def luhn(d: str) -> bool:
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def walk(text: str) -> list[str]:
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            bad = {
                "ip": lambda: any(int(x) > 255 for x in m[0].split(".")),
                "card": lambda: not 16 <= len(d) <= 19 or not luhn(d),
                "phone": lambda: not 8 <= len(d) <= 15,
            }
            if kind == "email" or not bad[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pii")
    pd.DataFrame([(*r, "x", 1) for r in HARD], columns=["doc_id", "text", "kind", "start"]).astype({"doc_id": "Int64"}).to_parquet(d / "documents.parquet")
    return str(d)


def as_rows(df: pd.DataFrame) -> list[tuple]:
    cols = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return sorted((tuple("" if pd.isna(v) else v if isinstance(v, str) else int(v) for v in r) for r in df[cols].itertuples(index=False)), key=str)


def test_hard_texts_equal_sql_and_the_walk(spark, hard):
    got = pii.op11_pii(spark, hard).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{hard}/documents.parquet'")
    assert as_rows(got) == as_rows(con.sql(pii.SQL).df())
    want = sorted(hashlib.sha256(",".join(walk(t or "")).encode()).hexdigest() for _, t in HARD)
    assert sorted(got["base_sha256"]) == want
    spans = dict(zip(got["doc_id"].fillna(-1).astype(int), got["spans"]))
    assert spans[9] == "iban:47:69,iban:73:91" and spans[2] == ""
    assert spans[-1] == "card:20:36,card:37:53,card:56:75,phone:0:17"  # the base expression misses the first two
    at = HARD[2][1].index("3782")
    assert spans[3] == f"card:{at}:{at + 15},iban:6:33,iban:38:60"  # thirteen to fifteen digits need a word nearby


def test_random_texts_equal_the_walk(spark):
    rng = random.Random(11)
    pieces = ["1", "22", "4111111111111111", "4111 1111-1111 1111", ".", "-", " ", "@", "+", "(", ")", "a", "b.c", "%", "é", "255", "256", "x@y.z", "+49 30 1234567", "\n", "1.2.3.4", "@@", "..", "0"]
    docs = [(k, "".join(rng.choices(pieces, k=rng.randint(0, 40)))) for k in range(1500)]
    got = pii.digests(spark.createDataFrame(docs, "doc_id long, text string")).toPandas().set_index("doc_id")
    for k, t in docs:
        own = walk(t)
        assert got.base_sha256[k] == hashlib.sha256(",".join(own).encode()).hexdigest(), t
        assert set(own) <= set(got.spans[k].split(",")) | {""}
        assert (got.n_email[k], got.n_ip[k], got.n_card[k], got.n_phone[k]) == tuple(sum(s.startswith(kind) for s in own) for kind in BASE)


def test_checksums(spark):
    row = spark.range(1).select(
        pii.luhn(F.lit("4111111111111111")), pii.luhn(F.lit("4111111111111112")), pii.mod97(F.lit("370400440532013000DE89")), pii.mod97(F.lit("370400440532013001DE89"))
    )
    a, b, c, d = row.first()
    assert a and not b and c == 1 and d != 1


def test_empty_table_and_scores(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(none).count() == 0
    got = pii.find_pii(spark.createDataFrame([(1, "mail: a@b.cd"), (2, "a@b.cd")], "doc_id long, text string")).select("doc_id", "kind", "start", "end", "score")
    assert sorted(map(tuple, got.collect())) == [(1, "email", 6, 12, 1.0), (2, "email", 0, 6, 0.9)]


def test_no_python_in_the_plan(spark, hard):
    plan = pii.op11_pii(spark, hard)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange") == 1
