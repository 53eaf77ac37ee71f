"""Operator 6: language identification by hierarchical discrimination.

A text's features are its lower-cased byte trigrams, hashed to a fixed number of buckets, damped and scaled to unit
length. First one-versus-rest linear support vector machines choose the language family; then one-versus-one
machines, trained on pairs of that family's languages only, vote among its members.

Defined results
- null texts and texts with no letter give ``und`` and score 0; other texts, however short, a learned language.
- ties go to the name that sorts first; repeated rows get the same prediction; an empty table, or one with nothing
  to learn from, gives ``und`` throughout.
- language, source and id are never inputs of a prediction; other columns are ignored.

Fitting reads a bounded sample: about ``per_language`` labelled texts of each language, chosen by a hash of the id; every
language with a labelled text is learned. Each machine is fitted in a task of its own: the sample's features, sparse, go once
to each machine that learns from them (a pair's machine from both languages, a family's from about ``PER_FAMILY`` texts in all),
and only weights of fixed width come to the driver: 16 kB for each family and for each pair within one, so the model grows with
the languages, never with the documents. Prediction reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.session import cut, shuffle_partitions, sized_join

DIM = 4096
PER_LANGUAGE = 600
PER_FAMILY = 12_000  # texts that a family's machine learns from

#: Language codes by family. A code that isn't listed is a family of its own.
FAMILIES = {
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "turkic": ["az", "kk", "tr", "uz"],
    "indo-aryan": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "semitic": ["am", "ar", "he", "mt"],
    "dravidian": ["kn", "ml", "ta", "te"],
}
_FAMILY_OF = {code: name for name, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    code = lang.lower().replace("_", "-").split("-")[0]
    return _FAMILY_OF.get(code, f"family of {code}")


def features(text: str) -> np.ndarray | None:
    """Unit vector of hashed trigrams; None where the text has no letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "replace") + b" ", np.uint8).astype(np.uint32)
    code = raw[:-2] * np.uint32(0x9E3779B1) ^ raw[1:-1] * np.uint32(0x85EBCA77) ^ raw[2:] * np.uint32(0xC2B2AE3D)
    code ^= code >> np.uint32(15)
    code *= np.uint32(0x2C1B3C6D)
    counts = np.bincount((code >> np.uint32(20)) & np.uint32(DIM - 1), minlength=DIM)
    v = np.sqrt(counts.astype(np.float32))
    return v / np.linalg.norm(v)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 120) -> np.ndarray:
    """Weights (bias last) of a linear machine with squared hinge loss, by accelerated gradient steps."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))).astype(np.float32)
    w = v = np.zeros(x.shape[1] + 1, np.float32)
    step, t = 1.0 / (1.0 + 4 * c * float(weight.max())), 1.0
    for _ in range(rounds):
        pull = y * np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * weight
        grad = v - 2 * c / len(y) * np.append(x.T @ pull, pull.sum())
        w, old = v - step * grad, w
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = w + (last - 1) / t * (w - old)
    return w


@dataclass
class Model:
    families: list[str] = field(default_factory=list)
    family_w: np.ndarray | None = None  # families x (DIM + 1)
    members: dict[str, list[str]] = field(default_factory=dict)
    pair_w: dict[str, np.ndarray] = field(default_factory=dict)  # family -> pairs x (DIM + 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        v = features(text) if text else None
        if v is None or not self.families:
            return "und", 0.0
        if len(self.families) == 1:
            family, p = self.families[0], 1.0
        else:
            m = self.family_w[:, :-1] @ v + self.family_w[:, -1]
            k = int(np.argmax(m))
            family, p = self.families[k], _squash(float(m[k]))
        langs = self.members[family]
        if len(langs) == 1:
            return langs[0], p
        m = self.pair_w[family][:, :-1] @ v + self.pair_w[family][:, -1]
        votes, margin = np.zeros(len(langs)), np.zeros(len(langs))
        for (i, j), x in zip(combinations(range(len(langs)), 2), m):
            votes[i if x >= 0 else j] += 1
            margin[i] += np.tanh(x)
            margin[j] -= np.tanh(x)
        k = int(np.argmax(votes + margin / (4 * len(langs))))
        return langs[k], p * _squash(float(margin[k]) / (len(langs) - 1))


def _squash(x: float) -> float:
    return float(1 / (1 + np.exp(-4 * max(-10.0, min(10.0, x)))))


def machines(langs: list[str], sizes: dict[str, int], per_language: int) -> list[tuple[str, str, str, int, float]]:
    """(machine, its kind, language, side, share of the language's sample) of all that machines learn from. A pair's machine
    is named by its two languages, a family's by the family."""
    out = []
    families = sorted({family_of(x) for x in langs})
    share = min(1.0, PER_FAMILY / max(1, sum(min(sizes[x], per_language) for x in langs)))
    if len(families) > 1:
        out += [(f, "family", x, 1 if family_of(x) == f else -1, share) for f in families for x in langs]
    for f in families:
        for a, b in combinations([x for x in langs if family_of(x) == f], 2):
            out += [(f"{a}\n{b}", "pair", a, 1, 1.0), (f"{a}\n{b}", "pair", b, -1, 1.0)]
    return out


def _packed(v: np.ndarray) -> bytes:
    at = np.flatnonzero(v)
    return at.astype(np.uint16).tobytes() + v[at].astype(np.float16).tobytes()


def _unpacked(raw: list[bytes]) -> np.ndarray:
    out = np.zeros((len(raw), DIM), np.float32)
    for row, r in zip(out, raw):
        n = len(r) // 4
        row[np.frombuffer(r, np.uint16, n)] = np.frombuffer(r, np.float16, n, 2 * n)
    return out


def _fitted(key: tuple, table: pa.Table) -> pa.Table:
    """One machine's weights; its rows in an order of their own, so that a lost task gives the same again."""
    rows = sorted(zip(table.column("side").to_pylist(), table.column("v").to_pylist()))
    w = fit_svm(_unpacked([r[1] for r in rows]), np.array([r[0] for r in rows], np.float32))
    return pa.table({"machine": [key[0].as_py()], "kind": [key[1].as_py()], "w": pa.array([w.astype(np.float32).tobytes()], pa.binary())})


def fit_on(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Fit on about ``per_language`` rows of each language of ``labelled``; rows with a null text, no letter or a null language don't count."""
    rows = labelled.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).alias("_lang")).where("_text IS NOT NULL AND _lang IS NOT NULL")
    spark = labelled.sparkSession
    counts = cut(rows.groupBy("_lang").agg(F.count("*").alias("_count")))
    place = F.pmod(F.xxhash64("_id", F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.least(F.lit(1.0), F.lit(float(per_language)) / F.col("_count"))
    sample = sized_join(rows, counts, ["_lang"], "inner").withColumn("_place", place / rate).where("_place < 1").select("_lang", "_text", "_place")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(lang, p, v) for lang, text, p in zip(*(batch.column(k).to_pylist() for k in range(3))) if (v := features(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([_packed(g[2]) for g in got], pa.binary())], names=["lang", "place", "v"])

    sample = cut(sample.mapInArrow(vectors, "lang string, place double, v binary"))
    sizes = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    if not sizes:
        return Model()
    langs = sorted(sizes)
    model = Model(sorted({family_of(x) for x in langs}))
    model.members = {f: [x for x in langs if family_of(x) == f] for f in model.families}
    plan = machines(langs, sizes, per_language)
    weights: dict[tuple[str, str], np.ndarray] = {}
    if plan:
        learn = sized_join(sample, spark.createDataFrame(plan, "machine string, kind string, lang string, side int, share double"), ["lang"], "inner").where("place < share")
        got = learn.repartition(min(len(plan), shuffle_partitions(spark)), "machine").groupBy("machine", "kind").applyInArrow(lambda key, t: _fitted(key, t), "machine string, kind string, w binary")
        weights = {(r["kind"], r["machine"]): np.frombuffer(r["w"], np.float32) for r in got.collect()}
    if len(model.families) > 1:
        model.family_w = np.vstack([weights["family", f] for f in model.families])
    for f, own in model.members.items():
        pairs = [weights["pair", f"{a}\n{b}"] for a, b in combinations(own, 2)]
        model.pair_w[f] = np.vstack(pairs) if pairs else np.zeros((0, DIM + 1), np.float32)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def fit_documents(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    return fit_on(docs.where(~held_out()), per_language=per_language)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = predict(docs, fit_documents(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
