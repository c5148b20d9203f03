"""Operator 7: language identification by hierarchical discrimination.

A text is a normalised vector of hashed byte 1- to 3-grams.  Linear support vector machines first choose
the language family (one against the rest), then one-versus-one machines separate the languages of that
family; votes decide, margins break ties.

Training reads a bounded sample of labelled rows (``SAMPLE`` texts over all languages); the machines are
fitted in Spark tasks, one per family or pair.  Prediction is one scan of whole texts.

Defined results: ``und`` with score 0 for a null text, an empty text or one without a letter, and for
every text if there is no labelled row.  Repeated rows get equal results.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm import textscan as ts
from pagelake.llm.common import add_columns, fold, fresh, q, read, uniform

DIM = 1 << 13
SAMPLE = 4000        # labelled texts that the machines are fitted on, over all languages
SAMPLE_EACH = 800    # and of one language at most
EPOCHS = 8
HELD_OUT = 2         # the held-out remainder of crc32(doc_id) modulo 4

# Language codes by family.  Other codes form the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "indic": "hi bn mr ur pa gu ne",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "semitic": "ar he mt am",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang.split("-")[0].split("_")[0].lower(), "other")


def featurise(column) -> np.ndarray:
    """One unit vector of hashed byte n-grams per text; digits and ASCII punctuation count as blanks."""
    parts = [np.zeros((0, DIM), np.float32)]
    for _, off, raw in ts.slices(column, 1 << 18):
        n = len(off) - 1
        data = ts.fold_case(raw)
        data[~ts.LETTERS[data]] = 32
        doc = np.repeat(np.arange(n), np.diff(off))
        counts = np.zeros(n * DIM, np.int64)
        code = data.astype(np.uint32)
        for size in (1, 2, 3):
            m = len(data) - size + 1
            if m <= 0:
                break
            key = code[:m].copy()
            for k in range(1, size):
                key = (key << np.uint32(8)) | code[k: k + m]
            key = ((key + np.uint32(size << 26)) * np.uint32(2654435761)) >> np.uint32(19)
            same = doc[:m] == doc[size - 1:]
            counts += np.bincount(doc[:m][same] * DIM + key[same], minlength=n * DIM)
        x = np.sqrt(counts.reshape(n, DIM).astype(np.float32))
        norm = np.sqrt((x * x).sum(1, keepdims=True))
        parts.append(x / np.maximum(norm, 1e-9))
    return np.concatenate(parts)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent (L2 loss), the bias as a constant feature."""
    w, bias = np.zeros(x.shape[1], np.float32), 0.0
    alpha = np.zeros(len(y))
    share = {s: len(y) / (2.0 * max(1, int((y == s).sum()))) for s in (-1, 1)}
    inv = np.array([1.0 / (2 * c * share[int(s)]) for s in y])
    square = (x * x).sum(1) + 1.0 + inv
    order = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(y)):
            gradient = y[i] * (float(x[i] @ w) + bias) - 1 + alpha[i] * inv[i]
            new = max(alpha[i] - gradient / square[i], 0.0)
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return w, bias


def _fit(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["y", "text"])
    w, bias = fit_svm(featurise(pa.array(pdf["text"])), pdf["y"].to_numpy())
    return pd.DataFrame({"kind": [pdf["kind"].iloc[0]], "a": [pdf["a"].iloc[0]], "b": [pdf["b"].iloc[0]],
                         "w": [w.tobytes()], "bias": [float(bias)]})


def train(labelled: DataFrame, text: str, lang: str, key: str) -> dict:
    """The machines as plain arrays.  Their number follows the number of languages, not of rows."""
    spark = labelled.sparkSession
    rows = labelled.select(q(text).alias("text"), q(lang).alias("lang"), q(key).alias("key")).where(
        F.col("lang").isNotNull() & F.col("text").rlike("\\p{L}"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return {"langs": []}
    each = max(20, min(SAMPLE_EACH, SAMPLE // len(langs)))
    share = F.create_map(*[F.lit(v) for k in langs for v in (k, each / counts[k])])
    sample = rows.where(uniform(F.col("key"), F.xxhash64("text"), seed=11) < share[F.col("lang")])
    families = sorted({family_of(x) for x in langs})
    tasks = []
    for f in families if len(families) > 2 else families[:1] if len(families) == 2 else []:
        tasks += [("family", f, "", x, 1 if family_of(x) == f else -1) for x in langs]
    for i, a in enumerate(langs):
        for b in langs[i + 1:]:
            if family_of(a) == family_of(b):
                tasks += [("pair", a, b, a, 1), ("pair", a, b, b, -1)]
    model = {"langs": langs, "families": families, "family": {}, "pair": {}}
    if tasks:
        plan = spark.createDataFrame(tasks, "kind string, a string, b string, lang string, y int")
        fitted = sample.join(F.broadcast(plan), "lang").groupBy("kind", "a", "b").applyInPandas(
            _fit, "kind string, a string, b string, w binary, bias double")
        for r in fitted.collect():
            key_ = r["a"] if r["kind"] == "family" else (r["a"], r["b"])
            model[r["kind"]][key_] = (np.frombuffer(r["w"], np.float32), r["bias"])
    return model


def predict(x: np.ndarray, model: dict) -> tuple[list[str], np.ndarray]:
    families, groups = model["families"], defaultdict(list)
    for lang in model["langs"]:
        groups[family_of(lang)].append(lang)
    n = len(x)
    margin = np.zeros((n, len(families)))
    for j, f in enumerate(families):
        if f in model["family"]:
            w, bias = model["family"][f]
            margin[:, j] = x @ w + bias
    if len(families) == 2 and families[0] in model["family"]:
        margin[:, 1] = -margin[:, 0]
    best = margin.argmax(1)
    sure = 1 / (1 + np.exp(-4 * margin[np.arange(n), best])) if len(families) > 1 else np.ones(n)
    out, score = np.empty(n, object), np.asarray(sure, float)
    for j, f in enumerate(families):
        at = np.flatnonzero(best == j)
        langs = groups[f]
        votes, total, least = np.zeros((len(at), len(langs))), np.zeros((len(at), len(langs))), np.full((len(at), len(langs)), 9.0)
        for i, a in enumerate(langs):
            for k in range(i + 1, len(langs)):
                if (a, langs[k]) in model["pair"]:
                    w, bias = model["pair"][(a, langs[k])]
                    m = x[at] @ w + bias
                    votes[:, i] += m > 0
                    votes[:, k] += m <= 0
                    for col, signed in ((i, m), (k, -m)):
                        total[:, col] += signed
                        least[:, col] = np.minimum(least[:, col], signed)
        pick = (votes + 0.5 / (1 + np.exp(-total))).argmax(1) if len(at) else np.zeros(0, int)
        out[at] = np.array(langs, object)[pick]
        if len(langs) > 1:
            score[at] *= 1 / (1 + np.exp(-4 * least[np.arange(len(at)), pick]))
    return list(out), score


def identify(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred`` and ``score`` (underscored if taken), from the text alone."""
    lang, score = fresh(df, "lang_pred", "score")
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def compute(columns):
        for column in columns:
            langs, scores = ["und"] * len(column), np.zeros(len(column))
            if shipped.value["langs"]:
                for a in range(0, len(column), 512):
                    got, sure = predict(featurise(column.slice(a, 512)), shipped.value)
                    langs[a: a + len(got)], scores[a: a + len(got)] = got, sure
            yield [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    out = add_columns(df, text, compute, {"lang_pred": "string", "score": "double"})
    blank = ~F.coalesce(q(text).rlike("\\p{L}"), F.lit(False))
    return out.select(*[q(c) for c in df.columns], F.when(blank, "und").otherwise(q(lang)).alias(lang),
                      F.when(blank, 0.0).otherwise(q(score)).alias(score))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != HELD_OUT), "text", "lang", "doc_id")
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold("doc_id", 4) == HELD_OUT).alias("held_out"), "lang_pred", "score")
