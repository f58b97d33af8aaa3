"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of 1 to 3 letters are hashed into DIMS counts of a whole text.  Document frequencies
come from all training rows.  The weights are trained on a bounded, hashed sample by
follow-the-regularised-leader with L1 and L2 penalties, and a temperature fitted on a part of
the sample that the weights have not seen makes the scores probabilities.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import arrays, blocks, crc_mod, small_batches, table
from quillstream.shipping import ship

DIMS, ORDERS = 1 << 14, (1, 2, 3)
#: Documents the weights and the temperature are fitted on, at most; documented bound.
SAMPLE = 3000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.002, 0.01, 3
BLOCK_BYTES = 4_000_000
UNKNOWN = "und"
FOLDS, HELD_OUT = 5, 0


@functools.cache
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def counts(text: str) -> np.ndarray | None:
    """Hashed n-gram counts of a text, or None if it has no letter.  Runs of other characters
    are one boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    is_letter = letters()[points]
    if not is_letter.any():
        return None
    c = np.where(is_letter, points, 32).astype(np.uint32)
    c = np.concatenate([[np.uint32(32)], c, [np.uint32(32)]])
    c = c[~((c == 32) & np.concatenate([[False], c[:-1] == 32]))]
    total = np.zeros(DIMS, np.int64)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS and len(h):
            k = h ^ (h >> np.uint32(15))
            k = k * np.uint32(0x85EBCA6B)
            total += np.bincount((k >> np.uint32(18)).astype(np.int64), minlength=DIMS)
    return total


def vector(count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(count) * idf
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def _document_frequency(batches):
    seen = np.zeros(DIMS + 1, np.int64)
    for batch in blocks(batches, "text", BLOCK_BYTES):
        for text in batch.column("text").to_pylist():
            if (c := counts(text)) is not None:
                seen[:-1] += c > 0
                seen[-1] += 1
    yield arrays(dim=np.flatnonzero(seen).astype(np.int32), n=seen[seen > 0])


def _sample_counts(batches):
    for batch in blocks(batches, "text", BLOCK_BYTES):
        keep, dims, found = [], [], []
        for i, t in enumerate(batch.column("text").to_pylist()):
            if (c := counts(t)) is not None:
                at = np.flatnonzero(c)
                keep.append(i)
                dims.append(at.astype("<u2").tobytes())
                found.append(c[at].astype("<u4").tobytes())
        keep = pa.array(keep, pa.int64())
        yield arrays(place=batch.column("place").take(keep), lang=batch.column("lang").take(keep), dims=pa.array(dims, pa.binary()), counts=pa.array(found, pa.binary()))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, classes) and biases, from (dims, values, class) rows in their order."""
    z, n = np.zeros((DIMS + 1, classes)), np.zeros((DIMS + 1, classes))

    def weights(at, l1):
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((BETA + np.sqrt(nn)) / ALPHA + L2))

    bias = np.array([DIMS])
    for _ in range(EPOCHS):
        for at, values, y in rows:
            w, b = weights(at, L1), weights(bias, 0.0)[0]
            s = values @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            for ix, w_, g in ((at, w, values[:, None] * p), (bias, b[None], p[None])):
                sigma = (np.sqrt(n[ix] + g * g) - np.sqrt(n[ix])) / ALPHA
                z[ix] += g - sigma * w_
                n[ix] += g * g
    return weights(np.arange(DIMS), L1), weights(bias, 0.0)[0]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, on a grid."""
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 20, 121) if len(y) else ():
        s = logits / t
        s = s - s.max(1, keepdims=True)
        loss = float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(y)), y]))
        best = min(best, (loss, float(t)))
    return best[1]


def fit(df: DataFrame, sample: int = SAMPLE) -> dict:
    """A model from rows (text, lang, place), lang not null: ``place`` is a hash that orders the
    rows.  The sample has about as many rows of each language."""
    # of more languages than the sample has rows, the rarest have none in it
    by = {r["lang"]: r["n"] for r in df.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(sample).collect()}
    names = sorted(by)
    if not names:
        return {"names": []}
    seen = np.zeros(DIMS + 1, np.int64)
    for r in df.select("text").mapInArrow(_document_frequency, "dim int, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect():  # DIMS rows
        seen[r["dim"]] = r["n"]
    idf = np.log((1 + seen[-1]) / (1 + seen[:-1])) + 1
    share = F.create_map(*[x for k in names for x in (F.lit(k), F.lit(min(1.0, 1.3 * sample / len(names) / by[k])))])
    drawn = df.where((F.col("place") % 1_000_000) / 1e6 < share[F.col("lang")]).orderBy("place", "text").limit(sample)
    rows = drawn.mapInArrow(_sample_counts, "place long, lang string, dims binary, counts binary").collect()
    made = []
    for r in sorted(rows, key=lambda r: (r["place"], r["lang"], r["dims"])):
        at = np.frombuffer(r["dims"], "<u2").astype(np.int64)
        v = np.log1p(np.frombuffer(r["counts"], "<u4")) * idf[at]
        made.append((at, v / max(float(np.sqrt(v @ v)), 1e-12), names.index(r["lang"])))
    calibration, training = made[: len(made) // 5], made[len(made) // 5 :]
    w, b = ftrl(training, len(names))
    logits = np.array([v @ w[at] + b for at, v, _ in calibration]).reshape(-1, len(names))
    t = temperature(logits, np.array([y for *_, y in calibration], np.int64))
    return {"names": names, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "b": b, "t": t}


def predict(texts: list[str | None], model: dict) -> tuple[list[str], np.ndarray]:
    """(language, score) of each text, some texts at a time: a text's counts are a dense vector."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    for k in range(0, len(texts) if model["names"] else 0, 64):
        found = [(i, c) for i, t in enumerate(texts[k : k + 64], k) if t and (c := counts(t)) is not None]
        if found:
            s = (np.stack([vector(c, model["idf"]) for _, c in found]) @ model["w"] + model["b"]) / model["t"]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for (i, _), y, best in zip(found, p.argmax(1), p.max(1)):
                names[i], scores[i] = model["names"][y], best
    return names, scores


def _predict(model: dict):
    def run(batches):
        for batch in blocks(batches, "text", BLOCK_BYTES):
            names, scores = predict(batch.column("text").to_pylist(), model)
            yield arrays(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), lang_pred=pa.array(names, pa.string()), score=scores)

    return run


def _keep(model: dict, text: str, least: float):
    """The batches without rows whose language can't be told."""

    def run(batches):
        for batch in blocks(batches, text, BLOCK_BYTES):
            names, scores = predict(batch.column(text).to_pylist(), model)
            yield batch.filter(pa.array([n != UNKNOWN and s > least for n, s in zip(names, scores)]))

    return run


def training_rows(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """(doc_id, held_out, text, lang) of all rows."""
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    return rows.withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS), F.lit(1)) == HELD_OUT)


def fit_rows(rows: DataFrame, sample: int = SAMPLE) -> dict:
    """A model of the rows outside the held-out fold that have a text and a language."""
    train = rows.where(~F.col("held_out") & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return fit(train.select("text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)).alias("place")), sample)


def identify(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row, learned from rows outside the held-out
    fold.  Texts that are null or have no letter, and all texts where nothing can be learned,
    are ``und`` with score 0; a null id is in the training fold of the text ``null``'s hash;
    repeated rows get equal results; an empty table stays empty; other columns are ignored."""
    ship(df.sparkSession)
    rows = training_rows(df, key, text, lang)
    model = fit_rows(rows, sample)
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def stage_language_id(spark, docs, sf_dir):
    """Pipeline stage: rows whose language can't be told (no letter, or a score of half or
    less) go; the others keep their columns."""
    small_batches(spark)
    model = fit_rows(training_rows(docs, "doc_id", "text", "lang"))
    return docs.mapInArrow(_keep(model, "text", 0.5), docs.schema)
