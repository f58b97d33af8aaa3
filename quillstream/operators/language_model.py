"""The language of a text by naive Bayes over hashed letter n-grams, learned from labelled texts.

A task counts the n-grams of its texts in one table of languages and buckets and sends the sums, so
that learning reads every text once and shuffles a row for each bucket and task at most.  What is
learned is one array of log probabilities for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of n-grams, lengths of these, languages at most, and texts of a block.
BUCKETS, LENGTHS, LANGUAGES, BLOCK = 1 << 15, (1, 2, 3), 500, 256
_STEP = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
SMOOTHING = 0.5


def _letters() -> np.ndarray:
    """For each code point of the lower planes, what it counts as: its lower-case letter, or 0."""
    codes = np.arange(0x10000, dtype=np.uint32)
    out = np.zeros(len(codes), np.uint32)
    for c in codes.tolist():
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_table: list[np.ndarray] = []


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, text) of each n-gram of letters; runs of other characters, and the ends of a text, are one
    gap, which n-grams of two and three may begin and end with."""
    if not _table:
        _table.append(_letters())
    raw = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "replace"), "<u4")
    code = np.where(raw < 0x10000, _table[0][np.minimum(raw, 0xFFFF)], raw)
    of = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)) + 2)
    keep = np.concatenate([[True], (code[1:] != 0) | (code[:-1] != 0) | (of[1:] != of[:-1])]) if len(code) else np.zeros(0, bool)
    of = of[keep]
    code = code[keep].astype(np.uint64)
    buckets, texts_of = [], []
    for n in LENGTHS:
        if len(code) < n:
            continue
        h, some, same = np.zeros(len(code) - n + 1, np.uint64), np.zeros(len(code) - n + 1, bool), np.ones(len(code) - n + 1, bool)
        for k in range(n):
            part = code[k : k + len(h)]
            h += (part + np.uint64(n)) * np.uint64(_STEP[k])
            some |= part != 0
            if 0 < k < n - 1:
                same &= part != 0  # no gap inside
        some &= same & (of[: len(h)] == of[n - 1 : n - 1 + len(h)])
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        buckets.append((h[some] >> np.uint64(32)).astype(np.int64) % BUCKETS)
        texts_of.append(of[: len(h)][some])
    return (np.concatenate(buckets), np.concatenate(texts_of)) if buckets else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def gram_counts(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, bucket, n) over all texts with a language; null and empty texts have no n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                bucket, of = grams([t or "" for t in part.column("t").to_pylist()])
                names = np.array(part.column("l").to_pylist(), object)
                for name in set(names.tolist()):
                    mine = counts.setdefault(name, np.zeros(BUCKETS, np.int64))
                    mine += np.bincount(bucket[names[of] == name], minlength=BUCKETS)
        for name, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})

    rows = df.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("l"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def profiles(df: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, grams, weights): log probabilities of the buckets, and last of one not seen, an array for each language."""
    counts = gram_counts(df, lang, text)
    total = F.sum("n").alias("grams")
    made = counts.groupBy("lang").agg(total, F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("_m"))  # BUCKETS entries at most
    log = lambda k: F.log((F.coalesce(F.element_at("_m", k.cast("int")), F.lit(0)) + SMOOTHING) / (F.col("grams") + SMOOTHING * BUCKETS))
    return made.select("lang", "grams", F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), log).alias("weights"))


class LanguageModel:
    """Profiles of a few languages, told to all tasks."""

    def __init__(self, names: list[str], weights: np.ndarray):
        self.names, self.weights = names, weights

    @staticmethod
    def of(found: DataFrame) -> LanguageModel:
        rows = found.orderBy("lang").limit(LANGUAGES + 1).collect()  # one row for each language
        if len(rows) > LANGUAGES:
            raise ValueError(f"more than {LANGUAGES} languages")
        return LanguageModel([r["lang"] for r in rows], np.array([r["weights"] for r in rows], np.float32).reshape(len(rows), BUCKETS))

    def guess(self, texts: list[str | None]) -> list[str | None]:
        out: list[str | None] = []
        for at in range(0, len(texts), BLOCK):
            part = [t or "" for t in texts[at : at + BLOCK]]
            bucket, of = grams(part)
            scores = np.stack([np.bincount(of, w[bucket], len(part)) for w in self.weights], 1) if self.names else np.zeros((len(part), 1))
            any_ = np.bincount(of, minlength=len(part)) > 0
            out += [self.names[k] if ok and self.names else None for k, ok in zip(scores.argmax(1).tolist(), any_.tolist())]
        return out

    def language(self, text: Column) -> Column:
        """The likeliest language; null for texts without letters."""
        told = self  # sent with the function

        @F.pandas_udf("string")
        def run(t: pd.Series) -> pd.Series:
            return pd.Series(told.guess(t.tolist()), dtype=object)

        return run(text)
