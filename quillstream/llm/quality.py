"""Quality classifier: a generalised additive model with pairwise interactions.

Boosting goes round the features in a cycle; each turn fits a shallow tree on one feature's bins
to the residuals and adds it, shrunk, to that feature's lookup table.  Then the pairs of
features that explain most of what is left get small two-way tables in the same manner.  A
score is a sum of table entries: two lookups and an addition for a whole batch at a time.
"""

from __future__ import annotations

import itertools
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.core import arrays, blocks, crc_mod, staged, table, utf8
from quillstream.shipping import ship

#: Labelled rows the tables are fitted on, at most; documented bound.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 48, 12, 6
ROUNDS, RATE, LEAVES, LEAST = 160, 0.1, 4, 10
THRESHOLD, FOLDS, HELD_OUT = 0.3, 5, 0
BLOCK_BYTES = 4_000_000
NAMES = ("log_bytes", "log_words", "word_length", "upper", "digits", "stops", "commas", "bangs", "bars", "stars", "other_marks", "non_ascii", "distinct_words", "top_word", "log_lines", "repeated_lines", "line_length", "marked_words", "entropy", "longest_word", "no_stop_lines", "distinct_pairs")
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(text: bytes) -> list[float]:
    """What is counted in a whole text, as UTF-8; an empty text has zeros."""
    if not text:
        return [0.0] * len(NAMES)
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n = len(text)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    m, rows = max(1, len(words)), max(1, len(lines))
    letters = max(1, int(c[_LETTERS].sum()))
    marks = np.concatenate([c[33:48], c[58:65], c[91:97], c[123:127]]).sum()
    p = c[c > 0] / n
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = Counter(w[-1] for w in words)
    commas, bangs, bars = c[44] + c[59] + c[58], c[33] + c[63], c[124]
    stars = c[42] + c[35] + c[36] + c[37] + c[38]
    return [
        np.log1p(n), np.log1p(len(words)), float(lengths.mean()) if len(words) else 0.0, c[65:91].sum() / letters, c[48:58].sum() / n, c[46] / m, commas / m, bangs / m, bars / m, stars / n,
        (marks - commas - bangs - bars - stars - c[46]) / n, c[128:].sum() / n, len(set(words)) / m, max(Counter(words).values(), default=0) / m, np.log1p(len(lines)), 1 - len(set(lines)) / rows, n / rows,
        sum(v for k, v in ends.items() if not _LETTERS[k] and not 48 <= k < 58) / m, float(-(p * np.log2(p)).sum()), float(lengths.max()) if len(words) else 0.0, sum(not x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / rows,
        len(set(zip(words, words[1:]))) / max(1, len(words) - 1),
    ]


def _featurise(batches):
    for batch in blocks(batches, "text", BLOCK_BYTES):
        x = np.array([features(t) for t in utf8(batch.column("text"))], np.float32).reshape(batch.num_rows, len(NAMES))
        yield arrays(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), x=pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32())))


def cuts(x: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins of about equal counts; equal values share a bin."""
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Newton steps by bin of a tree with up to ``leaves`` leaves over ordered bins, given sums of
    gradients, Hessians and counts by bin.  The best split of all leaves is made first."""
    parts = [(0, len(g))]
    cg, ch, cn = (np.concatenate([[0], np.cumsum(v)]) for v in (g, h, n))
    value = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for a, b in parts:
            k = np.arange(a + 1, b)
            ok = (cn[k] - cn[a] >= LEAST) & (cn[b] - cn[k] >= LEAST)
            if ok.any():
                gain = np.where(ok, (cg[k] - cg[a]) ** 2 / (ch[k] - ch[a] + 1.0) + (cg[b] - cg[k]) ** 2 / (ch[b] - ch[k] + 1.0) - value(a, b), -1)
                if gain.max() > best[0]:
                    best = (float(gain.max()), (a, b), int(k[gain.argmax()]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Lookup tables for features and pairs, and a base rate."""
    n, d = x.shape
    if n == 0 or y.min() == y.max():
        rate = (y.sum() + 1) / (n + 2)
        return {"base": float(np.log(rate / (1 - rate))), "edges": [np.zeros(0)] * d, "tables": [np.zeros(1)] * d, "pairs": []}
    edges = [cuts(x[:, j], BINS) for j in range(d)]
    bins = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)], 1)
    sizes = [len(e) + 1 for e in edges]
    base = float(np.log(y.mean() / (1 - y.mean())))
    score, tables = np.full(n, base), [np.zeros(s) for s in sizes]
    ns = [np.bincount(bins[:, j], minlength=sizes[j]) for j in range(d)]
    for _ in range(ROUNDS):
        for j in range(d):
            p = 1 / (1 + np.exp(-score))
            step = RATE * tree(np.bincount(bins[:, j], y - p, sizes[j]), np.bincount(bins[:, j], p * (1 - p), sizes[j]), ns[j])
            tables[j] += step
            score += step[bins[:, j]]
    coarse = [cuts(x[:, j], PAIR_BINS) for j in range(d)]
    small = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(coarse)], 1)
    p = 1 / (1 + np.exp(-score))
    gains = []
    for i, j in itertools.combinations(range(d), 2):
        w = len(coarse[j]) + 1
        cell = small[:, i] * w + small[:, j]
        g, h = np.bincount(cell, y - p), np.bincount(cell, p * (1 - p))
        gains.append((float((g**2 / (h + 5)).sum()), i, j))
    pairs = []
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        pairs.append([i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))])
    for _ in range(ROUNDS // 4):
        for i, j, t in pairs:
            p = 1 / (1 + np.exp(-score))
            cell = small[:, i] * t.shape[1] + small[:, j]
            g, h, c = (np.bincount(cell, v, t.size).reshape(t.shape) for v in (y - p, p * (1 - p), np.ones(n)))
            # cut the first feature in two, then each half along the second
            cg, ch, cc = g.sum(1).cumsum(), h.sum(1).cumsum(), c.sum(1).cumsum()
            ok = (cc[:-1] >= LEAST) & (cc[-1] - cc[:-1] >= LEAST)
            if not ok.any():
                continue
            k = int(np.where(ok, cg[:-1] ** 2 / (ch[:-1] + 1) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + 1), -1).argmax()) + 1
            for rows in (slice(0, k), slice(k, None)):
                t[rows] += RATE * tree(g[rows].sum(0), h[rows].sum(0), c[rows].sum(0), 3)[None]
            score = score_all(x, base, edges, tables, coarse, pairs)
    return {"base": base, "edges": edges, "tables": tables, "coarse": coarse, "pairs": pairs}


def score_all(x, base, edges, tables, coarse=(), pairs=()) -> np.ndarray:
    s = np.full(len(x), base)
    for j, (e, t) in enumerate(zip(edges, tables)):
        s += t[np.searchsorted(e, x[:, j], "right")]
    for i, j, t in pairs:
        s += t[np.searchsorted(coarse[i], x[:, i], "right"), np.searchsorted(coarse[j], x[:, j], "right")]
    return s


def _score(model: dict):
    def run(batches):
        for batch in batches:
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, len(NAMES))
            s = 1 / (1 + np.exp(-score_all(x, **model)))
            yield arrays(doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), score=s, predicted=(s >= THRESHOLD).astype(np.int32))

    return run


def classify(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``df``.

    Labels (an id's largest, if it has several; null ones don't count) of rows outside the
    held-out fold train the tables.  Null and empty texts have the same features, zeros; without
    labels of both kinds all scores are the smoothed base rate; repeated rows get equal results;
    an empty table stays empty; other columns are ignored.
    """
    ship(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(crc_mod("doc_id", FOLDS), F.lit(1)) == HELD_OUT)
    seen = staged(rows.mapInArrow(_featurise, "doc_id long, held_out boolean, x array<float>"), "features")
    known = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    drawn = seen.where(~F.col("held_out")).join(known, "doc_id").select(F.xxhash64("doc_id").alias("place"), "x", "y").orderBy("place", "x").limit(sample).toArrow()
    x = np.asarray(drawn.column("x").combine_chunks().flatten()).reshape(drawn.num_rows, len(NAMES))
    model = fit(x, np.asarray(drawn.column("y"), np.float64))
    return seen.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def op9_quality(spark, sf_dir):
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
