import random

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator must take: nulls, empties, blanks, repeats, ties, shared ids, long texts.
HARD = [
    (1, None, None, None, None), (2, "", "en", "b", 0), (3, " \t\n ", "en", None, 4), (4, "the cat sat on the mat", "en", "a", 22), (5, "the cat sat on the mat", "en", "a", 22),
    (6, "The  cat sat\non the mat", "en", "b", 23), (7, "the cat sat on the mat", None, "a", 22), (7, "the cat sat on the mat", None, "a", 22), (8, "x", "fr", "c", 1), (9, "123 456 !!!", None, "c", 11),
    (10, "une phrase avec des mots " * 4000, "fr", "a", 100000), (11, "été naïve 🙂 ß", "fr", "b", 13), (12, "der hund und die katze " * 30, "de", "d", 690),
]


def hard(spark, extra: bool = False):
    df = spark.createDataFrame(HARD, DOCS)
    if extra:  # names that operators use inside
        for name in ("size", "shard", "digest", "keep_id", "score", "block", "component", "bucket", "n"):
            df = df.withColumn(name, df["doc_id"] * 0)
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents():
    return duckdb.sql(f"SELECT * FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()


def near_copies(seed: int = 0, groups: int = 12, size: int = 8):
    """Texts in groups of edited copies, some far enough apart to link only through others."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    out = []
    for _ in range(groups):
        base = [word() for _ in range(rng.randint(5, 120))]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randint(1, 3))]
            out.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base
    rng.shuffle(out)
    return out
