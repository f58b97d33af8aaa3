"""Token ids of texts and chats by a tokenizer file, in Arrow batches.

The tokenizer is the library's own, loaded once by each worker from a path that every executor has.
A chat is written turn by turn; loss is on what the assistant says and on the mark that ends it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Sequence

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; set before the library starts

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from quillstream.functions.jagged import pad_left
from quillstream.functions.masked import truncate
from quillstream.functions.messages import END_OF_TURN, TURN

#: What a chat format adds to the vocabulary.
SPECIALS = (TURN, END_OF_TURN)
CHAT_ROW = "struct<input_ids:array<int>,loss_mask:array<int>,sane:boolean>"
_loaded: dict = {}
#: Characters that are encoded, and ids that are decoded, at once, about: the library holds some hundred bytes
#: for each id until a call returns, so memory must not depend on Arrow's batches.
CHUNK = 200_000
#: Bytes of an Arrow batch, about: a worker and the executor each hold a batch of texts and one of ids for each task.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, for rows may be long.  A smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) <= BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def load(path: str, specials: Sequence[str] = ()):
    key = (path, tuple(specials))
    if key not in _loaded:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation(), t.no_padding()
        t.add_special_tokens(list(specials))
        _loaded[key] = t
    return _loaded[key]


def chunks(rows: Sequence, size: Callable) -> Iterator[Sequence]:
    """Slices of the rows of CHUNK in all, about, by the size of each; one row at least."""
    start = held = 0
    for k, row in enumerate(rows):
        if k > start and held + size(row) > CHUNK:
            yield rows[start:k]
            start, held = k, 0
        held += size(row)
    if start < len(rows):
        yield rows[start:]


def encode(texts: Sequence[str], path: str, specials: Sequence[str] = ()) -> list[np.ndarray]:
    t, out = load(path, specials), []
    for part in chunks(list(texts), len):
        out += [np.array(e.ids, np.int32) for e in t.encode_batch(part, add_special_tokens=False)]
    return out


def token_ids(text: Column, path: str, specials: Sequence[str] = ()) -> Column:
    """Ids of a text; null for null."""

    @F.pandas_udf("array<int>")
    def run(t: pd.Series) -> pd.Series:
        found = encode(t.fillna(""), path, specials)
        return pd.Series([None if no else ids for no, ids in zip(t.isna(), found)], dtype=object)

    return run(text)


def decoded(ids: Column, path: str, specials: Sequence[str] = ()) -> Column:
    """The text of ids, special tokens written out; null for null."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        t, out = load(path, specials), []
        for part in chunks(rows.tolist(), lambda r: 0 if r is None else len(r)):
            found = t.decode_batch([[] if r is None else [int(i) for i in r] for r in part], skip_special_tokens=False)
            out += [None if r is None else x for r, x in zip(part, found)]
        return pd.Series(out, dtype=object)

    return run(ids)


def fitted(ids: Column, width: int, pad: int = 0, side: str = "right") -> Column:
    """struct(input_ids, attention_mask) of ``width``: cut on a side, or padded on the left."""
    kept = truncate(ids, width, side)
    mask = pad_left(F.array_repeat(F.lit(1), F.size(kept)), width, 0)
    return F.struct(pad_left(kept, width, pad).alias("input_ids"), mask.alias("attention_mask"))


def chat_row(messages: Column, path: str) -> Column:
    """struct(input_ids, loss_mask, sane) of array<struct<role, content>>: header, content and end of each
    turn are encoded on their own; sane if they are the ids of the chat as a whole.  Null contents are
    empty; a chat without messages has no ids; null for null."""

    def size(chat) -> int:
        return sum(len(m["content"] or "") for m in (chat if chat is not None else ()))

    @F.pandas_udf(CHAT_ROW)
    def run(chats: pd.Series) -> pd.DataFrame:
        out = []
        for part in chunks(chats.tolist(), size):
            pieces, wholes = [], []
            for chat in part:
                turns = [(m["role"] or "", m["content"] or "") for m in (chat if chat is not None else ())]
                pieces.append([x for role, said in turns for x in ((f"{TURN}{role}\n", 0), (f"{said}{END_OF_TURN}\n", int(role == "assistant")))])
                wholes.append("".join(x for x, _ in pieces[-1]))
            flat = iter(encode([x for p in pieces for x, _ in p], path, SPECIALS))
            for p, whole in zip(pieces, encode(wholes, path, SPECIALS)):
                parts = [next(flat) for _ in p]
                ids = np.concatenate([np.zeros(0, np.int32), *parts])
                mask = np.repeat(np.array([own for _, own in p], np.int32), [len(x) for x in parts])
                out.append((ids, mask, np.array_equal(ids, whole)))
        return pd.DataFrame(out, columns=["input_ids", "loss_mask", "sane"])

    return F.when(messages.isNotNull(), run(messages))


def said(ids: Column, mask: Column) -> Column:
    """The ids that the loss is on."""
    return F.filter(F.transform(ids, lambda x, i: F.when(F.get(mask, i) == 1, x)), lambda x: x.isNotNull())
