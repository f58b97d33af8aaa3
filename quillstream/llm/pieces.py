"""SentencePiece encoding and decoding with a table of merge types over prefixes.

A BPE model of pieces merges the best pair of neighbours until none is left.  The same pieces
follow from one pass: for each prefix of a text the last piece of its encoding is unique, and it
is the one match of an automaton over all pieces that ends there and that is compatible with the
last piece of the prefix before it.  Two pieces are compatible if merging would not have joined
anything across their border, which their merge trees tell.  Once the table is full, the pieces
are read off backwards.  No queue of merges is kept, and time grows with the length of the text.

No piece has a space after another character, and a character that no piece has (a new line, say)
becomes bytes: a text may be cut before both, and each distinct segment is encoded once.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstream.llm.core import Interner, blocks, ranges, table, trim
from quillstream.shipping import ship

SPACE = "▁"
BLOCK_BYTES, CACHED_SEGMENTS, KNOWN_PAIRS = 1_500_000, 200_000, 1_000_000
#: Put before what starts a segment, where texts don't hold it themselves.
MARK = "\x01"


class PieceModel:
    """The tables of one model file: pieces, merge order, merge trees and the automaton."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {i: int(self.texts[i][1:-1], 16) for i in range(n) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.bytes.items()}
        self.silent = {i for i in range(n) if model.is_control(i)}
        self.unknown = model.unk_id()
        usual = [i for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
        self.ids = {self.texts[i]: i for i in usual}
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in usual}, reverse=True))}
        self.rank = {i: order[model.get_score(i)] for i in usual}  # pieces of equal score have equal rank
        self.check(model)
        self.tree: dict[int, tuple[int, int] | None] = {}
        for i in usual:
            self.tree[i] = self.halves(self.texts[i])
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for i in usual:
            if len(self.texts[i]) == 1 or self.tree[i]:
                self.automaton.add_word(self.texts[i], (len(self.texts[i]), i))
        self.automaton.make_automaton()

    def check(self, model) -> None:
        """Refuse what the table does not hold for: other kinds of models and normalisers."""
        plain = all(len(self.texts[i]) == 1 or all(c in self.ids for c in self.texts[i]) for i in self.ids.values())
        joined = any(SPACE in t.lstrip(SPACE) for t in self.ids)
        probe = " A  ﬁ́\t▁ b "
        same = "".join(model.encode(probe, out_type=str)) == "".join(self.escape(probe, lambda c: c in self.ids))
        if not plain or joined or not same or len(self.of_byte) != 256:
            raise ValueError("not a BPE model with byte fallback, a leading space and texts left as they are")

    def escape(self, text: str, known) -> list[str]:
        """The characters of a text as pieces write them, bytes for those that no piece has."""
        return [c if known(c) else "".join(f"<0x{b:02X}>" for b in c.encode()) for c in SPACE + text.replace(" ", SPACE)] if text else []

    def halves(self, piece: str) -> tuple[int, int] | None:
        """The two pieces whose merge makes this one, by merging its characters; None where
        merging ends elsewhere (such a piece is never used) or it is one character."""
        parts, last = list(piece), None
        while len(parts) > 1:
            pairs = [(self.rank[i], k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None]
            if not pairs:
                return None
            k = min(pairs)[1]
            last = (self.ids[parts[k]], self.ids[parts[k + 1]])
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both texts together is these two pieces.  The later merge of
        both is undone until single characters are left; a piece made of the two at the border
        by an earlier merge than the one just undone would have taken its place."""
        key = left << 32 | right
        found = self.fits.get(key)
        if found is None:
            found = self.fits[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        a, b, limit = left, right, len(self.rank) + 1
        while True:
            joined = self.ids.get(self.texts[a] + self.texts[b])
            if joined is not None and self.rank[joined] < limit:
                return False
            at, bt = self.tree[a], self.tree[b]
            if at and (not bt or self.rank[a] > self.rank[b]):
                limit, a = self.rank[a], at[1]
            elif bt:  # of equal merges the left one comes first: the joined piece wins a tie
                limit, b = self.rank[b] + 1, bt[0]
            else:
                return True

    def encode(self, segment: str) -> list[int]:
        """Ids of a segment whose spaces are written as pieces write them."""
        last = [-1] * len(segment)
        size = [1] * len(segment)
        fits, test = self.fits, self.compatible
        for end, (n, piece) in self.automaton.iter(segment):
            if last[end] >= 0:
                continue  # the last piece of a prefix is unique
            if n > end:
                last[end], size[end] = piece, n
                continue
            before = last[end - n]
            if before >= 0:
                fit = fits.get(before << 32 | piece)
                if not (test(before, piece) if fit is None else fit):
                    continue
            last[end], size[end] = piece, n
        out, at = [], len(segment) - 1
        while at >= 0:
            if last[at] >= 0:
                out.append(last[at])
            else:  # no piece has this character
                out.extend(self.of_byte[x] for x in reversed(segment[at].encode("utf-8", "surrogatepass")))
            at -= size[at]
        return out[::-1]

    def decode(self, ids: list[int]) -> str:
        """The text of ids: runs of bytes are read as UTF-8 with a replacement for each byte that
        is none, control pieces are silent, and the first piece's leading space is left out."""
        out, held, first = [], bytearray(), True
        for i in chain(ids, [None]):
            if i in self.bytes:
                held.append(self.bytes[i])
                continue
            if held:
                out.append(read_bytes(bytes(held)))
                held.clear()
                first = False
            if i is None or i in self.silent:
                continue
            piece = " ⁇ " if i == self.unknown else self.texts[i]
            out.append(piece[1:] if first and piece.startswith(SPACE) else piece)
            first = False
        return "".join(out).replace(SPACE, " ")


def read_bytes(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that belongs to no character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            n = 1
        at += n
    return "".join(out)


class Segments:
    """Ids and decoded texts of segments, each distinct one worked out once and remembered."""

    def __init__(self, path: str, cached: int = CACHED_SEGMENTS):
        self.model, self.cached = PieceModel(path), cached
        self.reset()

    def reset(self) -> None:
        self.known = Interner()
        self.first, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)
        self.decoded = pa.array([], pa.string())

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(all segments, segments of each text): a text, its spaces written as pieces write them
        and led by one, is cut before each run of spaces and before each new line."""
        led = pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, pc.binary_join_element_wise("", pc.replace_substring(texts, " ", SPACE), SPACE))
        if pc.any(pc.match_substring(texts, MARK)).as_py():  # rare: the mark itself stands in a text
            lists = pa.array([[s for s in re.split(rf"(?=(?<!{SPACE}){SPACE})|(?=\n)", t) if s] for t in led.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.split_pattern(pc.replace_substring_regex(led, f"({SPACE}+|\n)", MARK + r"\1"), MARK)
        parts = lists.flatten()
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        some = pc.greater(pc.binary_length(parts), 0).to_numpy(zero_copy_only=False)
        return parts.filter(pa.array(some)), np.bincount(of[some], minlength=len(texts))

    def __call__(self, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
        """(ids of each text, the text that they decode to)."""
        if len(self.known) > self.cached:
            self.reset()
        parts, counts = self.cut(pc.fill_null(texts, ""))
        coded = parts.dictionary_encode()
        of = self.known.ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self._encode_new()
        size = np.diff(self.first)[of]
        ends = np.cumsum(counts)
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[of], size) + ranges(size)]
        offsets = pa.array(np.concatenate([[0], before[ends]]), pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), self.decoded.take(pa.array(of)))
        plain = pc.binary_join(lists, "")
        return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pc.utf8_slice_codeunits(plain, 1)  # the space that led

    def _encode_new(self) -> None:
        new = self.known.words[len(self.first) - 1 :]
        if not new:
            return
        model, lead = self.model, self.model.ids[SPACE]
        if len(model.fits) > KNOWN_PAIRS:
            model.fits.clear()
        found = [model.encode(s) for s in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))])
        # decoded behind a lone space, so that a segment's own leading space stays
        self.decoded = pa.concat_arrays([self.decoded, pa.array([model.decode([lead, *ids]) for ids in found], pa.string())])


_loaded: dict[str, Segments] = {}


def loaded(path: str) -> Segments:
    if path not in _loaded:
        _loaded[path] = Segments(path)
    return _loaded[path]


def encode_pieces(df: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``ids`` (array of int) and ``decoded`` (what the ids decode to).

    Every text is encoded whole, as the model's library does without begin, end or sampling, and
    is encoded in one narrow pass.  Null and empty texts have no ids and decode to the empty
    string; repeated rows and ids stay as they are, null ids too; other columns are left out,
    whatever their names; an empty table stays empty.  Texts longer than a block are encoded
    alone.  ``path`` names the model file on every executor.
    """
    ship(df.sparkSession)
    schema = T.StructType([df.schema[c] for c in keep]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches):
        encoder = loaded(path)
        for batch in blocks(batches, "_text", BLOCK_BYTES):
            ids, decoded = encoder(batch.column("_text"))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), ids, decoded], names=[*keep, "ids", "decoded"])
        trim()  # the worker's next task knows these segments, up to CACHED_SEGMENTS of them

    return df.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` and ``out``: the text of the array of ids in column ``ids`` (null: null)."""
    ship(df.sparkSession)

    @F.pandas_udf("string")
    def decode(rows):
        model = loaded(path).model
        return rows.map(lambda r: None if r is None else model.decode(r.tolist()))

    return df.withColumn(out, decode(F.col(ids)))


def op11_sentencepiece(spark, sf_dir, path: str | None = None):
    """Number of ids, and digests of the ids and of the decoded text, of every document."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    rows = encode_pieces(table(spark, sf_dir, "documents"), os.fspath(path))
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
