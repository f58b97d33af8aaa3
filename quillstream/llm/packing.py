"""Mixture-controlled packing: deficit round-robin over source queues.

Texts are encoded once, block by block, and staged as ids.  A source's queue is its tokens over
all blocks, in their order; where a block stands in it follows from sums of the tasks before and
running sums within the task.  The mix is a schedule over the whole corpus: at any time each
source has given what its weight owes it, until it is empty.  The schedule is cut into groups of
about equal tokens, which take their slice of every queue wherever its blocks are; a group is
packed by one task.  In it every window is filled to the shares: a queue's deficit grows by its
share of the window and falls by what it was served, and what is owed at the end of a group is
where the next one starts.  Sequences are cut at places of the whole corpus, so they may span
groups, and only the very last one is short: it is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import Counter
from itertools import chain

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core; set before the library starts

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillstream.llm.core import Interner, blocks, ranges, small_batches, staged, table, trim
from quillstream.shipping import ship

#: WINDOW is in sequences; a queue is served when it is owed QUANTUM tokens, so that all with such a
#: share of a window are served in each.
LENGTH, END, WINDOW, QUANTUM = 2048, 1, 1, 8
BLOCK_BYTES, CACHED_WORDS = 3_000_000, 350_000
#: The same in the pipeline, whose executors have less memory to spare after its other stages.
STAGE_BYTES, STAGE_WORDS = 1_500_000, 150_000
#: Tokens packed by one task, about.  Offsets told to all tasks, and sources, at most: beyond that
#: offsets are joined by a shuffle, and sources share queues by a hash of their name.
GROUP_TOKENS, TOLD_OFFSETS, QUEUES = 1 << 20, 200_000, 50_000
#: Marks at the end of a word, which the tokenizer takes apart from its letters.
MARKS, APART = r"([a-z])([.,;:!?]+)([ \n]|$)", r"\1 \2\3"
BLOCK = "pid int, block long, doc_ids binary, lengths binary, source_of binary, ids binary, sources array<string>, tokens array<long>, inner array<long>, shared array<long>"
SLICE = "grp long, queue int, at long, doc_ids binary, starts binary, lengths binary, doc_tokens binary, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
# fixed values: how the known tokenizer takes texts apart; its words may be encoded one by one
KNOWN_NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def is_known(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    split = ((j.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}])
    return (
        (j.get("normalizer") or {}).get("normalizers") == KNOWN_NORMALIZER and len(split) == 2 and split[0].get("pattern") == {"Regex": KNOWN_SPLIT} and split[0].get("invert") is True
        and split[1].get("type") == "ByteLevel" and not split[1].get("add_prefix_space") and not split[1].get("use_regex") and j.get("model", {}).get("type") == "BPE" and not j.get("post_processor")
        and not any(re.search(r"\s", t["content"]) for t in j.get("added_tokens", []))
    )


class PlainIds:
    """Ids of texts by the tokenizer itself, for any tokenizer file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()

    def reset(self) -> None:
        return

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        found = [[*e.ids, end] for e in self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths


#: Words that the tokenizer's normaliser and splitter leave as they are: lower-case Latin letters.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """For each non-ASCII Latin letter, the letters that byte-level tokenizers write its UTF-8
    bytes with: a visible byte is its own, the others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    letter = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class WordIds:
    """Ids of white-space separated words.  The tokenizer drops ASCII white space and joins
    nothing across it, so a text's ids are its words' ids, and a word is encoded once.  It also
    lower-cases, and cuts letters from marks, so that this may be done before."""

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.cached, self.tokenizer = cached, Tokenizer.from_file(path)
        self.tokenizer.no_truncation(), self.tokenizer.no_padding()
        self.letters = byte_letters()
        self.reset()

    def reset(self) -> None:
        self.known, self.flat, self.first = Interner(), np.zeros(0, np.uint16), np.zeros(1, np.int64)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by ``end``; ids of each text).  Texts are cut into words
        in Arrow; Python sees each distinct word of a block once."""
        if len(self.known) > self.cached:
            self.reset()
        plain = pc.replace_substring_regex(pc.ascii_lower(pc.fill_null(texts, "")), MARKS, APART)
        lists = pc.ascii_split_whitespace(plain)
        words = lists.flatten()
        some = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
        counts = np.bincount(of[some], minlength=len(texts))
        coded = words.filter(pa.array(some)).dictionary_encode()
        ids = self.known.ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        self._encode_new()
        size = np.diff(self.first)[ids]
        ends = np.cumsum(counts)
        before = np.concatenate([[0], np.cumsum(size)])
        lengths = before[ends] - before[ends - counts]
        out = np.full(int(lengths.sum()) + len(texts), end, np.uint16)
        at = np.arange(len(out))
        body = np.ones(len(out), bool)
        body[np.cumsum(lengths + 1) - 1] = False
        out[at[body]] = self.flat[np.repeat(self.first[ids], size) + ranges(size)]
        return out, lengths + 1

    def _encode_new(self) -> None:
        new = self.known.words[len(self.first) - 1 :]
        if not new:
            return
        words = new
        found: list = [None] * len(words)
        rest, merge, letters = [], self.tokenizer.model.tokenize, self.letters
        for i, w in enumerate(words):  # ASCII capitals are gone
            if w.isascii():
                if w.isalpha():
                    found[i] = [t.id for t in merge(w)]
                    continue
            elif PLAIN.fullmatch(w):
                found[i] = [t.id for t in merge(w.translate(letters))]
                continue
            rest.append(i)
        for k in range(0, len(rest), 1000):
            part = rest[k : k + 1000]
            e = self.tokenizer.encode([words[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            at = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part))).tolist()
            ids = e.ids
            for i, a, b in zip(part, [0, *at], at):
                found[i] = ids[a:b]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(found), np.uint16, int(sizes.sum()))])


_encoders: dict = {}


def _encode(path: str, end: int, queues: int, known: bool, cached: int = CACHED_WORDS, block_bytes: int = BLOCK_BYTES, held: bool = True):
    def run(batches):
        if (path, cached) not in _encoders:
            _encoders[path, cached] = WordIds(path, cached) if known else PlainIds(path)
        encoder, pid, k, seen, seen_of_queue = _encoders[path, cached], TaskContext.get().partitionId(), 0, Counter(), Counter()
        for batch in blocks(batches, "text", block_bytes):
            ids, lengths = encoder(batch.column("text"), end)
            names = batch.column("source").dictionary_encode("encode")
            of = names.indices.to_numpy(zero_copy_only=False)
            tokens = np.bincount(of, lengths, len(names.dictionary)).astype(np.int64).tolist()
            sources, shared = names.dictionary.to_pylist(), []
            for s, n in zip(sources, tokens):
                shared.append(seen_of_queue[queue_name(s, queues)])
                seen_of_queue[queue_name(s, queues)] += n
            yield pa.RecordBatch.from_pylist([{
                "pid": pid, "block": (pid << 24) + k, "doc_ids": batch.column("doc_id").fill_null(-1).to_numpy().astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(),
                "source_of": of.astype("<i4").tobytes(), "ids": ids.astype(_kind(ids)).tobytes(), "sources": sources, "tokens": tokens, "inner": [seen[s] for s in sources], "shared": shared,
            }], schema=_schema(BLOCK))
            seen.update(dict(zip(sources, tokens)))
            k += 1
        encoder.reset()
        if not held:
            _encoders.pop((path, cached), None)
            del encoder
        trim()

    return run


def _kind(ids: np.ndarray) -> str:
    return "<u2" if ids.dtype == np.uint16 else "<u4"


def _read_ids(raw: bytes, tokens: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * tokens else "<u4")


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


class Schedule:
    """How much of each queue has been given when all of them have given t tokens: queue s gives
    weight[s] for each unit of a clock, until it is empty."""

    def __init__(self, tokens: np.ndarray, weights: np.ndarray, each: int):
        self.tokens, self.weights = tokens.astype(np.float64), weights / weights.sum()
        self.total = int(tokens.sum())
        self.groups = max(1, -(-self.total // each))
        self.each = each
        ends = np.unique(self.tokens / self.weights)
        self.clock = np.concatenate([[0.0], ends])
        self.given = np.array([np.minimum(self.weights * v, self.tokens).sum() for v in self.clock]) if len(ends) < 64 else self._given(ends)

    def _given(self, ends: np.ndarray) -> np.ndarray:
        order = np.argsort(self.tokens / self.weights, kind="stable")
        r, t, w = (self.tokens / self.weights)[order], self.tokens[order], self.weights[order]
        n = np.searchsorted(r, ends, "right")
        return np.concatenate([[0.0], np.concatenate([[0.0], np.cumsum(t)])[n] + ends * (w.sum() - np.concatenate([[0.0], np.cumsum(w)])[n])])

    def owed(self, s, g) -> np.ndarray:
        """What queues s have given, in parts of tokens, when group g starts."""
        v = np.interp(np.minimum(np.asarray(g, np.float64) * self.each, self.total), self.given, self.clock)
        return np.where(np.asarray(g) >= self.groups, self.tokens[s], np.minimum(self.weights[s] * v, self.tokens[s]))

    def cut(self, s, g) -> np.ndarray:
        """Where group g starts in queues s."""
        return np.floor(self.owed(s, g) + 1e-6).astype(np.int64)

    def group_at(self, s: int, place: int) -> int:
        """The last group that starts at or before a place in queue s."""
        g = int(np.interp(min(place / self.weights[s], self.clock[-1]), self.clock, self.given) // self.each)
        g = min(max(g, 0), self.groups - 1)
        while g + 1 < self.groups and self.cut(s, g + 1) <= place:
            g += 1
        while g and self.cut(s, g) > place:
            g -= 1
        return g


def fill_windows(left: np.ndarray, share: np.ndarray, deficit: np.ndarray, window: int, first: int = 0, quantum: int = 1):
    """For each window, how many tokens each queue gives, until the queues are empty.

    ``left``: tokens queued by source; ``first``: room in the first window.  A queue is served
    what it is owed, in whole tokens, once that is ``quantum`` or all it has; what is missing the
    others give by what they are owed, then by what they hold, and owe it later.
    """
    left, deficit = left.copy(), deficit.copy()
    room = first or window
    while (total := int(left.sum())) > 0:
        room = min(room, total)
        deficit += share * room
        give = np.minimum(np.floor(np.maximum(deficit, 0)).astype(np.int64), left)
        give[(give < quantum) & (give < left)] = 0
        over = int(give.sum()) - room
        if over > 0:  # owed more than fits: each gives its part, the rest stays owed
            give = np.floor(give * (room / give.sum())).astype(np.int64)
            over = int(give.sum()) - room
        # the rest, if it is what rounding left: one token each to those who are owed most of one
        more = np.flatnonzero((give > 0) & (give < left))
        if 0 < -over <= len(more):
            give[more[np.argsort((give - deficit)[more], kind="stable")[:-over]]] += 1
            over = 0
        # else to who is owed most, of those served in this window first
        for s in np.lexsort((give - deficit, (give == 0) & (deficit < quantum))):
            if over >= 0:
                break
            more = min(int(left[s] - give[s]), max(quantum, int(deficit[s] - give[s])), -over)
            give[s] += more
            over += more
        for s in np.argsort(-(left - give), kind="stable"):
            if over >= 0:
                break
            more = min(int(left[s] - give[s]), -over)
            give[s] += more
            over += more
        left -= give
        deficit -= give
        yield give
        room = window


def sequence_sizes(total: int, length: int) -> list[int]:
    """Full sequences, then powers of two, which aren't padded."""
    out, rest = [length] * (total // length), total % length
    while rest:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return out


def _slice(schedule, queue_of):
    """Each block's tokens by the group that takes them."""

    def run(batches):
        plan, number = schedule.value, queue_of.value
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):  # one block at a time
                doc_ids, lengths, of = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8"), np.frombuffer(row["source_of"], "<i4")
                ids, first = _read_ids(row["ids"], int(lengths.sum())), np.cumsum(lengths) - lengths
                ahead = {x["queue"]: x["ahead"] for x in row["ahead"]}
                for k, source in enumerate(row["sources"]):
                    s, docs = number(source), np.flatnonzero(of == k)
                    start = ahead[s] + row["inner" if source in number.number else "shared"][k]
                    n = lengths[docs]
                    at = start + np.cumsum(n) - n  # where documents start in the queue
                    g0, g1 = plan.group_at(s, start), plan.group_at(s, start + row["tokens"][k] - 1)
                    cuts = plan.cut(s, np.arange(g0, g1 + 1))
                    edges = np.union1d(at, cuts[cuts > start])
                    group = g0 + np.searchsorted(cuts, edges, "right") - 1
                    doc = np.searchsorted(at, edges, "right") - 1
                    size = np.diff(np.append(edges, start + row["tokens"][k]))
                    inside = edges - at[doc]
                    for g in np.unique(group).tolist():
                        i = np.flatnonzero(group == g)
                        d = docs[doc[i]]
                        taken = ids[np.repeat(first[d] + inside[i], size[i]) + ranges(size[i])]
                        yield pa.RecordBatch.from_pylist([{
                            "grp": g, "queue": s, "at": int(edges[i[0]]), "doc_ids": doc_ids[d].tobytes(), "starts": inside[i].astype("<i8").tobytes(), "lengths": size[i].astype("<i8").tobytes(),
                            "doc_tokens": lengths[d].astype("<i8").tobytes(), "ids": taken.tobytes(),
                        }], schema=_schema(SLICE))
        trim()

    return run


def lay_out(bounds: np.ndarray, gives: np.ndarray, first: int, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in the queues, place in the output, length) of each piece.

    ``bounds``: where documents start, the queues lying end to end; ``gives``: what each queue (a
    column) gives to each window (a row); ``first``: place of the first window; ``edges``: places
    of the output at which sequences start.  Pieces begin where a queue's turn, a document or a
    sequence does.
    """
    starts = np.cumsum(gives.sum(0)) - gives.sum(0)  # of the queues
    from_queue = starts + np.cumsum(gives, 0) - gives
    some = gives.ravel() > 0
    size, source = gives.ravel()[some], from_queue.ravel()[some]
    out = first + np.cumsum(size) - size
    turn = np.argsort(source)  # turns in order of the queues
    of = turn[np.searchsorted(source[turn], bounds, "right") - 1]
    edges = edges[(edges >= first) & (edges < first + int(size.sum()))]
    places = np.unique(np.concatenate([out, out[of] + bounds - source[of], edges]))
    of = np.searchsorted(out, places, "right") - 1
    return source[of] + places - out[of], places, np.diff(np.append(places, first + int(size.sum())))


def _pack_group(schedule, length: int, window: int, quantum: int):
    def run(data: pa.Table) -> pa.Table:
        plan, data = schedule.value, data.combine_chunks()
        data = data.take(pc.sort_indices(data, [("queue", "ascending"), ("at", "ascending")]))
        g = data["grp"][0].as_py()
        place = int(plan.cut(slice(None), g).sum())
        doc_ids, starts, lengths, doc_tokens = (np.frombuffer(b"".join(data[c].to_pylist()), "<i8") for c in ("doc_ids", "starts", "lengths", "doc_tokens"))
        sizes = np.array([len(x) // 8 for x in data["lengths"].to_pylist()])
        of = np.repeat(data["queue"].to_numpy(), sizes)
        tokens = np.add.reduceat(lengths, np.cumsum(sizes) - sizes).tolist()
        ids = memoryview(b"".join(_read_ids(x.as_py(), n).astype("<u4", copy=False).tobytes() for x, n in zip(data["ids"], tokens)))
        names, turns = np.unique(of, return_inverse=True)
        left = np.bincount(turns, lengths).astype(np.int64)
        share = plan.weights[names] / plan.weights[names].sum()
        deficit = plan.owed(names, g) - plan.cut(names, g)
        gives = np.array(list(fill_windows(left, share, deficit, window, window - place % window, quantum)))
        whole = plan.total // length * length
        edges = np.concatenate([np.arange(place // length * length, min(whole, place + int(lengths.sum())), length), whole + np.cumsum([0, *sequence_sizes(plan.total - whole, length)])])
        bounds = np.cumsum(lengths) - lengths
        source, places, size = lay_out(bounds, gives, place, edges)
        doc = np.searchsorted(bounds, source, "right") - 1
        at = np.searchsorted(edges, places, "right") - 1
        sequence = np.where(edges[at] < whole, edges[at] // length, whole // length + at - np.searchsorted(edges, whole))
        crc = np.fromiter((zlib.crc32(ids[a:b]) for a, b in zip((4 * source).tolist(), (4 * (source + size)).tolist())), np.int64, len(source))
        columns = (doc_ids[doc], starts[doc] + source - bounds[doc], size, crc, doc_tokens[doc], sequence, places - edges[at])
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_schema(PIECES))

    return run


class QueueOf:
    """The number of a source's queue, which has its name or, shared, that of its hash."""

    def __init__(self, names: list[str | None], shared: bool, queues: int):
        self.queues = queues
        self.all = {n: k for k, n in enumerate(names)}
        self.number = {} if shared else self.all

    def __call__(self, source: str | None) -> int:
        return self.number[source] if source in self.number else self.all[queue_name(source, self.queues)]


def queue_name(source: str | None, queues: int) -> str:
    return f"#{zlib.crc32((source or '').encode()) % queues}"


def pack(
    df: DataFrame, tokenizer: str | None = None, length: int = LENGTH, window: int = WINDOW, end: int = END, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: dict[str | None, float] | None = None, quantum: int = QUANTUM, cached_words: int = CACHED_WORDS, block_bytes: int = BLOCK_BYTES, held: bool = True,
) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    ``weights``: target proportions of tokens by source, all above 0; by default sources weigh
    what they hold, so that all end together.  ``window``: the sequences that are filled to the
    proportions at a time; within a window a source's tokens are together.  ``cached_words`` and ``block_bytes`` bound
    the memory of a task, ``held`` tells whether workers keep the tokenizer between tasks; they change nothing else.

    Null and empty texts are their end token alone; null is a source of its own; a null id counts
    as -1; repeated rows are packed one by one; an empty table gives no pieces; other columns are
    ignored.  Sequences hold ``length`` tokens; the last one is cut into powers of two, so nothing
    is padded.  A tokenizer file other than the known one is used as it is, text by text.
    """
    spark = df.sparkSession
    ship(spark)
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    encoded = staged(rows.mapInArrow(_encode(path, end, QUEUES, is_known(path) and end < 1 << 16, cached_words, block_bytes, held), BLOCK), "encoded", "snappy")  # ids hardly compress
    counts = encoded.select("pid", F.explode(F.arrays_zip("sources", "tokens")).alias("x")).groupBy(F.col("x.sources").alias("source"), "pid").agg(F.sum("x.tokens").alias("n"))
    counts = staged(counts, "counts")
    named = counts.groupBy("source").agg(F.sum("n").alias("n"))
    shared = named.count() > QUEUES
    if shared:
        if weights:
            raise ValueError(f"weights need at most {QUEUES} sources")
        counts = counts.withColumn("source", F.concat(F.lit("#"), (F.crc32(F.coalesce("source", F.lit("")).cast("binary")) % QUEUES).cast("string"))).groupBy("source", "pid").agg(F.sum("n").alias("n"))
        named = counts.groupBy("source").agg(F.sum("n").alias("n"))
    totals = sorted(((r["source"], r["n"]) for r in named.collect()), key=lambda x: (x[0] is None, x[0] or ""))  # QUEUES rows at most
    if not totals:
        return spark.createDataFrame([], PIECES)
    tokens = np.array([n for _, n in totals], np.int64)
    owed = tokens.astype(np.float64) if weights is None else np.array([float(weights[s]) for s, _ in totals])
    if (owed <= 0).any():
        raise ValueError("weights must be above 0")
    schedule = spark.sparkContext.broadcast(Schedule(tokens, owed, max(1, GROUP_TOKENS // (window * length)) * window * length))
    queue_of = spark.sparkContext.broadcast(QueueOf([s for s, _ in totals], shared, QUEUES))
    # tokens of a queue in the tasks before
    # an Arrow table: rows of Python objects would start Python workers of another kind, which stay beside the others
    numbers = spark.createDataFrame(pa.table({"s": pa.array([s for s, _ in totals], pa.string()), "queue": pa.array(range(len(totals)), pa.int32())}))
    before = counts.join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("s"))).groupBy("pid", "queue").agg(F.sum("n").alias("n"))
    before = before.withColumn("ahead", F.sum("n").over(W.partitionBy("queue").orderBy("pid")) - F.col("n"))
    entries = before.count()
    before = before.groupBy(F.col("pid").alias("_pid")).agg(F.collect_list(F.struct("queue", "ahead")).alias("ahead"))
    before = F.broadcast(before) if entries <= TOLD_OFFSETS else before
    slices = encoded.join(before, F.col("pid") == F.col("_pid")).drop("_pid").mapInArrow(_slice(schedule, queue_of), SLICE)
    return slices.groupBy("grp").applyInArrow(_pack_group(schedule, length, window * length, quantum), PIECES)


def op5_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


def stage_packing(spark, docs, sf_dir):
    """Pipeline stage, the last: the pieces of all rows.  Null and empty texts are their end token
    alone, repeated rows are packed one by one, a null id counts as -1, an empty table gives no
    pieces, and other columns are ignored."""
    small_batches(spark)
    return pack(docs, cached_words=STAGE_WORDS, block_bytes=STAGE_BYTES, held=False)
