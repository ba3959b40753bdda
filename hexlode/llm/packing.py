"""Order-preserving packing of documents into sequences by dynamic programming.

Windows are cut out of the stream of documents in its given order. A cut after a document is free, one after a
sentence costs SENTENCE, one anywhere else costs TRUNCATION; a window's padding costs its tokens. With f(j) the
least cost of a cut at j, f(j) = penalty(j) + min over i in [j - 2048, j) of f(i) + 2048 - (j - i), so the
minimum of f(i) + i over a sliding window decides, and a monotone queue holds it.

Each input partition is a stream of its own, without a shuffle; at most one window of each is short, and its tail
is split at powers of two, whose sequences need no padding. Spark reads a table's files by size; `pack_files` makes each part of a
file a stream and numbers sequences by the files' own numbers, so that they follow the order in which the table was written.

Null and empty texts have one token (the end mark). Repeated rows are packed each. Only doc_id and text are read,
so extra columns never clash; a null doc_id is kept. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SEQUENCE = 2048
#: Costs of a cut, in tokens of padding.
SENTENCE, TRUNCATION = 2, 16
END = 1
#: Tokens that a stream gathers before it is packed; what the last window leaves starts the next one.
CHUNK = 1 << 21
#: A tail of fewer tokens is padded rather than split.
LEAST_TAIL = 256
#: The number in the name of a file that Spark has written.
_PART = r"/part-(\d+)-[^/]*$"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Encoder:
    """Ids of byte_bpe_50k: the rank file holds the vocabulary of the tokenizers file, and gives the same ids several times as fast.

    Its pattern gives up on white space of some 800,000 characters in a row; such a text goes through the tokenizers file, which lies beside it.
    """

    _made: dict[str, "Encoder"] = {}

    def __init__(self, path: str) -> None:
        self.slower, self.path = None, path
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})
        self.ends = np.zeros(50257, dtype=bool)
        for token, i in ranks.items():
            self.ends[i] = b"\n" in token or token.rstrip()[-1:] in (b".", b"!", b"?")

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: str) -> np.ndarray:
        try:
            return self.bpe.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if self.slower is None:
                from tokenizers import Tokenizer

                self.slower = Tokenizer.from_file(self.path.removesuffix(".tiktoken") + ".json")
            return np.array(self.slower.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def default_path() -> str:
    from public_tokenizers import path

    return path("byte_bpe_50k.tiktoken")


def candidates(ends: np.ndarray, doc_ends: np.ndarray, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with their penalties: document ends, sentence ends, and within longer runs every size // 64 tokens."""
    at = np.union1d(ends, doc_ends)
    at = np.union1d(at, [total])
    step = max(1, size // 64)
    gaps = np.diff(np.concatenate([[0], at]))
    if len(wide := np.flatnonzero(gaps > step)):
        starts = np.concatenate([[0], at])[wide]
        at = np.union1d(at, np.concatenate([np.arange(s + step, s + g, step) for s, g in zip(starts, gaps[wide], strict=True)]))
    at = at.astype(np.int64)
    cost = np.full(len(at), TRUNCATION, dtype=np.int64)
    cost[np.isin(at, ends)] = SENTENCE
    cost[np.isin(at, doc_ends)] = 0
    return at, cost


def best_cuts(at: np.ndarray, cost: np.ndarray, size: int) -> list[int]:
    """The cheapest ends of windows, the last of at among them; neighbouring places are at most size apart."""
    places, costs = at.tolist(), cost.tolist()
    before = [0] * len(places)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, -1)])  # f(i) + i, place i, its index; rising from left to right
    for j, (p, c) in enumerate(zip(places, costs, strict=True)):
        while queue[0][1] < p - size:
            queue.popleft()
        value, _, i = queue[0]
        before[j] = i
        value = value + size - p + c + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, p, j))
    cuts, j = [], len(places) - 1
    while j >= 0:
        cuts.append(places[j])
        j = before[j]
    return cuts[::-1]


def tail_cuts(start: int, end: int, size: int) -> list[int]:
    """Cuts that split the last window at powers of two while that saves more padding than it costs."""
    out, left = [], end - start
    while left > LEAST_TAIL and left & (left - 1) and left < size:
        part = 1 << (left.bit_length() - 1)
        start, left = start + part, left - part
        out.append(start)
    return [*out, end]


class Stream:
    """Packs one partition's documents; rows come out chunk by chunk."""

    def __init__(self, encoder: Encoder, size: int, first_sequence: int) -> None:
        self.encoder, self.size, self.sequence = encoder, size, first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int]] = []  # doc_id, its tokens in all, of them before this chunk
        self.held = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        ids = np.append(self.encoder.ids(text or ""), np.uint32(END)).astype("<u4")
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0))
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.held:
            return None
        ids = np.concatenate(self.ids)
        lengths = np.array([len(x) for x in self.ids])
        ends = np.cumsum(lengths)
        at, cost = candidates(np.flatnonzero(self.encoder.ends[ids]) + 1, ends, len(ids), self.size)
        cuts = best_cuts(at, cost, self.size)
        if last:
            cuts[-1:] = tail_cuts(cuts[-2] if len(cuts) > 1 else 0, cuts[-1], self.size)
        elif len(cuts) > 1:
            cuts.pop()  # its last window may be short; its tokens start the next chunk
        rows: list[tuple] = []
        bounds = np.union1d(ends, cuts)
        bounds = bounds[bounds <= cuts[-1]]
        starts = np.concatenate([[0], bounds[:-1]])
        doc = np.searchsorted(ends, starts, side="right")
        sequence = np.searchsorted(cuts, starts, side="right")
        opened = np.concatenate([[0], cuts])[sequence]
        doc_start = ends - lengths
        for s, e, d, q, o in zip(starts.tolist(), bounds.tolist(), doc.tolist(), sequence.tolist(), opened.tolist(), strict=True):
            doc_id, tokens, gone = self.docs[d]
            rows.append((doc_id, gone + s - int(doc_start[d]), e - s, zlib.crc32(ids[s:e].tobytes()), tokens, self.sequence + q, s - o))
        self.sequence += len(cuts)
        done = cuts[-1]
        d = int(np.searchsorted(ends, done, side="right"))
        if d == len(ends):
            self.ids, self.docs = [], []
        else:
            inside = done - int(doc_start[d])
            doc_id, tokens, gone = self.docs[d]
            self.docs = [(doc_id, tokens, gone + inside), *self.docs[d + 1 :]]
            self.ids = [self.ids[d][inside:], *self.ids[d + 1 :]]
        self.held = len(ids) - done
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=_ARROW)


def _run(path: str, size: int):
    """Packs rows (doc_id, text, and the number of the first sequence of their stream, or none: the partition's)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        own = (context.partitionId() if context else 0) << 32
        stream, here = None, None
        for batch in batches:
            firsts = batch.column(2).to_pylist() if batch.num_columns > 2 else [own] * len(batch)
            for doc_id, text, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), firsts, strict=True):
                if stream is None or first != here:
                    if stream and (out := stream.flush(True)):
                        yield out
                    stream, here = Stream(Encoder.of(path), size, first), first
                stream.add(doc_id, text)
                if stream.held >= CHUNK and (out := stream.flush(False)):
                    yield out
        if stream and (out := stream.flush(True)):
            yield out

    return run


def _columns(docs: DataFrame) -> list[Column]:
    return [docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")]


def pack(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """A row for each piece of a document; sequence_id is the partition's number times 2**32 and a count."""
    return docs.select(*_columns(docs)).mapInArrow(_run(path or default_path(), size), SCHEMA)


def numbered(docs: DataFrame) -> bool:
    """Whether docs is read from files that one job of Spark's has numbered."""
    numbers = [m and int(m[1]) for m in (re.search(_PART, name) for name in docs.inputFiles())]
    return bool(numbers) and None not in numbers and len(set(numbers)) == len(numbers) and max(numbers) < 1 << 20


def pack_files(docs: DataFrame, path: str | None = None, size: int = SEQUENCE) -> DataFrame:
    """pack() of numbered() files, in their order: sequence_id is the file's number (20 bits), the place where its part begins in units of 4 KiB (21 bits) and a count (22 bits); larger files raise an error."""
    number, start = F.regexp_extract(F.input_file_name(), _PART, 1).cast("long"), F.input_file_block_start()
    fits = (number < 1 << 20) & (start < 1 << 33)
    first = F.when(fits, F.shiftleft(number, 43) + F.shiftleft(F.shiftright(start, 12), 22)).otherwise(F.raise_error("a file of over 8 GB, or a number of over 20 bits").cast("long"))
    return docs.select(*_columns(docs), first.alias("first")).mapInArrow(_run(path or default_path(), size), SCHEMA)
