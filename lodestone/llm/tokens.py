"""Encoding a whole corpus with a public byte-level tokenizer.

Method: content-defined chunk reuse.

1. A rolling hash over every 8 bytes of a text decides where chunks end, so the
   same passage gives the same chunks wherever it stands. One row per distinct
   chunk of a batch is sent on, with the list of its places.
2. Rows are exchanged by the chunk's hash. Equal chunks meet and are encoded
   once. A chunk that a sample of the texts shows to recur very often in the corpus
   is spread over as many salts as its number of places asks for, so no single task gets
   all its places; it is then encoded once a salt.
3. The pieces are exchanged by text and joined. At a join the tokens of the two
   chunks need not be those of the whole text. Each chunk therefore gives its
   ids only between its first and its last *anchor*, and the bytes outside are
   joined with the neighbour's and encoded again, growing over as many chunks as
   have no anchor, until both ends stand on anchors. An anchor is a single space
   or line feed between two printable ASCII characters: there the tokenizer's
   pattern always starts a new piece, whatever stands around it, so the joined
   ids are exactly those of the whole text.

Defined cases: a null or empty text has no ids (an empty list); every input row
gives one output row, also when doc_id is null or repeats; texts without any
anchor are encoded whole; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.arrow import utf8, windows8
from lodestone.operators.skew import frequent
from lodestone.session import spread

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the tokenizer's own files split text before merging (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of an average chunk, a power of two.
CHUNK_BYTES = 1024
#: Texts on which chunks that recur very often are looked for, and places of one chunk in one task, about.
SAMPLE = 10_000
PLACES = 20_000


@lru_cache(maxsize=4)
def encoder(path: str = DEFAULT_TOKENIZER):
    """The tokenizer of a rank file, loaded once in each Python worker; from the job's files if it was shipped with them."""
    import tiktoken
    from pyspark import SparkFiles

    try:
        shipped = SparkFiles.get(os.path.basename(path))
    except Exception:  # outside of a job
        shipped = path
    with open(shipped if os.path.exists(shipped) else path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def anchors(data: np.ndarray, size: int) -> np.ndarray:
    """Positions of the spaces and line feeds that stand between two printable ASCII characters."""
    if size < 3:
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data[1 : size - 1] == 32) | (data[1 : size - 1] == 10)) + 1
    before, after = data[at - 1], data[at + 1]
    return at[(before > 32) & (before < 127) & (after > 32) & (after < 127)]


def chunk_ends(data: np.ndarray, offsets: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Sorted ends of all chunks: where the rolling hash says so, and at each text's end."""
    size = int(offsets[-1])
    rolling = windows8(data)[:size] * np.uint64(0x9E3779B97F4A7C15)
    cut = np.flatnonzero(rolling >> np.uint64(65 - chunk_bytes.bit_length()) == 0) + 8
    cut = cut[cut < size]
    # not inside a character, and not where the 8 bytes reach back over the start of the text
    start = offsets[np.searchsorted(offsets, cut, side="right") - 1]
    cut = cut[((data[cut] & 0xC0) != 0x80) & (cut - start >= 8)]
    return np.union1d(cut, offsets[1:][np.diff(offsets) > 0])


def _chunks(chunk_bytes: int, salts: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        task = TaskContext.get().partitionId()
        row = task << 33
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ends = chunk_ends(data, offsets, chunk_bytes)
            starts = np.concatenate([[0], ends[:-1]]) if len(ends) else np.zeros(0, np.int64)
            owner = np.searchsorted(offsets, starts, side="right") - 1
            first = np.searchsorted(starts, offsets[:-1])
            seq = np.arange(len(ends)) - first[owner] if len(ends) else np.zeros(0, np.int64)
            raw = data.tobytes()
            known: dict[bytes, int] = {}
            chunks: list[bytes] = []
            slots = np.empty(len(ends), np.int64)
            for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
                piece = raw[a:b]
                slot = known.get(piece)
                if slot is None:
                    slot = known[piece] = len(chunks)
                    chunks.append(piece)
                slots[i] = slot
            keys = np.fromiter((xxhash.xxh3_64_intdigest(c) for c in chunks), np.uint64, len(chunks)).view(np.int64)
            order = np.argsort(slots, kind="stable")
            counts = np.bincount(slots, minlength=len(chunks))
            salt = np.array([row * 2654435761 % salts[x] if x in salts else 0 for x in keys.tolist()] if salts else np.zeros(len(keys)), np.int32)
            # texts without any byte still give a row each, spread by their row number
            empty = np.flatnonzero(np.diff(offsets) == 0)
            keys = np.concatenate([keys, (row + empty) * 2654435761 % (1 << 61)])
            salt = np.concatenate([salt, np.zeros(len(empty), np.int32)])
            places = np.concatenate([owner[order], empty])
            lists = np.concatenate([[0], np.cumsum(np.concatenate([counts, np.ones(len(empty), np.int64)]))]).astype(np.int32)
            seqs = np.concatenate([seq[order], np.zeros(len(empty), np.int64)])
            docs = batch.column(0).take(pa.array(places))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys),
                    pa.array(salt),
                    pa.array(chunks + [b""] * len(empty), pa.binary()),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(places + row)),
                    pa.ListArray.from_arrays(pa.array(lists), docs),
                    pa.ListArray.from_arrays(pa.array(lists), pa.array(seqs.astype(np.int32))),
                ],
                ["key", "salt", "chunk", "row", "doc_id", "seq"],
            )
            row += batch.num_rows

    return run


_CHUNKS = "key long, salt int, chunk binary, row array<long>, doc_id array<long>, seq array<int>"
_PIECES = "row long, doc_id long, seq int, open boolean, head binary, n long, ids binary, tail binary"


def _encode(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        last, made = None, None
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            at = anchors(data, int(offsets[-1]))
            # anchors look one character around; those must lie within the same chunk
            owner = np.searchsorted(offsets, at, side="right") - 1
            at = at[(at > offsets[owner]) & (at + 1 < offsets[owner + 1])]
            lo, hi = np.searchsorted(at, offsets[:-1]).tolist(), np.searchsorted(at, offsets[1:]).tolist()
            at, offsets, raw = at.tolist(), offsets.tolist(), data.tobytes()
            opened, heads, counts, ids, tails = [], [], [], [], []
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                piece = raw[a:b]
                if piece != last:
                    last = piece
                    if lo[i] == hi[i]:
                        made = (False, piece, 0, b"", b"")
                    else:
                        p, q = at[lo[i]], at[hi[i] - 1]
                        core = enc.encode_ordinary(raw[p:q].decode("utf-8"))
                        made = (True, raw[a:p], len(core), np.array(core, kind).tobytes() if with_ids else b"", raw[q:b])
                for out, x in zip((opened, heads, counts, ids, tails), made):
                    out.append(x)
            rows = batch.column(3)
            sizes = np.diff(np.asarray(rows.offsets))
            take = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            yield pa.RecordBatch.from_arrays(
                [
                    rows.flatten(),
                    batch.column(4).flatten(),
                    batch.column(5).flatten(),
                    pa.array(opened).take(take),
                    pa.array(heads, pa.binary()).take(take),
                    pa.array(counts, pa.int64()).take(take),
                    pa.array(ids, pa.binary()).take(take),
                    pa.array(tails, pa.binary()).take(take),
                ],
                ["row", "doc_id", "seq", "open", "head", "n", "ids", "tail"],
            )

    return run


class _Joiner:
    """Joins the pieces of one text after the other."""

    def __init__(self, path: str, with_ids: bool):
        self.enc, self.with_ids = encoder(path), with_ids
        self.kind = np.uint16 if self.enc.n_vocab <= 1 << 16 else np.uint32
        self.row = None
        self.seams: dict[bytes, list[int]] = {}
        self.reset()

    def reset(self):
        self.docs: list = []
        self.sizes: list[int] = []
        self.parts: list[np.ndarray] = []

    def seam(self):
        if self.rest:
            ids = self.seams.get(self.rest)
            if ids is None:
                ids = self.enc.encode_ordinary(self.rest.decode("utf-8"))
                if len(self.rest) < 64:
                    if len(self.seams) > 100_000:
                        self.seams.clear()
                    self.seams[self.rest] = ids
            self.size += len(ids)
            if self.with_ids:
                self.parts.append(np.array(ids, np.int32))
            self.rest = b""

    def end(self):
        if self.row is not None:
            self.seam()
            self.docs.append(self.doc)
            self.sizes.append(self.size)
            self.row = None

    def add(self, row, doc, opened, head, n, ids, tail):
        if row != self.row:
            self.end()
            self.row, self.doc, self.rest, self.size = row, doc, b"", 0
        self.rest += head
        if opened:
            self.seam()
            self.size += n
            if self.with_ids and n:
                self.parts.append(np.frombuffer(ids, self.kind).astype(np.int32))
            self.rest = tail

    def take(self) -> pa.RecordBatch:
        """The finished texts; the parts of an unfinished one stay."""
        sizes, docs = self.sizes, pa.array(self.docs, pa.int64())
        if not self.with_ids:
            out = pa.RecordBatch.from_arrays([docs, pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])
            self.reset()
            return out
        values = np.concatenate(self.parts) if self.parts else np.zeros(0, np.int32)
        done = sum(sizes)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values[:done]))
        self.reset()
        if done < len(values):
            self.parts = [values[done:]]
        return pa.RecordBatch.from_arrays([docs, lists], ["doc_id", "ids"])


def _join(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = _Joiner(path, with_ids)
        for batch in batches:
            for x in zip(*(c.to_pylist() for c in batch.columns)):
                joiner.add(x[0], x[1], *x[3:])
            yield joiner.take()
        joiner.end()
        yield joiner.take()

    return run


def _sampled_keys(chunk_bytes: int):
    """The hashes of all chunks of the texts, one row a place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            ends = chunk_ends(data, offsets, chunk_bytes)
            raw, starts = data.tobytes(), [0, *ends[:-1].tolist()]
            keys = np.fromiter((xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(starts, ends.tolist())), np.uint64, len(ends))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    return run


def _salts(texts: DataFrame, chunk_bytes: int) -> dict[int, int]:
    """The number of salts of each chunk that recurs very often: fewer chunks than 1000 times those of a text, whatever the corpus."""
    total = texts.count()
    step = max(1, -(-total // SAMPLE))
    if total < PLACES:
        return {}
    drawn = texts.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(step)) == 0).select("text")
    keys = drawn.mapInArrow(_sampled_keys(chunk_bytes), "key long")
    return {r.key: -(-r.n // PLACES) for r in frequent(keys, "key", total, step, PLACES).collect()}


def _run(df: DataFrame, id_col: str, text_col: str, path: str, chunk_bytes: int, with_ids: bool, out: str) -> DataFrame:
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)
    chunks = spread(texts).mapInArrow(_chunks(chunk_bytes, _salts(texts, chunk_bytes)), _CHUNKS)
    met = chunks.repartition("key", "salt").sortWithinPartitions("key", "salt")
    pieces = met.mapInArrow(_encode(path, with_ids), _PIECES)
    placed = pieces.repartition("row").sortWithinPartitions("row", "seq")
    return placed.mapInArrow(_join(path, with_ids), out)


def encode_corpus(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, ids): the ids of each text, without special tokens; see the module's text for the cases."""
    return _run(df, id_col, text_col, tokenizer, chunk_bytes, True, "doc_id long, ids array<int>")


def count_tokens(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = DEFAULT_TOKENIZER, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """(doc_id, n_tokens): as encode_corpus, but only the number of ids leaves the encoding tasks."""
    return _run(df, id_col, text_col, tokenizer, chunk_bytes, False, "doc_id long, n_tokens long")
