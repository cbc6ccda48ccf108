"""Bounded-space online packing of token ids into fixed windows.

A partition keeps at most ``open_windows`` windows open. Whole windows of a long document leave
at once; its rest goes into the open window it fits best. When none has room and no more may be
opened, the fullest one is filled up with the rest's beginning and emitted. What stays open at
the end of a partition, a bounded number of tokens, is merged over all partitions by running
totals, again without gaps; the last, incomplete stretch becomes windows of powers of two.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticketlens.llm.common import save

PATTERN = (  # fixed value: how byte-level tokenizers of this kind split a text
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
_BLANKS = "\t\n\x0b\x0c\r \x85\xa0"
CACHE_WORDS = 1 << 17


def _letters() -> dict[str, int]:
    """The printable stand-ins of bytes in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    hidden = [b for b in range(256) if b not in set(shown)]
    return table | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Little-endian 32-bit ids of texts under a byte-level BPE file of ``tokenizers``.

    Latin-1 texts, where both libraries split alike for certain, are cut at single blanks; no
    merge crosses them. A piece is encoded once per cache life, all new pieces of a batch in
    one call. Every other text goes through ``tokenizers`` whole.
    """

    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            vocab = json.load(file)["model"]["vocab"]
        letters, added = _letters(), self.whole.get_added_tokens_decoder()
        ranks = {
            bytes(letters[c] for c in word): i for word, i in vocab.items() if i not in added
        }
        self.fast = tiktoken.Encoding(
            "own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for word, i in ranks.items():
            self.sizes[i] = len(word)
        self.known: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str] | None:
        """``text`` as pieces, all but the first without their leading blank."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        if text.startswith(" ") or any(b + " " in text for b in _BLANKS):
            return None
        return text.split(" ")

    def _learn(self, words: list[str]) -> None:
        """Ids of `` word`` for all new words at once, told apart by their byte lengths."""
        if len(self.known) + len(words) > CACHE_WORDS:
            self.known.clear()
        safe = [w for w in words if w and w[0] not in _BLANKS and w[-1] not in _BLANKS]
        for word in set(words).difference(safe):
            self.known[word] = np.array(self.fast.encode_ordinary(" " + word), "<u4").tobytes()
        if not safe:
            return
        ids = np.array(self.fast.encode_ordinary(" " + " ".join(safe)), "<u4")
        ends = np.cumsum(self.sizes[ids])
        marks = np.cumsum([1 + len(w.encode()) for w in safe])
        cuts = (np.searchsorted(ends, marks) + 1) * 4
        data, at = ids.tobytes(), 0
        for word, cut in zip(safe, cuts.tolist()):
            self.known[word] = data[at:cut]
            at = cut

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; NULL has none."""
        split = [self._pieces(t) if t else [] for t in texts]
        fresh = {w for p in split if p for w in p[1:]}.difference(self.known)
        if fresh:
            self._learn(list(fresh))
            fresh = {w for p in split if p for w in p[1:]}.difference(self.known)
            if fresh:  # the cache was emptied
                self._learn(list(fresh))
        get = self.known.__getitem__
        for text, pieces in zip(texts, split):
            if pieces is None:
                ids = self.whole.encode(text, add_special_tokens=False).ids
                yield np.array(ids, "<u4").tobytes()
            elif pieces:
                head = np.array(self.fast.encode_ordinary(pieces[0]), "<u4").tobytes()
                yield head + b"".join(map(get, pieces[1:]))
            else:
                yield b""


class Packer:
    """The windows of one partition. Pieces are (doc row, start, length, ids) tuples."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[list] = []  # [tokens, pieces]
        self.out: list[tuple] = []  # doc, start, length, crc, doc tokens, sequence, offset, ids
        self.next = 0

    def emit(self, pieces: list[tuple], keep: bool = False) -> None:
        offset = 0
        for doc, start, ids, tokens in pieces:
            n = len(ids) // 4
            self.out.append(
                (doc, start, n, zlib.crc32(ids), tokens, self.next, offset, ids if keep else None)
            )
            offset += n
        self.next += 1

    def add(self, doc, ids: bytes) -> None:
        total, at, size = len(ids) // 4, 0, self.size
        while total - at >= size:
            self.emit([(doc, at, ids[4 * at : 4 * (at + size)], total)])
            at += size
        while at < total:
            rest = total - at
            room = [w for w in self.open if size - w[0] >= rest]
            if room:
                target = max(room, key=lambda w: w[0])
            elif len(self.open) < self.most:
                target = [0, []]
                self.open.append(target)
            else:
                target = max(self.open, key=lambda w: w[0])
            take = min(rest, size - target[0])
            target[1].append((doc, at, ids[4 * at : 4 * (at + take)], total))
            target[0] += take
            at += take
            if target[0] == size:
                self.emit(target[1])
                self.open = [w for w in self.open if w is not target]

    def close(self) -> None:
        """What is open, with its ids and running offsets over all open windows."""
        self.emit([p for w in self.open for p in w[1]], keep=True)
        self.open = []


def _bounds(total: int, size: int) -> np.ndarray:
    """Window edges after the last whole window: powers of two, none padded."""
    rest, edges, at = total % size, [], total - total % size
    for bit in range(size.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            edges.append(at)
            at += 1 << bit
    return np.array([*edges, at], np.int64)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text",
    size: int = 1024, open_windows: int = 16, end_id: int = 0,
) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``.

    A document is the ids of its whole text and then ``end_id``. ``size`` is a power of two.
    Pieces of a document are cut freely, cover each id once and lie gapless in their sequences;
    every sequence holds ``size`` tokens or, at the very end, a power of two, so none is padded.

    NULL and empty texts are one ``end_id``. Rows are packed one by one: repeated rows and NULL
    ids are documents of their own (pieces show the id). Other columns are not looked at,
    whatever their names. An empty table gives an empty result. ``tokenizer`` is a file that
    every executor can open.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    kind = docs.schema[id_col].dataType
    fields = (
        "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, seq bigint, "
        "`offset` bigint, part bigint, ids binary"
    )
    end = int(end_id).to_bytes(4, "little")

    def batch_of(ids: pa.Array, out: list[tuple], part: int) -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 8
        numbers = [pa.array(c, pa.int64()) for c in cols[1:7]]
        return pa.RecordBatch.from_arrays(
            [ids, *numbers, pa.array([part] * len(out), pa.int64()), pa.array(cols[7], pa.binary())],
            names=["id", "start", "length", "ids_crc32", "doc_tokens", "seq", "offset", "part", "ids"],
        )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder, packer, arrow = None, Packer(size, open_windows), None
        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            arrow = batch.column("id").type
            keys = batch.column("id").to_pylist()
            for at in range(0, len(keys), 256):
                texts = batch.column("t").slice(at, 256).to_pylist()
                for key, ids in zip(keys[at : at + 256], encoder.encode(texts)):
                    packer.add(key, ids + end)
            yield batch_of(pa.array([x[0] for x in packer.out], arrow), packer.out, part)
            packer.out = []
        if arrow is not None:
            packer.close()
            yield batch_of(pa.array([x[0] for x in packer.out], arrow), packer.out, part)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, start, tokens, begin, total, ids in zip(
                *(batch.column(c).to_pylist() for c in ("id", "start", "doc_tokens", "g", "total", "ids"))
            ):
                tail = _bounds(total, size)
                at, stop = begin, begin + len(ids) // 4
                while at < stop:
                    if at < tail[0]:
                        seq, low, high = at // size, at - at % size, at - at % size + size
                    else:
                        i = int(np.searchsorted(tail, at, "right")) - 1
                        seq, low, high = int(tail[0]) // size + i, int(tail[i]), int(tail[i + 1])
                    cut = min(stop, high)
                    own = ids[4 * (at - begin) : 4 * (cut - begin)]
                    out.append(
                        (key, start + at - begin, cut - at, zlib.crc32(own), tokens, seq, at - low, None)
                    )
                    at = cut
            yield batch_of(pa.array([x[0] for x in out], batch.column("id").type), out, -1)

    schema = f"id {kind.simpleString()}, {fields}"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    packed = save(rows.mapInArrow(first, schema), "packed")
    left = packed.filter("ids IS NOT NULL")
    # one row per partition of the first pass
    per_part = left.groupBy("part").agg(F.sum("length").alias("n"))
    running = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_part.select(
        "part", F.coalesce(F.sum("n").over(running), F.lit(0)).alias("base"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    merged = left.join(bases, "part").select(
        "id", "start", "doc_tokens", (F.col("base") + F.col("offset")).alias("g"), "total", "ids"
    ).mapInArrow(second, schema)
    names = ["start", "length", "ids_crc32", "doc_tokens"]
    apart = (F.col("part") + 1) * F.lit(1 << 32) + F.col("seq")
    return packed.filter("ids IS NULL").unionByName(merged).select(
        F.col("id").alias(id_col), *names, apart.alias("sequence_id"), "offset"
    )
