"""Exact removal of repeated passages with suffix arrays over shards.

Which bytes can repeat is found first. Every ``length``-byte window has one anchor: the smallest
``GRAM``-byte hash inside it. Equal windows have equal anchors at equal offsets, so only anchors
met more than once matter, and all windows of one anchor occurrence form one context. Copies of
a whole context are settled by its fingerprint, the smallest place stays; only anchors with
different contexts are left for the suffix arrays, with those few bytes. A shard holds whole
anchor groups; its suffix array is made by induced sorting, its permuted common prefixes join
the windows of ``length`` equal bytes. A group of more than ``group_limit`` contexts is dealt
out window by window instead, each with its own key, so no task has to hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import mix, prefix_hash, raw_bytes, save, text_slices
from ticketlens.llm.suffix_arrays import permuted_common_prefixes, shard_of, suffix_array

GRAM = 32
SEGMENT = 1 << 20
SHARD = 1 << 21
BITS = 24  # of a key of the smallest-hash search, for the place; segments are shorter
_BYTES = np.random.default_rng(7).integers(1, 1 << 64, 256, np.uint64)
Arrays = dict[str, np.ndarray]


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours: suffix minima of one block, prefix minima of the
    next."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> Arrays | None:
    """Anchor occurrences of joined texts: text number, anchor hash, context hash, first window
    (``at``, in its text), anchor offset in it, number of windows."""
    n, width = len(data), length - GRAM + 1
    if n < length:
        return None
    total, down = prefix_hash(data, _BYTES)
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    place = np.arange(len(grams), dtype=np.uint64)
    mask = np.uint64((1 << BITS) - 1)
    low = (sliding_min((grams & ~mask) | place, width) & mask).astype(np.int64)
    good = np.zeros(len(low), bool)
    spans = np.zeros(n + 2, np.int32)
    sizes = np.diff(offsets)
    long_ = sizes >= length
    np.add.at(spans, offsets[:-1][long_], 1)
    np.add.at(spans, offsets[1:][long_] - length + 1, -1)
    good = np.cumsum(spans[: len(low)]) > 0
    fresh = good.copy()
    fresh[1:] &= (low[1:] != low[:-1]) | ~good[:-1]
    starts = np.flatnonzero(fresh)
    # texts touch, so one may end where the next begins: a new text begins a new run
    edges = offsets[:-1][long_]
    starts = np.union1d(starts, edges)
    if not len(starts):
        return None
    rows = np.searchsorted(offsets, starts, "right") - 1
    stops = np.append(starts[1:], len(low))
    stops = np.minimum(stops, offsets[rows + 1] - length + 1)
    count = stops - starts
    offset = low[starts] - starts
    ends = starts + count - 1 + length
    whole = mix((total[ends] - total[starts]) * down[starts])
    whole = mix(whole ^ (offset.astype(np.uint64) << np.uint64(32)) ^ count.astype(np.uint64))
    return {
        "row": rows, "h": grams[low[starts]].view(np.int64), "c": whole.view(np.int64),
        "at": starts - offsets[rows], "offset": offset, "count": count,
    }


def segments(part: pa.RecordBatch, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, shift, bytes, offsets) of bounded size; a long text is cut into overlapping
    segments that share no window."""
    for start, stop in text_slices(part, "t"):
        data, offsets = raw_bytes(part.column("t").slice(start, stop - start))
        if len(data) <= SEGMENT + length:
            yield start, 0, data, offsets
            continue
        for at in range(0, len(data) - length + 1, SEGMENT):  # one long text
            piece = data[at : at + SEGMENT + length - 1]
            yield start, at, piece, np.array([0, len(piece)])


_ANCHORS = "h bigint, c bigint, id bigint, seen int, at bigint, offset int, count int"


def _find_anchors(docs: DataFrame, length: int) -> DataFrame:
    """Anchor rows. Within a batch the smallest place of a context is enough; the others are
    returned as already settled (``c`` NULL), spread by a key of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for first, shift, data, offsets in segments(batch, length):
                if (got := anchors(data, offsets, length)) is not None:
                    got["row"] = got["row"] + first
                    got["at"] = got["at"] + shift
                    found.append(got)
            if not found:
                continue
            all_ = {k: np.concatenate([f[k] for f in found]) for k in found[0]}
            ids = batch.column("id").to_numpy(zero_copy_only=False)[all_["row"]]
            seen = batch.column("seen").to_numpy(zero_copy_only=False)[all_["row"]]
            order = np.lexsort((all_["at"], seen, ids, all_["c"]))
            all_ = {k: v[order] for k, v in all_.items()} | {"id": ids[order], "seen": seen[order]}
            again = np.append(False, all_["c"][1:] == all_["c"][:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(again))))
            same = np.logical_and.reduce([all_[k] == all_[k][head] for k in ("id", "seen", "at")])
            keep = ~(again & same)
            all_ = {k: v[keep] for k, v in all_.items()}
            again = again[keep]
            spread = mix(all_["c"].view(np.uint64) + all_["at"].astype(np.uint64) * np.uint64(_BYTES[0]))
            h = np.where(again, spread.view(np.int64), all_["h"])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(all_["c"], mask=again), pa.array(all_["id"], pa.int64()),
                 pa.array(all_["seen"], pa.int32()), pa.array(all_["at"], pa.int64()),
                 pa.array(all_["offset"], pa.int32()), pa.array(all_["count"], pa.int32())],
                names=["h", "c", "id", "seen", "at", "offset", "count"],
            )

    return docs.mapInArrow(run, _ANCHORS)


def _settle(rows: DataFrame, group_limit: int) -> DataFrame:
    """Drop anchors met once, settle copies of a context, keep the rest with their group's size."""
    group = Window.partitionBy("h")
    same = Window.partitionBy("h", "c").orderBy("id", "seen", "at")
    place = F.struct("id", "seen", "at")
    marked = rows.withColumn("first", F.first(place).over(same)).withColumns(
        {
            "size": F.count(F.lit(1)).over(group),
            "mixed": F.min("c").over(group) < F.max("c").over(group),
        }
    )
    settled = F.col("c").isNull() | (F.col("first") != place)
    return marked.filter(settled | F.col("mixed")).select(
        "h", "id", "seen", "at", "offset", "count", settled.alias("settled"),
        (F.col("size") > group_limit).alias("hot"),
    )


_CONTEXTS = "key bigint, id bigint, seen int, at bigint, count int, bytes binary"


def _contexts(docs: DataFrame, asked: DataFrame, length: int) -> DataFrame:
    """The bytes of the asked contexts; those of hot anchors window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("asked")
            for row, text in enumerate(batch.column("t")):
                data = text.as_buffer().to_pybytes()
                key, at, count, parts = [], [], [], []
                for ask in lists[row].as_py():
                    start, windows = ask["at"], ask["count"]
                    if ask["hot"]:
                        piece = np.frombuffer(data[start : start + windows - 1 + length], np.uint8)
                        total, down = prefix_hash(piece, _BYTES)
                        whole = mix((total[length:] - total[:-length]) * down[:windows])
                        key += whole.view(np.int64).tolist()
                        at += range(start, start + windows)
                        count += [1] * windows
                        parts += [data[i : i + length] for i in range(start, start + windows)]
                    else:
                        key.append(ask["h"])
                        at.append(start)
                        count.append(windows)
                        parts.append(data[start : start + windows - 1 + length])
                n = len(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key, pa.int64()), pa.array([batch.column("id")[row].as_py()] * n, pa.int64()),
                     pa.array([batch.column("seen")[row].as_py()] * n, pa.int32()),
                     pa.array(at, pa.int64()), pa.array(count, pa.int32()), pa.array(parts, pa.binary())],
                    names=["key", "id", "seen", "at", "count", "bytes"],
                )

    per_doc = asked.groupBy("id", "seen").agg(
        F.collect_list(F.struct("h", "at", "count", "hot")).alias("asked")
    )
    rows = docs.join(per_doc, ["id", "seen"]).select("id", "seen", "t", "asked")
    return rows.mapInArrow(run, _CONTEXTS)


def later_windows(groups: list[tuple[np.ndarray, ...]], length: int) -> list[np.ndarray]:
    """For contexts (ordered by place) the windows whose bytes start at an earlier place, as a
    boolean array each, by the suffix array of their joined bytes."""
    pieces = [g[-1] for g in groups]
    text, begins = shard_of(pieces)
    order = suffix_array(text)
    shared = permuted_common_prefixes(text, order)
    counts = np.array([len(p) - length + 1 for p in pieces], np.int64)
    piece = np.repeat(np.arange(len(pieces)), counts)
    inside = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    positions = begins[piece] + inside
    classes = np.empty(len(text), np.int64)
    classes[order] = np.cumsum(shared[order] < length)
    mine = classes[positions]
    # pieces come in order of place, except windows of overlapping contexts of one text
    ids = np.array([g[0] for g in groups])[piece]
    seen = np.array([g[1] for g in groups])[piece]
    at = np.array([g[2] for g in groups])[piece] + inside
    by = np.lexsort((at, seen, ids, mine))
    new = np.append(True, mine[by][1:] != mine[by][:-1])
    head = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    later = np.zeros(len(by), bool)
    later[by] = (ids[by] != ids[head]) | (seen[by] != seen[head]) | (at[by] != at[head])
    return np.split(later, np.cumsum(counts)[:-1])


_RUNS = "id bigint, seen int, start bigint, stop bigint"


def _match(contexts: DataFrame, length: int) -> DataFrame:
    """Later windows of every key's contexts as byte runs."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for g, late in zip(rows, later_windows(rows, length)):
            marks = np.flatnonzero(np.diff(late.astype(np.int8), prepend=0, append=0))
            for a, b in zip(marks[::2].tolist(), marks[1::2].tolist()):
                out.append((g[0], g[1], g[2] + a, g[2] + b - 1 + length))
        cols = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "seen", "start", "stop"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: list[tuple] = []
        size, key, group, first, single = 0, None, [], None, []

        def close() -> None:
            nonlocal size, group
            if len(group) > 1:
                shard.extend(group)
                size += sum(len(g[-1]) for g in group)
            group = []

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "id", "seen", "at", "bytes"))):
                if row[0] != key:
                    close()
                    key, first = row[0], None
                    if size >= SHARD:
                        yield solve(shard)
                        shard, size = [], 0
                if len(row[4]) == length:  # single windows: the first one stays, at any number
                    if first is None:
                        first = row
                        group.append(row[1:])
                    elif row[4] != first[4]:
                        group.append(row[1:])
                    elif row[1:4] != first[1:4]:
                        single.append((row[1], row[2], row[3], row[3] + length))
                else:
                    group.append(row[1:])
            if single:
                cols = list(zip(*single))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=["id", "seen", "start", "stop"],
                )
                single = []
        close()
        if shard:
            yield solve(shard)

    rows = contexts.repartition("key").sortWithinPartitions("key", "id", "seen", "at")
    return rows.mapInArrow(run, _RUNS)


def _cut(docs: DataFrame, runs: DataFrame, carry: list[str]) -> DataFrame:
    """Each document without its runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, found in zip(batch.column("t"), batch.column("runs")):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                merged: list[list[int]] = []
                starts, stops = (
                    (found.values.field(0).to_numpy(), found.values.field(1).to_numpy())
                    if found.is_valid else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                )
                for i in np.argsort(starts, kind="stable"):
                    a, b = int(starts[i]), int(stops[i])
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                cuts = [0, *(x for m in merged for x in m), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                spans.append([{"start": a, "stop": b} for a, b in merged])
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in carry), pa.array(sizes, pa.int64()),
                 pa.array(spans, kind), pa.array(kept, pa.binary())],
                names=[*carry, "n_bytes", "spans", "kept"],
            )

    per_doc = runs.groupBy("id", "seen").agg(F.collect_list(F.struct("start", "stop")).alias("runs"))
    rows = docs.join(per_doc, ["id", "seen"], "left").select(*carry, "t", "runs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*carry).schema)
    return rows.mapInArrow(
        run, f"{fields}, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary"
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", length: int = 100,
    group_limit: int = 8192,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``spans`` (maximal removed byte runs), ``kept``.

    A byte goes if a ``length``-byte string covers it that also starts earlier: in a document of
    smaller id (``id_col`` must be integer) or earlier in the same one. Strings are judged on the
    input, never reach over a document's end, and may overlap. ``length`` must exceed GRAM.

    NULL and empty texts have 0 bytes; texts shorter than ``length`` stay whole. A NULL id counts
    as smaller than any other. Rows that repeat id and text are one document and get one answer;
    different texts under one id come in the order of their checksums. Other columns are not
    looked at, whatever their names. An empty table gives an empty result.
    """
    if length <= GRAM:
        raise ValueError(f"length must exceed {GRAM}")
    lowest = -(1 << 63)
    source = docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(lowest)).alias("id"),
        (F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")) - (1 << 31)).cast("int").alias("seen"),
        F.col(text).alias("t"),
    )
    found = save(_settle(_find_anchors(source, length), group_limit), "repeats-anchors")
    asked = found.filter(~F.col("settled"))
    copies = found.filter("settled").select(
        "id", "seen", F.col("at").alias("start"),
        (F.col("at") + F.col("count") - 1 + length).alias("stop"),
    )
    matched = save(_match(_contexts(source, asked, length), length), "repeats-matched")
    out = _cut(source, copies.unionByName(matched), ["id"])
    return out.select(
        F.when(F.col("id") != lowest, F.col("id")).alias(id_col), "n_bytes", "spans", "kept"
    )
