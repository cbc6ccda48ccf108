"""N-gram Jaccard join: size-banded tiles of hashed bitmap signatures.

A document's set is its distinct 3-word shingles (words between ASCII blanks, A-Z lower-cased;
with fewer words the whole sequence is the one shingle; no words: the empty set, linked with
nothing). Two documents link when ``100 * |A & B| >= percent * |A | B|``; the result is one row
per document with the smallest doc_id its links reach.

1. Equal sets form a group under an order-free 128-bit key and its size; the group's smallest
   doc_id is found by an aggregate of keys alone. Sets travel once, to their tiles: a task
   sends on only the first set of each key it meets, and a tile keeps one set per key, so a
   group of copies of any size costs at most one set per input partition.
2. Sizes fall into bands ``e_0 = 1``, ``e_(k+1) = floor(100 e_k / percent) + 1``: sets two bands
   apart cannot link (their size ratio alone is below ``percent``).
3. Bands are laid out in order into *chunks* of at most ``chunk_shingles`` shingles: small bands
   share a chunk, a large band is dealt by id hash into chunks of its own. A *tile* is a pair of
   chunks that can hold a linking pair (their bands at most one apart), and one task; sets are
   dealt by their key, so copies share a chunk; a set goes
   to the tiles of its own chunk and, when its band borders another chunk's, to those too. At
   first it goes there as a bitmap alone (at least twice its band's largest size in bits, one bit
   per shingle hash, a 16th or less of the set), and whole only to the tiles where some bitmap
   leaves room for a link. Every bit of ``a xor b`` stands for a different element of the symmetric difference,
   so ``|A & B| <= (|A| + |B| - popcount(a xor b)) / 2``; only pairs whose bound still allows a
   link have their sorted arrays intersected, and pairs that the tile's union-find already
   joined are not compared again. A tile emits a spanning forest of its links, never all pairs
   of a group.
4. The forests' links, moved to the groups' smallest ids, give components by large-star/small-star
   rounds.

Work grows with the pairs inside neighbouring bands (the method compares every pair of a tile by
bitmap); nothing is capped or sampled.

Cases: NULL or blank text: empty set, component is the document itself. NULL doc_id: its row is
returned with a NULL component and takes part in no link. Rows repeated with one doc_id are equal
sets and collapse. Extra input columns are ignored; texts of any length are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import mix, prefix_hash, raw_bytes, save, text_slices
from ticketlens.operators.components import connected_components

WIDTH = 3
PERCENT = 90
CHUNK_SHINGLES = 1 << 23
"""Shingles of one chunk: 64 MB of hashes, so a tile holds at most 128 MB of sets."""

BLOCK_SHINGLES, BLOCK_PAIRS = 1 << 18, 1 << 17
"""Shingles hashed into bitmaps at once, and pairs compared at once: a task's helper arrays."""

TILE_ROWS = 1_000_000
"""Largest tile table (chunk, band, partner) that is broadcast to the sets."""

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTERS = np.random.default_rng(31).integers(1, 1 << 63, 256, np.uint64)
_LETTERS[ord("A") : ord("Z") + 1] = _LETTERS[ord("a") : ord("z") + 1]
_LONG_WORD = 48
_SEED = np.uint64(0x2545F4914F6CDD1D)


def bands(percent: int, largest: int = 1 << 62) -> np.ndarray:
    """Band edges e_0 = 1 < e_1 < ... up to beyond ``largest``."""
    edges = [1]
    while edges[-1] <= largest:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(bands(percent), sizes, "right") - 1


def bitmap_words(largest: int) -> int:
    """64-bit words of a tile's bitmaps: at least twice its largest set in bits."""
    return max(1, 1 << max(0, (2 * int(largest) - 1).bit_length() - 6))


def _word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit word hashes, and each text's first word. Words of 48 bytes or more are hashed by
    BLAKE2b, as long words can defeat a polynomial hash."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    total, down = prefix_hash(data, _LETTERS)
    hashes = mix((total[ends] - total[starts]) * down[starts])
    for i in np.flatnonzero(ends - starts >= _LONG_WORD):
        word = data[starts[i] : ends[i]].copy()
        word[(word >= 65) & (word <= 90)] += 32
        hashes[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
    return hashes, np.searchsorted(starts, offsets)


def batch_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct 64-bit shingle hashes, as values and n + 1 offsets."""
    hashes, bounds = _word_hashes(*raw_bytes(texts))
    counts = np.diff(bounds)
    # rolling hash of every run of ``width`` words in the batch; runs across texts are dropped
    size = len(hashes) - width + 1
    total = np.full(max(size, 0), np.uint64(width) * _SEED, np.uint64)
    for j in range(width):
        total = mix(total ^ hashes[j : j + len(total)]) + np.uint64(j + 1)
    owner = np.repeat(np.arange(len(counts)), counts)[: len(total)]
    inside = np.arange(len(total)) + width <= bounds[1:][owner] if len(total) else np.zeros(0, bool)
    values, owners = mix(total[inside]), owner[inside]
    short = np.flatnonzero((counts > 0) & (counts < width))  # fewer words: the whole sequence
    if len(short):
        extra = []
        for t in short:
            words = hashes[bounds[t] : bounds[t + 1]]
            one = np.array([np.uint64(len(words)) * _SEED], np.uint64)
            for j, w in enumerate(words):
                one = mix(one ^ w) + np.uint64(j + 1)
            extra.append(mix(one)[0])
        values = np.concatenate((values, np.array(extra, np.uint64)))
        owners = np.concatenate((owners, short))
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[first], owners[first]
    offsets = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(np.bincount(owners, minlength=len(counts)), out=offsets[1:])
    return values, offsets


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    values, offsets = batch_sets(texts, width)
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


def _only(values, offsets, columns, keep):
    """The rows of ``keep``: their sets and columns."""
    rows = np.flatnonzero(keep)
    sizes = offsets[rows + 1] - offsets[rows]
    at = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(int(sizes.sum()))
    new_offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    taken = pa.array(rows)
    return values[at], new_offsets, [c.take(taken) for c in columns]


def packed_bitmaps(values: np.ndarray, offsets: np.ndarray, band: np.ndarray, percent: int) -> pa.Array:
    """A bitmap per set, as wide as its band asks for: one bit per shingle hash."""
    edges = bands(percent, max(1, int(np.diff(offsets).max(initial=1))) * 2)
    words = np.array([bitmap_words(e - 1) for e in edges[1:]], np.int64)[np.maximum(band, 0)]
    words[band < 0] = 0
    ends = np.concatenate(([0], np.cumsum(words)))
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    on = np.zeros(int(ends[-1]) * 64, bool)
    on[ends[owner] * 64 + (values % (words[owner] * 64).astype(np.uint64)).astype(np.int64)] = True
    bits = np.packbits(on, bitorder="little").view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(bits))


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps, a row each, as they would be with ``words`` words: one column per set."""
    narrow = np.bitwise_or.reduce(maps.reshape(len(maps), -1, words), axis=1)
    return np.ascontiguousarray(narrow.T)


def _sets(
    docs: DataFrame, width: int, percent: int, with_sets: bool = True, linkable: bool = False,
    with_bits: bool = False, carried: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, n_shingles, the order-free set key k1 and k2, band, the ``carried`` columns (and
    the set itself, or its bitmap).

    ``linkable``: only rows with an id and a non-empty set, and of equal sets in one input
    partition only the first, so that a group of copies of any size sends at most one set per
    partition on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for whole in batches:
            for start, stop in text_slices(whole):
                batch = whole.slice(start, stop - start)
                values, offsets = batch_sets(batch.column("text"), width)
                sizes = np.diff(offsets)
                full = sizes > 0
                k1 = np.zeros(len(sizes), np.uint64)
                k2 = np.zeros(len(sizes), np.uint64)
                if len(values):
                    k1[full] = np.add.reduceat(mix(values), offsets[:-1][full])
                    k2[full] = np.bitwise_xor.reduceat(mix(values ^ _SEED), offsets[:-1][full])
                columns = [batch.column("doc_id"), pa.array(sizes), pa.array(k1.view(np.int64)),
                           pa.array(k2.view(np.int64)), pa.array(band_of(sizes, percent).astype(np.int32))]
                names = ["doc_id", "n_shingles", "k1", "k2", "band", *carried]
                columns += [batch.column(c) for c in carried]
                if linkable:
                    keep = np.zeros(len(sizes), bool)
                    present = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                    for i in np.flatnonzero(full & present):
                        mark = (int(sizes[i]), int(k1[i]), int(k2[i]))
                        if mark not in seen:
                            seen.add(mark)
                            keep[i] = True
                    values, offsets, columns = _only(values, offsets, columns, keep)
                if with_bits:
                    columns.append(packed_bitmaps(values, offsets, columns[4].to_numpy(), percent))
                    names.append("bits")
                elif with_sets:
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64))))
                    names.append("shingles")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *carried
    )
    schema = "doc_id long, n_shingles long, k1 long, k2 long, band int"
    schema += "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    return rows.mapInArrow(run, schema + (", bits array<long>" if with_bits else ", shingles array<long>" if with_sets else ""))


def _bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    """A bit per shingle hash, ``words`` 64-bit words a set: one column per set. Sets are taken
    in blocks, so that the helper arrays stay small whatever the band's size."""
    maps = np.zeros((len(sets), words), np.uint64)
    lo, held = 0, 0
    for i, own in enumerate(sets):
        held += len(own)
        if held >= BLOCK_SHINGLES or i + 1 == len(sets):
            block = sets[lo : i + 1]
            spot = (np.concatenate(block) % np.uint64(words * 64)).astype(np.int64)
            owner = np.repeat(np.arange(lo, i + 1), [len(x) for x in block])
            np.bitwise_or.at(maps, (owner, spot >> 6), np.left_shift(np.uint64(1), (spot & 63).astype(np.uint64)))
            lo, held = i + 1, 0
    return np.ascontiguousarray(maps.T)


def _lists_of(table: pa.Table, name: str) -> list[np.ndarray]:
    """Each row's list, as a view of the table's own memory."""
    out = []
    for part in table.column(name).chunks:
        values = part.values.to_numpy(zero_copy_only=False).view(np.uint64)
        offsets = part.offsets.to_numpy()
        out += [values[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return out


def _tile_marks(percent: int):
    """A tile's first task, on bitmaps alone: the sets that may link with another of the tile."""

    def run(table: pa.Table) -> pa.Table:
        diagonal = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        key = ("side", "n_shingles", "k1", "k2")
        column = {c: table.column(c).to_numpy() for c in (*key, "band")}
        order = np.lexsort(tuple(column[c] for c in ("k2", "k1", "n_shingles", "side")))
        first = np.zeros(len(order), bool)  # one set per key
        first[:1] = True
        for c in key:
            first[1:] |= column[c][order][1:] != column[c][order][:-1]
        kept = order[first]
        kept = kept[np.argsort(column["n_shingles"][kept], kind="stable")]
        sizes, side, band = (column[c][kept] for c in ("n_shingles", "side", "band"))
        rows = _lists_of(table, "bits")
        maps = {}
        for s, b in sorted(set(zip(side.tolist(), band.tolist()))):
            maps[s, b] = np.stack([rows[i] for i in kept[(side == s) & (band == b)]])
        marked = np.zeros(len(kept), bool)
        other = 0 if diagonal else 1
        for s, b in [k for k in maps if k[0] == 0]:
            left = np.flatnonzero((side == 0) & (band == b))
            for b2 in (b - 1, b, b + 1):
                if (other, b2) not in maps or (diagonal and b2 < b):
                    continue  # none, or met when band b2 was the left one
                same = diagonal and b2 == b
                right = left if same else np.flatnonzero((side == other) & (band == b2))
                words = min(maps[0, b].shape[1], maps[other, b2].shape[1])
                maps_l = folded(maps[0, b], words)
                maps_r = maps_l if same else folded(maps[other, b2], words)
                step = max(1, BLOCK_PAIRS // len(right))
                for lo in range(0, len(left), step):
                    block = left[lo : lo + step]
                    r0, r1, keep = _candidates(percent, sizes, block, right, lo, same, maps_l, maps_r)
                    marked[block[keep.any(1)]] = True
                    marked[right[r0:r1][keep.any(0)]] = True
        taken = pa.array(kept[marked])
        return table.select(["n_shingles", "k1", "k2", "x", "y", "side"]).take(taken)

    return run


def _candidates(percent, sizes, block, right, lo, same, maps_l, maps_r):
    """The stretch of ``right`` whose sizes allow a link with ``block`` (``left`` from ``lo`` on),
    and which pairs the bitmaps' bound leaves."""
    r0 = int(np.searchsorted(sizes[right], -(-percent * sizes[block[0]] // 100)))
    r1 = int(np.searchsorted(sizes[right], 100 * sizes[block[-1]] // percent, "right"))
    r0 = max(r0, lo + 1) if same else r0
    r1 = max(r0, r1)
    ones = np.zeros((len(block), r1 - r0), np.int64)
    if r0 == r1:
        return r0, r1, ones > 0
    for a, b in zip(maps_l, maps_r):
        ones += np.bitwise_count(a[lo : lo + len(block), None] ^ b[None, r0:r1])
    one, two = sizes[block][:, None], sizes[right[r0:r1]][None, :]
    total = one + two
    keep = ((100 + percent) * ((total - ones) // 2) >= percent * total) & (
        100 * np.minimum(one, two) >= percent * np.maximum(one, two)
    )
    if same:
        keep &= np.arange(lo, lo + len(block))[:, None] < np.arange(r0, r1)[None, :]
    return r0, r1, keep


def _tile_links(percent: int):
    """A tile's task: bitmap bound, then exact intersection; a spanning forest of its links.

    Sets are compared band by band with the neighbouring bands only, on bitmaps sized for the
    larger of the two bands. A band's sets stand by size, so a block of them meets only the
    stretch of the other band whose sizes allow a link.
    """

    def run(table: pa.Table) -> pa.Table:
        diagonal = table.column("x")[0].as_py() == table.column("y")[0].as_py()
        column = {c: table.column(c).to_numpy() for c in ("doc_id", "k1", "k2", "side", "band")}
        sets = _lists_of(table, "shingles")
        # copies of one set from several input partitions: the smallest id stays
        order = np.lexsort((column["doc_id"], column["k2"], column["k1"], column["side"]))
        k1, k2, sd = (column[c][order] for c in ("k1", "k2", "side"))
        first = np.ones(len(order), bool)
        first[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (sd[1:] != sd[:-1])
        kept = order[first]
        kept = kept[np.argsort([len(sets[i]) for i in kept], kind="stable")]
        sets = [sets[i] for i in kept]
        ids, side, band = (column[c][kept] for c in ("doc_id", "side", "band"))
        sizes = np.array([len(x) for x in sets], np.int64)
        parent = np.arange(len(ids))

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        out_a, out_b = [], []
        left_all = np.flatnonzero(side == 0)
        right_all = left_all if diagonal else np.flatnonzero(side == 1)
        for b in np.unique(band[left_all]):
            left = left_all[band[left_all] == b]
            for b2 in (b - 1, b, b + 1):
                if diagonal and b2 < b:
                    continue  # met when band b2 was the left one
                same = diagonal and b2 == b
                right = left if same else right_all[band[right_all] == b2]
                if not len(right):
                    continue
                words = bitmap_words(max(sizes[left[-1]], sizes[right[-1]]))
                maps_l = _bitmaps([sets[i] for i in left], words)
                maps_r = maps_l if same else _bitmaps([sets[i] for i in right], words)
                step = max(1, BLOCK_PAIRS // len(right))
                for lo in range(0, len(left), step):
                    block = left[lo : lo + step]
                    r0, _, keep = _candidates(percent, sizes, block, right, lo, same, maps_l, maps_r)
                    for i, j in zip(*np.nonzero(keep)):
                        a, c = int(block[i]), int(right[r0 + j])
                        ra, rc = find(a), find(c)
                        if ra == rc:  # already joined in this tile: the link would add nothing
                            continue
                        common = np.intersect1d(sets[a], sets[c], assume_unique=True).size
                        if 100 * common >= percent * (sizes[a] + sizes[c] - common):
                            parent[max(ra, rc)] = min(ra, rc)
                            out_a.append(ids[a])
                            out_b.append(ids[c])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})

    return run


def layout(totals: dict[int, int], chunk_shingles: int) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """Chunks over the bands in order: band -> (first chunk, chunks dealt by hash), and each
    chunk's (lowest, highest) band."""
    place, spans = {}, []
    load = chunk_shingles  # the running chunk is full: the next band opens one
    for band in sorted(totals):
        total = totals[band]
        if total > chunk_shingles:
            parts = -(-total // chunk_shingles)
            place[band] = (len(spans), parts)
            spans += [(band, band)] * parts
            load = chunk_shingles
            continue
        if load + total > chunk_shingles or spans[-1][1] < band - 1:
            spans.append((band, band))
            load = 0
        place[band] = (len(spans) - 1, 1)
        spans[-1] = (spans[-1][0], band)
        load += total
    return place, spans


def tiles_of(place: dict[int, tuple[int, int]], spans: list[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """(chunk, band, x, y): the tiles (x, y), x <= y, that sets of ``band`` in ``chunk`` join."""
    out = []
    for band, (first, parts) in place.items():
        for chunk in range(first, first + parts):
            for other, (low, high) in enumerate(spans):
                if other >= chunk and low <= band + 1:
                    out.append((chunk, band, chunk, other))
                elif other < chunk and high >= band - 1:
                    out.append((chunk, band, other, chunk))
    return out


def jaccard_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, chunk_shingles: int = CHUNK_SHINGLES
) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    key = ["n_shingles", "k1", "k2"]
    sets = save(_sets(docs, width, percent, with_sets=False), "jaccard-keys")
    linkable = sets.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    # one row per distinct set: its smallest id, combined before the shuffle; no sets travel
    groups = save(
        linkable.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("band").alias("band")),
        "jaccard-groups",
    )
    # one row per band: as many rows as bands, about 400 for sizes up to 2^62
    per_band = groups.groupBy("band").agg(F.sum("n_shingles").alias("total")).collect()
    place, spans = layout({r["band"]: int(r["total"]) for r in per_band}, chunk_shingles)
    if place:
        # as many rows as (chunk, band, partner) triples: bands, chunks and their neighbours,
        # not documents; Spark chooses how to join it
        listed = tiles_of(place, spans)
        tiles = spark.createDataFrame(listed, "chunk long, band int, x long, y long")
        tiles = F.broadcast(tiles) if len(listed) <= TILE_ROWS else tiles  # counted just above
        first = F.create_map(*[v for b, (c, _) in sorted(place.items()) for v in (F.lit(b), F.lit(c))])
        parts = F.create_map(*[v for b, (_, n) in sorted(place.items()) for v in (F.lit(b), F.lit(n))])
        chunk = first[F.col("band")] + F.pmod(F.xxhash64("k1", "k2"), parts[F.col("band")])
        drawn = (
            _sets(docs, width, percent, linkable=True, with_bits=True)
            .withColumn("chunk", chunk.cast("long")).join(tiles, ["chunk", "band"])
            .select("n_shingles", "k1", "k2", "band", "bits", "x", "y",
                    F.when(F.col("chunk") == F.col("x"), 0).otherwise(1).alias("side"))
        )
        marked = save(
            drawn.groupBy("x", "y").applyInArrow(
                _tile_marks(percent), "n_shingles long, k1 long, k2 long, x long, y long, side int"
            ),
            "jaccard-marked",
        )
        # the tiles of each set that may link there; its text is read again, through its smallest id
        wanted = groups.join(marked, key).groupBy("rep", *key).agg(
            F.collect_set(F.struct("x", "y", "side")).alias("tiles")
        ).select(F.col("rep").alias("doc_id"), F.struct(*key).alias("wanted"), "tiles")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id")
        placed = (
            _sets(texts, width, percent, carried=("wanted", "tiles"))
            .filter(F.struct(*key) == F.col("wanted"))
            .select("doc_id", "k1", "k2", "band", "shingles", F.inline("tiles"))
        )
        found = save(
            placed.groupBy("x", "y").applyInArrow(_tile_links(percent), "a long, b long"), "jaccard-links"
        )
    else:
        found = spark.createDataFrame([], "a long, b long")
    members = linkable.select("doc_id", *key).join(groups.select(*key, "rep"), key)
    rep_of = members.select(F.col("doc_id").alias("a"), F.col("rep").alias("ra"))
    links = (
        found.join(rep_of, "a")
        .join(rep_of.withColumnsRenamed({"a": "b", "ra": "rb"}), "b")
        .select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    )
    roots = connected_components(links).select(F.col("node").alias("rep"), "root")
    labels = (
        members.join(roots, "rep", "left")
        .select("doc_id", *key, F.coalesce("root", "rep").alias("component_id"))
        .distinct()
    )
    return sets.join(labels, ["doc_id", *key], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    )
