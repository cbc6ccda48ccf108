"""Near duplicates by circulant MinHash (Li and Li, "C-MinHash", 2021), banding, exact checks.

Signatures: one permutation scatters a document's shingles over ``RING`` slots, a second one,
shifted by k places, gives coordinate k as the smallest value met. So two permutations make
every coordinate, and all coordinates of a shingle are one contiguous slice of the second one.

Links: documents with equal shingle sets become one class first, so a group of copies costs one
row per document and no pairs. Classes meet in bands. A round picks one centre per bucket and
compares the other members with it, on the whole sets; what linked is joined into components,
and only members of other components are compared in the next round. A round in which under
one pair in a hundred links is followed by the last one at once. The last round finds every
link left in a bucket, without a cap: the members' differences from the bucket's centre are
joined by a prefix filter (see ``_deltas``), rarest elements first (see ``_prefixes``), so members
that differ from the centre in different places never meet, however many they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import mix, raw_bytes, save, text_slices, word_hashes
from ticketlens.operators.components import connected_components

RING = 1 << 20
BLOCK = 4096
HELD = 1 << 18  # elements of one batch of differences
FEW = 100  # fixed value: with fewer links than pairs / FEW, rounds with centres have done their part
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_tables: dict[tuple[int, int], np.ndarray] = {}


def _circulant(seed: int, length: int) -> np.ndarray:
    """Row s holds the second permutation from slot s on, ``length`` places, round the ring."""
    if (seed, length) not in _tables:
        order = np.random.default_rng(seed).permutation(RING).astype(np.int32)
        ring = np.concatenate((order, order[: length - 1]))
        _tables[seed, length] = np.lib.stride_tricks.sliding_window_view(ring, length)
    return _tables[seed, length]


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, bounds = word_hashes(*raw_bytes(texts))
    mixed = np.zeros(len(hashes), np.uint64)
    for j in range(min(width, len(hashes))):  # all texts together may have fewer words
        mixed[: len(hashes) - j] += mix(hashes[j:] * _A + np.uint64(j * int(_B) % (1 << 64)))
    mixed = mix(mixed)
    for start, stop in zip(bounds[:-1], bounds[1:]):
        if stop - start >= width:
            yield np.unique(mixed[start : stop - width + 1])
        elif stop > start:  # fewer words: the whole sequence is the one shingle
            total = _C
            for h in hashes[start:stop]:
                total = mix(np.array([total ^ h], np.uint64))[0]
            yield np.array([total], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, length: int, seed: int) -> np.ndarray:
    """All ``length`` coordinates of a non-empty shingle set."""
    table = _circulant(seed, length)
    slots = (mix(shingles ^ np.uint64(seed)) % np.uint64(RING)).astype(np.int64)
    low = np.full(length, RING, np.int32)
    for at in range(0, len(slots), BLOCK):
        np.minimum(low, table[slots[at : at + BLOCK]].min(axis=0), out=low)
    return low


def signatures(
    docs: DataFrame, id_col: str, text: str, width: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """(id, seen, n_shingles, mark, keys): the set's fingerprint and one key per band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = np.random.default_rng(seed + 1).integers(1, 1 << 63, (bands, rows), np.uint64)
        for batch in batches:
            for start, stop in text_slices(batch, "t"):
                part = batch.slice(start, stop - start)
                sizes, marks, keys = [], [], []
                for s in shingle_sets(part.column("t"), width):
                    sizes.append(len(s))
                    if not len(s):
                        marks.append(None)
                        keys.append(None)
                        continue
                    marks.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                    low = signature(s, bands * rows, seed).reshape(bands, rows)
                    mixed = mix((low.astype(np.uint64) + np.uint64(1)) * (mult | np.uint64(1)))
                    keys.append(mix(mixed.sum(axis=1, dtype=np.uint64)).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("seen"), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64()))],
                    names=["id", "seen", "n_shingles", "mark", "keys"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    rows_in = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("seen"), F.col(text).alias("t")
    )
    return rows_in.mapInArrow(
        run, f"id {kind}, seen bigint, n_shingles bigint, mark binary, keys array<bigint>"
    )


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The (a, b) whose whole sets overlap by ``percent``; b's text is fetched first, then the
    centre's, which AQE may copy to split a hot centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            good = []
            for start, stop in text_slices(batch, "tb"):
                own = shingle_sets(batch.column("tb").slice(start, stop - start), width)
                for i, right in zip(range(start, stop), own):
                    if last != a[i] or last is None:
                        last = a[i]
                        kept = next(shingle_sets(batch.column("ta").slice(i, 1), width))
                    both = len(np.intersect1d(kept, right, assume_unique=True))
                    if 100 * both >= percent * (len(kept) + len(right) - both) and both:
                        good.append(i)
            yield batch.select(["a", "b"]).take(pa.array(good, pa.int64()))

    left = texts.select(F.col("mark").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("mark").alias("b"), F.col("t").alias("tb"))
    rows = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(run, "a binary, b binary")


def _deltas(rows: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(c, mark, label, n, d, f, index, probe, tokens): what the last round joins, by member.

    D(x), here ``tokens``, is the symmetric difference of a member's set and its centre's; two
    members' sets differ by as much as their D do. With Q = 100 + percent, P = 100 - percent and
    F(x) = Q |D(x)| - P |x|, a link between a and b means |D(a) & D(b)| >= (F(a) + F(b)) / 2Q.
    Of two members in different components one at least is not linked to the centre, and that
    means F > P |c|; so the bound is above 0 and the first common element, in any fixed order,
    lies within the first |D| - bound + 1 elements of both. The member of the smaller F is met
    through ``index`` elements, the other one through ``probe``; members of neither are left out.
    """
    q, p = 100 + percent, 100 - percent
    names = ["c", "mark", "label", "n", "d", "f", "index", "probe", "tokens"]

    def packed(batch, taken, figures, tokens):
        kept = batch.select(["c", "mark", "label"]).take(pa.array(taken, pa.int64()))
        columns = (pa.array(x, pa.int64()) for x in zip(*figures))
        ends = np.cumsum([0] + [len(t) for t in tokens])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(tokens).view(np.int64)))
        return pa.RecordBatch.from_arrays([*kept.columns, *columns, lists], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hub = None, np.zeros(0, np.uint64)
        for batch in batches:
            centres, loose = batch.column("c").to_pylist(), batch.column("loose").to_pylist()
            taken, figures, tokens, held = [], [], [], 0
            for start, stop in text_slices(batch, "tb"):
                own = shingle_sets(batch.column("tb").slice(start, stop - start), width)
                for i, mine in zip(range(start, stop), own):
                    if last != centres[i]:
                        last = centres[i]
                        hub = next(shingle_sets(batch.column("ta").slice(i, 1), width))
                    apart_ = np.setxor1d(mine, hub, assume_unique=True)
                    d = len(apart_)
                    f, apart = q * d - p * len(mine), p * len(hub) + 1
                    lowest = 2 * percent - p * len(hub) if loose[i] else apart
                    index = d - -(-(f + max(f, apart)) // (2 * q)) + 1
                    probe = d - -(-(f + lowest) // (2 * q)) + 1 if f >= apart else 0
                    if min(max(index, probe), d) <= 0:
                        continue
                    taken.append(i)
                    figures.append((len(mine), d, f, index, probe))
                    tokens.append(apart_)
                    held += d
                    if held >= HELD:
                        yield packed(batch, taken, figures, tokens)
                        taken, figures, tokens, held = [], [], [], 0
            if taken:
                yield packed(batch, taken, figures, tokens)

    left = texts.select(F.col("mark").alias("c"), F.col("t").alias("ta"))
    right = texts.select("mark", F.col("t").alias("tb"))
    pairs = rows.join(right, "mark").join(left, "c").select("c", "mark", "label", "loose", "ta", "tb")
    return pairs.mapInArrow(
        run, "c binary, mark binary, label binary, n bigint, d bigint, f bigint, index bigint, "
        "probe bigint, tokens array<bigint>",
    )


def _prefixes(deltas: DataFrame) -> DataFrame:
    """(c, token, mark, label, at, index, probe, n, d, f): the elements members are met through.

    A member's elements stand in the order of how many members of its centre have them, the
    rarest first. What all members have in common, like the centre's own deviations, so comes
    last and brings together only members whose whole D is of that kind. Elements of one member
    alone meet nothing; they only take the first places.
    """
    each = deltas.select("c", "row", F.explode("tokens").alias("token"))
    shared = each.groupBy("c", "token").agg(F.count(F.lit(1)).alias("often")).filter("often > 1")
    ranked = each.join(shared, ["c", "token"]).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ranked")
    )
    n_shared = F.size("ranked")
    reach = F.greatest("index", "probe") - F.col("d") + n_shared  # the first places are taken
    # cut before the explode: a row of one element must not carry all of them
    placed = deltas.drop("tokens").join(ranked, "row").withColumn("taken", F.col("d") - n_shared).withColumn(
        "ranked", F.slice("ranked", F.lit(1), F.greatest(F.least(reach, n_shared), F.lit(0)).cast("int"))
    )
    at = F.col("taken") + F.col("i")
    return placed.select(
        "c", "mark", "label", "taken", "index", "probe", "n", "d", "f", F.posexplode("ranked").alias("i", "one")
    ).select(
        "c", F.col("one.token").alias("token"), "mark", "label", at.alias("at"),
        (at < F.col("index")).alias("index"), (at < F.col("probe")).alias("probe"), "n", "d", "f",
    )


def _meetings(deltas: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one centre whose first common difference leaves room for a link."""
    x, y = deltas.filter("index").alias("x"), deltas.filter("probe").alias("y")
    need = F.col("x.f") + F.col("y.f")
    room = 2 * (100 + percent)
    met = x.join(
        y,
        (F.col("x.c") == F.col("y.c")) & (F.col("x.token") == F.col("y.token"))
        & (F.col("x.label") != F.col("y.label"))
        & (F.struct("x.f", "x.mark") < F.struct("y.f", "y.mark"))
        & ((F.col("x.d") - F.col("x.at")) * room >= need)
        & ((F.col("y.d") - F.col("y.at")) * room >= need)
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")),
    )
    return met.select(
        F.least("x.mark", "y.mark").alias("a"), F.greatest("x.mark", "y.mark").alias("b")
    ).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5,
    percent: int = 80, bands: int = 40, rows: int = 6, stars: int = 3, seed: int = 11,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id``, ``kept``.

    Documents are linked when 100 * shared >= ``percent`` * united distinct ``width``-word
    shingles (lower-cased words; fewer words make one shingle). ``component_id`` is the smallest
    id that links reach. With the defaults a pair at the threshold is missed by every band with
    a probability under 1e-5 (``(1 - 0.8^6)^40``).

    NULL, empty and blank texts have no shingles and link with nothing. A NULL id is linked with
    nothing either (``component_id`` NULL, kept). Rows that repeat an id are one document: links
    of any of its texts count for all of them, and each row is returned. Other columns are not
    looked at, whatever their names. An empty table gives an empty result. ``stars`` is the
    largest number of rounds with centres, one at least.
    """
    if stars < 1:
        raise ValueError("stars must be 1 or more")
    marked = save(
        signatures(docs, id_col, text, width, bands, rows, seed), "minhash-marks"
    )
    known = marked.filter(F.col("id").isNotNull() & F.col("mark").isNotNull())
    # copies: one class per distinct set, read through its smallest id; equal sets, equal keys
    classes = save(
        known.groupBy("mark").agg(
            F.min(F.struct("id", "seen")).alias("one"), F.first("n_shingles").alias("n"),
            F.first("keys").alias("keys"),
        ),
        "minhash-classes",
    )
    spread = classes.select(
        "mark", F.col("one.id").alias("id"), "n", F.posexplode("keys").alias("band", "key")
    )
    full = spread.groupBy("band", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    members = save(
        spread.join(full.select("band", "key"), ["band", "key"]), "minhash-buckets"
    )
    wanted = members.select("mark").distinct().join(classes, "mark").select("mark", "one.*")
    source = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text).alias("seen"), F.col(text).alias("t")
    )
    texts = source.join(wanted, ["id", "seen"]).dropDuplicates(["mark"]).select("mark", "t")
    texts = save(texts, "minhash-texts")

    links = tried = None  # between classes
    few = False
    labels = classes.select(F.col("mark").alias("node"), F.col("mark").alias("root"))
    turn, last = -1, False
    while not last:
        turn += 1
        last = turn == stars or few
        at = members.join(labels, members.mark == labels.node).select(
            "band", "key", "mark", "id", "n", F.col("root").alias("label")
        )
        centre = F.struct(
            F.col("mark").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl")
        )
        # the first and the last centre are the smallest id in every band, so that most bands
        # name the same pairs; others differ from band to band and from round to round
        by_id = turn == 0 or last
        order = F.struct("id", "mark") if by_id else F.xxhash64("mark", "band", F.lit(turn))
        open_ = at.groupBy("band", "key").agg(
            F.min("label").alias("lo"), F.max("label").alias("hi"),
            F.min_by(centre, order).alias("m"), F.count(F.lit(1)).alias("size"),
        ).filter("lo < hi")
        if not last:
            met = at.join(open_.select("band", "key", "m.*"), ["band", "key"]).filter("label <> cl")
            fresh = met.filter(  # no larger overlap than the smaller set
                100 * F.least("n", "cn") >= percent * F.greatest("n", "cn")
            ).select(F.col("c").alias("a"), F.col("mark").alias("b")).distinct()
        else:  # every member has been compared with this centre in the first round
            met = at.join(
                open_.filter("size > 2").select("band", "key", "m.*"), ["band", "key"]
            ).filter("mark <> c")
            own = met.groupBy("band", "key").agg(F.max(F.col("label") == F.col("cl")).alias("loose"))
            met = met.join(own, ["band", "key"]).groupBy("c", "mark").agg(
                F.first("label").alias("label"), F.max("loose").alias("loose")
            )
            deltas = _deltas(met, texts, width, percent).withColumn("row", F.monotonically_increasing_id())
            prefixes = _prefixes(save(deltas, "minhash-deltas"))
            fresh = _meetings(save(prefixes, "minhash-prefixes"), percent)
        if tried is not None:
            backward = tried.select(F.col("b").alias("a"), F.col("a").alias("b"))
            fresh = fresh.join(tried.unionByName(backward), ["a", "b"], "left_anti")
        fresh = save(fresh, "minhash-pairs")
        compared, few = fresh.count(), True
        if not compared:
            continue
        tried = fresh if tried is None else tried.unionByName(fresh)
        found = save(_confirm(fresh, texts, width, percent), "minhash-links")
        linked = found.count()
        few = FEW * linked < compared
        if not linked:
            continue
        links = found if links is None else links.unionByName(found)
        joined = connected_components(links)
        labels = save(
            classes.select(F.col("mark").alias("node")).join(joined, "node", "left").select(
                "node", F.coalesce("root", "node").alias("root")
            ),
            "minhash-labels",
        )

    ids = save(
        known.select("id", "mark").join(labels.withColumnRenamed("node", "mark"), "mark")
        .select("id", "root").distinct(),
        "minhash-ids",
    )
    names = ids.groupBy("root").agg(F.min("id").alias("name"))
    ids = ids.join(names, "root").select("id", "name")
    several = ids.groupBy("id").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    several = several.filter("a < b")
    if not several.isEmpty():  # an id with several texts ties their components together
        ends = several.select("id").join(ids, "id").select(
            F.col("name").alias("a"), F.col("id").alias("b")
        )
        tied = connected_components(ends).withColumnRenamed("node", "name")
        ids = ids.join(tied, "name", "left").select("id", F.coalesce("root", "name").alias("name"))
    ids = ids.groupBy("id").agg(F.min("name").alias("name"))
    return marked.select("id", "n_shingles").join(ids, "id", "left").select(
        F.col("id").alias(id_col), "n_shingles", F.coalesce("name", "id").alias("component_id"),
        (F.col("id").isNull() | (F.coalesce("name", "id") == F.col("id"))).alias("kept"),
    )
