"""Phrase collocation mining over a weighted de Bruijn graph of word n-grams.

Texts are lower-cased in A-Z, cut at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those into words
between spaces and tabs; nothing spans two pieces. Per language (NULL: ``und``):

* **Edges.** The graph's nodes are ``(longest - 1)``-grams; every ``longest``-gram occurrence is
  an edge from its first to its last ``longest - 1`` words. Each word position gives one record:
  its edge where the piece has room, else the rest of the piece (the piece-end correction, at
  most ``longest - 1`` records a piece). Records are counted per task before the one shuffle, so
  a phrase repeated in a third of all documents arrives as a few counted rows.
* **Pruning.** A gram is no more frequent than any of its words and pairs of neighbours. A
  pass for each counts them by hashes and keeps a bit for the frequent ones in a filter of fixed
  size; a record ends before what surely is rare. Hashes that meet let a record be longer
  than it need be, and never change a count that is kept.
* **Flows.** A ``k``-gram occurs either followed by a word (the prefix of a ``k + 1``-gram) or at
  its piece's end, so ``f_k(g) = sum_w f_(k+1)(g w) + end_k(g)``: the flow through node ``g`` is
  the weight of all records that begin with it. The records are dealt by ranges of their word
  sequences and sorted, so those records lie together and every level's counts are running sums
  over one sorted pass; only counts of at least ``min_count`` (and the parts of groups cut by a
  batch edge, summed afterwards) leave the pass.
* **Candidates** are phrases of ``shortest`` to ``longest`` words with ``a = f >= min_count``.
  Their cut after ``k`` words scores ``floor(1000 a n / (l r))`` in exact decimal arithmetic;
  the lowest score counts, ties to the smallest ``k``.
* **Unary paths.** When every occurrence of a candidate continues along one edge, i.e. a one-word
  extension has the same count, the path is unary: the phrase is compacted into its extension
  and dropped. One-word extensions suffice, as counts fall along any chain of extensions.
* The first ``top`` per language by score, count and phrase (binary UTF-8 order); the ranking
  window keeps only ``top`` rows per task before its shuffle.

Cases: NULL or empty text has no words; a NULL lang is ``und``; repeated rows count twice;
extra columns are ignored; texts of any length are handled whole (their pieces are rows).
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm.common import _LETTER, mix, prefix_hash, raw_bytes, save, text_slices

COMBINE_ROWS = 1 << 19
"""Records a task counts together before sending them on: bounds its memory, not its work."""

PRUNED = 2
"""Words of the longest grams that are counted ahead of the records."""

FILTER_BITS = 1 << 24
"""Bits of a filter: 2 MB, whatever the input."""

_KIND = np.zeros(256, np.uint8)  # 0: in a word, 1: blank, 2: ends a piece
_KIND[[0x20, 0x09]] = 1
_KIND[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_ODD, _PAIR = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)
Filter = np.ndarray | None


class _Slice:
    """The words of some texts: where they lie, and their pieces, languages and hashes."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        data, offsets = raw_bytes(texts)
        kind = _KIND[data]
        inside, edge = kind == 0, np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        self.size = ends - starts
        self.piece = np.cumsum((kind == 2) | edge[:-1])[starts]
        coded = langs.dictionary_encode()
        self.names = coded.dictionary
        per_text = np.diff(np.searchsorted(starts, offsets))
        self.lang = np.repeat(coded.indices.to_numpy(), per_text)
        # the same word of two languages is two words
        total, down = prefix_hash(data, _LETTER)
        salts = np.array([_salt(x) for x in self.names.to_pylist()], np.uint64)
        self.hash = mix((total[ends] - total[starts]) * down[starts] ^ salts[self.lang])
        self.letters = _LOWER[data[inside]]

    def begins(self, filters: tuple[Filter, ...], length: int) -> tuple[list[np.ndarray], np.ndarray]:
        """For 1, 2 .. ``length`` words, where a gram of so many begins that passes its filter and
        whose parts pass theirs (lengths beyond ``filters``: the parts only), and the last hashes."""
        hashes, out = self.hash, [_passes(filters[0] if filters else None, self.hash)]
        for k in range(1, length):
            parts = out[-1][:-1] & out[-1][1:]
            if k == 1:
                parts &= self.piece[:-1] == self.piece[1:]
            if k <= len(filters):  # the hash is asked for, here or by the caller
                hashes = mix(hashes[:-1] * _ODD + self.hash[k:] * _PAIR)
            if k < len(filters):
                parts[parts] = _passes(filters[k], hashes[parts])
            out.append(parts)
        return out, hashes

    def grams(self, at: np.ndarray, length: np.ndarray) -> pa.Array:
        """The ``length`` words from each of ``at`` on, between single spaces."""
        begin = np.cumsum(self.size + 1) - self.size - 1
        spaced = np.full(int((self.size + 1).sum()), 0x20, np.uint8)
        spaced[np.arange(len(self.letters)) + np.repeat(np.arange(len(self.size)), self.size)] = self.letters
        last = at + length - 1
        n = begin[last] + self.size[last] - begin[at]
        offsets = np.concatenate(([0], np.cumsum(n)))
        taken = spaced[np.arange(int(offsets[-1])) + np.repeat(begin[at] - offsets[:-1], n)]
        return pa.Array.from_buffers(
            pa.large_string(), len(at), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(taken)]
        )


def _salt(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


def _slices(batches):
    for batch in batches:
        for start, stop in text_slices(batch, "t"):
            part = batch.slice(start, stop - start)
            yield _Slice(part.column("lang"), part.column("t"))


def _passes(bits: Filter, hashes: np.ndarray) -> np.ndarray:
    if bits is None:
        return np.ones(len(hashes), bool)
    at = hashes & np.uint64(FILTER_BITS - 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _filter(texts: DataFrame, min_count: int, known: tuple[Filter, ...]) -> np.ndarray:
    """A bit for the hash of each gram, one word longer than those of ``known`` and made of what
    passes them, that is seen ``min_count`` times. Others may share the bit, or the 32 bits of
    hash that are counted: what passes may be rare, what doesn't pass surely is."""

    def count(batches):
        held, rows = [], 0
        for own in _slices(batches):
            if len(own.size) <= len(known):
                continue
            at, hashes = own.begins(known, len(known) + 1)
            held.append(hashes[at[-1]].astype(np.uint32))
            rows += len(held[-1])
            if rows >= 8 * COMBINE_ROWS:
                yield counted(held)
                held, rows = [], 0
        if rows:
            yield counted(held)

    def counted(held):
        hashes, often = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(hashes.astype(np.int64)), pa.array(often.astype(np.int64))], names=["h", "f"]
        )

    def block(table: pa.Table) -> pa.Table:
        on = np.zeros(1 << 16, bool)
        on[table["at"].to_numpy() & 0xFFFF] = True
        packed = np.packbits(on, bitorder="little").tobytes()
        return pa.table({"block": table["block"][:1], "bits": pa.array([packed], pa.binary())})

    often = texts.mapInArrow(count, "h long, f long").groupBy("h").agg(F.sum("f").alias("f"))
    places = often.filter(F.col("f") >= min_count).select(
        F.col("h").bitwiseAND(FILTER_BITS - 1).alias("at")
    ).distinct()
    blocks = places.withColumn("block", F.floor(F.col("at") / (1 << 16)).cast("int"))
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in blocks.groupBy("block").applyInArrow(block, "block int, bits binary").collect():  # 2 MB at most
        bits[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _records(docs: DataFrame, longest: int, min_count: int) -> DataFrame:
    """(lang, gram, f): one record per word position, counted per task: its ``longest``-gram edge
    where the piece has room, else the piece's end from there (the piece-end correction).

    A record ends before the first ``PRUNED`` neighbours, or fewer, that are seen less than
    ``min_count`` times in the whole table, as no gram across them is frequent. Counts below
    ``min_count`` are therefore not whole, except those of single words.
    """
    texts = docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"),
    )
    filters = ()
    if min_count > 1:
        for _ in range(min(PRUNED, longest)):
            filters = (*filters, _filter(texts, min_count, filters))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for own in _slices(batches):
            if not len(own.size):
                continue
            begins, _ = own.begins(shared.value, min(longest, len(own.size)))
            length = begins[0].astype(np.int64)
            for at in begins[1:]:
                length[: len(at)] += at
            length[length == 0] = 1  # a rare word alone
            yield pa.table({
                "lang": own.names.take(pa.array(own.lang)).cast(pa.large_string()),
                "gram": own.grams(np.arange(len(length)), length), "f": pa.array(np.ones(len(length), np.int64)),
            })

    return texts.mapInArrow(lambda batches: _combine(run(batches)), "lang string, gram string, f long")


def _combine(tables):
    """Equal records counted together per task, as long as there are up to COMBINE_ROWS."""
    held, rows = [], 0

    def together():
        counted = pa.concat_tables(held).group_by(["lang", "gram"]).aggregate([("f", "sum")])
        return counted.rename_columns(["lang", "gram", "f"])

    def sent(table):
        kinds = pa.schema([("lang", pa.string()), ("gram", pa.string()), ("f", pa.int64())])
        yield from table.cast(kinds).to_batches(max_chunksize=1 << 16)

    for table in tables:
        held.append(table)
        rows += table.num_rows
        if rows >= 2 * COMBINE_ROWS:
            held = [together()]
            rows = held[0].num_rows
            if rows >= COMBINE_ROWS:
                yield from sent(held[0])
                held, rows = [], 0
    if held:
        yield from sent(together())


def _flows(longest: int, min_count: int):
    """Node flows of sorted records: a k-gram's count is the sum over the records that begin
    with it, which lie together. Groups at a batch's edges may go on in the next batch: they are
    sent on as parts, whatever their count, and summed later; inner groups only when frequent."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lang = batch.column("lang")
            f = batch.column("f").to_numpy()
            words = pc.split_pattern(batch.column("gram"), " ")
            length = pc.list_value_length(words).to_numpy()
            out_lang, out_k, out_gram, out_f = [], [], [], []
            for name in pc.unique(lang).to_pylist():  # the words of each language, n
                out_lang.append(name)
                out_k.append(0)
                out_gram.append("")
                out_f.append(int(f[pc.equal(lang, name).to_numpy(zero_copy_only=False)].sum()))
            for k in range(1, longest + 1):
                rows = np.flatnonzero(length >= k)
                if not len(rows):
                    continue
                taken = pa.array(rows)
                prefix = pc.binary_join(pc.list_slice(words.take(taken), 0, k), " ")
                kept_lang = lang.take(taken)
                change = np.ones(len(rows), bool)
                if len(rows) > 1:
                    change[1:] = (
                        pc.not_equal(prefix.slice(1), prefix.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
                        | pc.not_equal(kept_lang.slice(1), kept_lang.slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False)
                    )
                starts = np.flatnonzero(change)
                sums = np.add.reduceat(f[rows], starts)
                edge = np.zeros(len(starts), bool)
                edge[[0, -1]] = True
                keep = np.flatnonzero(edge | (sums >= min_count))
                at = pa.array(starts[keep])
                out_lang += kept_lang.take(at).to_pylist()
                out_k += [k] * len(keep)
                out_gram += prefix.take(at).to_pylist()
                out_f += sums[keep].tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_lang, pa.string()), pa.array(out_k, pa.int32()),
                 pa.array(out_gram, pa.string()), pa.array(out_f, pa.int64())],
                names=["lang", "k", "gram", "f"],
            )

    return run


def phrase_counts(docs: DataFrame, longest: int = 5, min_count: int = 1) -> DataFrame:
    """(lang, k, gram, f) for every gram of 1 to ``longest`` words seen ``min_count`` times or
    more, and (lang, 0, '', n) with each language's number of words.

    The edges and piece ends are counted per task, dealt by ranges of their word sequences and
    sorted; every shorter count is then the flow through a node, the sum over the contiguous
    records that begin with it. One shuffle carries the records; only counts come out.
    """
    counted = save(_records(docs, longest, min_count), "phrase-records")
    # word by word, an absent word as '' (words are never empty, so it sorts first): records that
    # begin with the same words lie together. Ranges are cut on these expressions, so the
    # shuffled rows do not carry them; after the shuffle they are computed once a row to sort.
    def by_words():
        split = F.split("gram", " ")
        return [F.coalesce(F.get(split, i), F.lit("")) for i in range(longest)]

    ranged = counted.repartitionByRange(F.col("lang"), *by_words())
    keys = {f"_w{i}": c for i, c in enumerate(by_words())}
    ordered = ranged.withColumns(keys).sortWithinPartitions("lang", *keys).drop(*keys)
    parts = ordered.mapInArrow(_flows(longest, min_count), "lang string, k int, gram string, f long")
    summed = parts.groupBy("lang", "k", "gram").agg(F.sum("f").alias("f"))
    return summed.filter((F.col("k") == 0) | (F.col("f") >= min_count))


def collocations(
    docs: DataFrame, shortest: int = 2, longest: int = 5, min_count: int = 100, top: int = 2000
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's ``top`` collocations."""
    counts = save(phrase_counts(docs, longest, min_count), "phrase-counts")
    n = counts.filter(F.col("k") == 0).select("lang", F.col("f").alias("n"))
    frequent = counts.filter(F.col("k") >= 1)
    candidates = frequent.filter(F.col("k") >= shortest).select(
        "lang", "k", F.col("gram").alias("phrase"), F.col("f").alias("a")
    )
    # unary paths: a one-word extension as frequent as the phrase itself absorbs it
    longer = frequent.filter(F.col("k") > shortest)
    absorbed = longer.select(
        F.col("lang").alias("at"),
        F.explode(F.array(
            F.regexp_replace("gram", r" [^ ]+$", ""), F.regexp_replace("gram", r"^[^ ]+ ", "")
        )).alias("inner"),
        F.col("f").alias("fq"),
    )
    kept = candidates.join(
        absorbed,
        (F.col("lang") == F.col("at")) & (F.col("phrase") == F.col("inner"))
        & (F.col("fq") * 100 >= F.col("a") * 100),
        "left_anti",
    )
    cuts = kept.select("lang", "k", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("c"))
    words = F.split("phrase", " ")
    cuts = cuts.select(
        "lang", "phrase", "a", "c",
        F.array_join(F.slice(words, 1, F.col("c")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("c") + 1, F.col("k") - F.col("c")), " ").alias("rest"),
    )
    part = frequent.select("lang", F.col("gram").alias("part"), "f")
    scored = (
        cuts.join(part.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
        .join(part.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
        .join(n, "lang")
        .withColumn(
            "score",
            F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l AS DECIMAL(38,0)) * r)").cast("long"),
        )
    )
    best = scored.groupBy("lang", "phrase", "a", "n").agg(
        F.min(F.struct("score", "c", "l", "r")).alias("m")
    ).select("lang", "phrase", "a", "n", "m.score", "m.l", "m.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (
        best.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= top)
        .select(
            "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("a").cast("long").alias("a"),
            F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"),
            F.col("n").cast("long").alias("n"), "score",
        )
    )
