"""Benchmark decontamination with an Aho-Corasick automaton over word numbers.

Both sides are normalised alike: A-Z to a-z, words of digits, letters and non-ASCII bytes. Every
``window``-word stretch of a benchmark item is a pattern. A text becomes numbers of benchmark
words and is scanned once; matches are runs of words, mapped back to byte offsets of the text as
it was. The automaton is built from at most ``block_words`` benchmark words; a larger benchmark
is scanned for in several blocks, one after the other, so memory stays bounded.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm.common import raw_bytes, text_slices

# fixed values: bytes of words, and A-Z to a-z
_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Matcher:
    """The automaton of some items: (number, words) each."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int):
        self.numbers: dict[bytes, int] = {}
        patterns: dict[tuple[int, ...], set[int]] = {}
        for item, words in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words)
            n = min(window, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                patterns.setdefault(ids[i : i + n], set()).add(item)
        self.least = min(map(len, patterns), default=0)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, owners in patterns.items():
            self.automaton.add_word(key, (len(key), sorted(owners)))
        if patterns:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [first, last) word runs that items cover, and the items."""
        runs: list[list[int]] = []
        items: set[int] = set()
        if not self.least or len(words) < self.least:
            return [], items
        get = self.numbers.get
        ids = tuple([get(w, 0) for w in words])
        for end, (length, owners) in self.automaton.iter(ids):
            start = end - length + 1
            items.update(owners)
            while runs and start <= runs[-1][0]:  # a longer match may begin before earlier ones
                runs.pop()
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end + 1)
            else:
                runs.append([start, end + 1])
        return [tuple(r) for r in runs], items


def _merge(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int):
    """Bounded blocks of (number, id, words), fetched one partition at a time."""
    block, size = [], 0
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(
        F.col("i").isNotNull() & F.col("t").isNotNull()
    )
    for row in rows.distinct().toLocalIterator():
        words = normal_words(row["t"].encode())
        if not words:
            continue
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["i"], words))
        size += len(words)
    if block:
        yield block


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
_SPANS = "array<struct<start:bigint,stop:bigint>>"


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
    item_id: str = "item_id", item_text: str = "text", window: int = 10,
    block_words: int = 1 << 21, keep: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: id (every column with ``keep``), then ``n_words``, ``n_hit``
    words, ``items`` (ids as sorted strings), ``spans`` of bytes of the text, ``contaminated``.

    An item occurs where ``window`` consecutive words of it do; one of fewer words (but not
    none) where all of them do. Words inside any occurrence are hit.

    NULL, empty and wordless texts have no words and no hits; items without id or words are
    ignored; items with one id are one item. Repeated rows are answered each; a NULL id is kept.
    With ``keep``, columns of ``docs`` named like results are replaced; otherwise other columns
    are not looked at. Empty tables on either side give no hits or no rows.
    """
    results = ("n_words", "n_hit", "items", "spans", "contaminated")
    names = [c for c in docs.columns if c not in results] if keep else [id_col]
    rows = docs.select(
        *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)),
        F.col(text).alias("t"),
        F.array().cast(_SPANS).alias("runs"), F.array().cast("array<string>").alias("items"),
    )
    blocks = _blocks(items, item_id, item_text, block_words)
    block = next(blocks, [])
    for following in blocks:
        rows = rows.mapInArrow(_scanner(docs.sparkSession, block, window), rows.schema)
        block = following
    rows = _place(rows, _scanner(docs.sparkSession, block, window))
    return rows.select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)),
        "n_words",
        F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r.stop - r.start).alias("n_hit"),
        F.array_sort("items").alias("items"), "spans", (F.size("runs") > 0).alias("contaminated"),
    )


def _scanner(spark: SparkSession, block: list[tuple], window: int):
    """A kernel that adds one block's runs and items to what earlier blocks found."""
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = None
        for batch in batches:
            matcher = matcher or Matcher(shared.value, window)
            runs, names = [], []
            old_runs, old_items = batch.column("runs"), batch.column("items")
            for start, stop in text_slices(batch, "t"):
                data, offsets = raw_bytes(batch.column("t").slice(start, stop - start))
                whole = data.tobytes()
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]), start):
                    found, items = matcher.find(normal_words(whole[a:b]))
                    before = old_runs[row].as_py() if found else None
                    if before:
                        found = _merge([*found, *((r["start"], r["stop"]) for r in before)])
                    if found:
                        runs.append([{"start": x, "stop": y} for x, y in found])
                        names.append(sorted({*map(str, items), *old_items[row].as_py()}))
                    else:
                        runs.append(old_runs[row].as_py())
                        names.append(old_items[row].as_py())
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns |= {"runs": pa.array(runs, _KIND), "items": pa.array(names, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def _place(rows: DataFrame, scan) -> DataFrame:
    """Scan for the last block, count words and turn word runs into byte spans of the text, all
    in one Python worker a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan(batches):
            counts, spans = [], []
            runs = batch.column("runs")
            hits = np.diff(runs.offsets.to_numpy())
            for start, stop in text_slices(batch, "t"):
                data, offsets = raw_bytes(batch.column("t").slice(start, stop - start))
                whole = data.tobytes().translate(_TABLE)
                inside = np.append(False, np.frombuffer(whole, np.uint8) != 32)
                begins = inside[1:] & ~inside[:-1]
                begins[offsets[:-1][offsets[:-1] < len(data)]] |= inside[1:][
                    offsets[:-1][offsets[:-1] < len(data)]
                ]
                total = np.append(0, np.cumsum(begins))
                counts.append(total[offsets[1:]] - total[offsets[:-1]])
                for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:]), start):
                    if not hits[row]:
                        spans.append([])
                        continue
                    words = [m.span() for m in _WORD.finditer(whole[a:b])]
                    spans.append([
                        {"start": words[r["start"]][0], "stop": words[r["stop"] - 1][1]}
                        for r in runs[row].as_py()
                    ])
            columns = {n: batch.column(n) for n in batch.schema.names if n != "t"}
            n_words = np.concatenate(counts) if counts else np.zeros(0)
            columns |= {"n_words": pa.array(n_words, pa.int64()), "spans": pa.array(spans, _KIND)}
            yield pa.RecordBatch.from_pydict(columns)

    fields = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "t"
    )
    return rows.mapInArrow(run, f"{fields}, n_words bigint, spans {_SPANS}")


def drop_leaks(
    docs: DataFrame, items: DataFrame, most: float = 0.5, **kwargs
) -> DataFrame:
    """``docs`` without contaminated passages: hit words are cut out of the text, and documents
    that lose more than the share ``most`` of their words go. Clean rows pass as they are."""
    text = kwargs.get("text", "text")
    found = find_leaks(docs, items, keep=True, **kwargs)

    def kept(t):
        data = F.encode(t, "UTF-8")
        stops = F.concat(F.array(F.lit(0).cast("bigint")), F.col("spans.stop"))
        starts = F.concat(F.col("spans.start"), F.array(F.octet_length(t).cast("bigint")))
        parts = F.zip_with(
            stops, starts,
            lambda a, b: F.decode(F.substring(data, (a + 1).cast("int"), (b - a).cast("int")), "UTF-8"),
        )
        return F.array_join(parts, "")

    clean = F.when(F.col("contaminated"), kept(F.col(text))).otherwise(F.col(text))
    rows = found.filter(F.col("n_hit") <= F.lit(most) * F.col("n_words"))
    return rows.withColumn(text, clean).select(docs.columns)
