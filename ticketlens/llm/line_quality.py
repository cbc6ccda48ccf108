"""Quality rules with cross-document line frequency per host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import SPACE, save, words_of

SYMBOLS = "#*$%&|<>"  # fixed value
BLANKS = " \t\n\x0b\x0c\r"


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def normal_line(line: Column) -> Column:
    """Lower case, numbers as one 0, blanks collapsed and trimmed."""
    plain = F.regexp_replace(F.lower(line), r"[0-9]+", "0")
    return F.trim(F.regexp_replace(plain, SPACE, " "))


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more, first occurrences included."""

    def covered(places: Column) -> Column:
        gaps = F.transform(
            places,
            lambda p, j: F.when(
                j + 1 < F.size(places), F.least(F.lit(3), F.get(places, j + 1) - p)
            ).otherwise(3),
        )
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, g: a + g)

    def marked(windows: Column) -> Column:
        """Windows in order of their words; one equal to a neighbour is repeated."""
        places = F.transform(
            windows,
            lambda x, j: F.when(
                (F.get(windows, j + 1)["h"] == x["h"])
                | ((j > 0) & (F.get(windows, F.greatest(j - 1, F.lit(0)))["h"] == x["h"])),
                x["i"],
            ),
        )
        return bind(F.sort_array(F.filter(places, lambda p: p.isNotNull())), covered)

    def windows(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.struct(
                F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
            ),
        )

    found = bind(words, lambda w: F.when(F.size(w) >= 3, bind(F.sort_array(windows(w)), marked)))
    return F.coalesce(found, F.lit(0).cast("bigint"))


def measure(docs: DataFrame, id_col: str, text: str, host: str) -> DataFrame:
    """Per row its figures and its distinct normalised lines (hash, words, first in the text)."""
    base = docs.select(
        F.col(id_col).alias("id"), F.col(host).alias("host"),
        F.coalesce(F.col(text), F.lit("")).alias("t"),
    )
    base = base.withColumn("words", words_of(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.translate(x, BLANKS, "") != "")
    hashed = F.transform(
        lines,
        lambda x, i: F.struct(
            F.xxhash64(normal_line(x)).alias("h"), i.alias("i"), F.size(words_of(x)).alias("w")
        ),
    )
    flagged = bind(
        F.sort_array(hashed),
        lambda s: F.transform(
            s,
            lambda x, j: F.struct(
                x["h"].alias("h"), x["w"].alias("w"),
                ((j == 0) | (F.get(s, F.greatest(j - 1, F.lit(0)))["h"] != x["h"])).alias("first"),
            ),
        ),
    )
    return base.select(
        F.monotonically_increasing_id().alias("row"), "id", "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        flagged.alias("lines"),
    )


def judge(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source",
    min_words: int = 50, max_repeat_percent: int = 50, min_docs: int = 10,
    max_share: float = 0.05, max_lost: float = 0.5,
) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``word_chars``, ``n_symbols``,
    ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept``, ``lost_words``.

    A normalised line is boilerplate on a host that has it in at least ``min_docs`` documents
    and in more than ``max_share`` of its documents; every document counts a line once. A
    document is depleted when boilerplate lines hold more than ``max_lost`` of its words.
    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeat_percent`` of them
    in repeated 3-word windows. ``kept``: neither.

    NULL and empty texts have no words and fail. NULL is a host of its own. Repeated rows and
    NULL ids are rows like others. Columns are read by the given names only, and an empty table
    gives an empty result. The figures are stored once, so row numbers stay the same for both
    uses of the lines. Counts are combined before each shuffle; a hot line's rows are joined with
    one row per host and line, which AQE can split.
    """
    rows = save(measure(docs, id_col, text, host), "quality-rows")
    lines = rows.select("row", "host", F.inline("lines"))
    counts = lines.filter("first").groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    common = counts.filter(F.col("n") >= min_docs).alias("c").join(
        sizes.alias("s"), F.col("c.host").eqNullSafe(F.col("s.host"))
    ).filter(F.col("n") > F.lit(max_share) * F.col("docs")).select(
        F.col("c.host").alias("on_host"), F.col("c.h").alias("on_h")
    )
    lost = lines.join(
        common, lines.host.eqNullSafe(common.on_host) & (lines.h == common.on_h)
    ).groupBy("row").agg(F.sum("w").alias("lost_words"))
    failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")
    )
    lost_words = F.coalesce(F.col("lost_words"), F.lit(0).cast("bigint"))
    return rows.join(lost, "row", "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words", failed.alias("base_failed"),
        (~failed & (lost_words <= F.lit(max_lost) * F.col("n_words"))).alias("kept"),
        lost_words.alias("lost_words"),
    )
