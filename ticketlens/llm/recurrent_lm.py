"""Scoring documents with a recurrent language model that is trained on the corpus.

Counts of all training words, the vocabulary, and the frequencies of rare words come from one
distributed count over all training documents. The network (gru.py) predicts a frequent word,
the end, or a form of rare words (script and ending); a rare word then has its share of its
form's smoothed counts, so probabilities of all possible texts add up to one. Weights are
trained on partitions in parallel and averaged after each round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import gru
from ticketlens.llm.common import fold, save, words_of

FOLDS, HELD = 5, 1
FORMS = 12
# fixed values: letters that tell scripts apart, in this order; any other non-ASCII is a third
UMLAUTS, TILDES = "äöüßÄÖÜ", "ñÑáÁíÍóÓúÚ"
POOL = 12 << 20
BLOCK = 1024


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def form_of(word):
    """The form number of a word, as an expression; ``form`` is the same on bytes."""
    script = (
        F.when(word.rlike(f"[{UMLAUTS}]"), 1).when(word.rlike(f"[{TILDES}]"), 2)
        .when(word.rlike(r"[^\x00-\x7F]"), 3).otherwise(0)
    )
    ending = F.when(word.endswith("."), 1).when(word.endswith(","), 2).otherwise(0)
    return 3 * script + ending


_UMLAUTS, _TILDES = frozenset(UMLAUTS), frozenset(TILDES)


def form(word: bytes) -> int:
    ending = 1 if word.endswith(b".") else 2 if word.endswith(b",") else 0
    if word.isascii():
        return ending
    letters = set(word.decode("utf-8", "replace"))
    return 3 * (1 if letters & _UMLAUTS else 2 if letters & _TILDES else 3) + ending


def encoded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of ``texts`` in a row as numbers, the text of each, and the distinct words."""
    lists = pc.ascii_split_whitespace(texts)
    owner, words = pc.list_parent_indices(lists).to_numpy().astype(np.int32), lists.flatten()
    full = pc.not_equal(pc.binary_length(words), 0)  # blanks at a text's ends
    words = words.filter(full)
    del lists  # each word's bytes were held twice
    coded = words.dictionary_encode()
    return coded.indices.to_numpy(), owner[full.to_numpy(zero_copy_only=False)], coded.dictionary.cast(pa.binary())


def with_ends(symbols: np.ndarray, owner: np.ndarray, n: int, end: int) -> list[np.ndarray]:
    """The symbols of each of ``n`` texts and its end."""
    stops = np.searchsorted(owner, np.arange(n, dtype=np.int32), "right")
    return np.split(np.insert(symbols, stops, end), (stops + np.arange(1, n + 1))[:-1])


def forms_of(words: pa.Array) -> np.ndarray:
    """``form`` of each word."""
    ends = lambda mark: pc.ends_with(words, pattern=mark).to_numpy(zero_copy_only=False)
    out = np.where(ends("."), 1, np.where(ends(","), 2, 0)).astype(np.int32)
    other = np.flatnonzero(~pc.string_is_ascii(words.cast(pa.string())).to_numpy(zero_copy_only=False))
    out[other] = [form(w) for w in words.take(pa.array(other)).to_pylist()]
    return out


class Lexicon:
    """The hot words with their (symbol, count, form or -1), looked up many at a time."""

    def __init__(self, lexicon: dict, forms: list[int]):
        self.words = pa.array(list(lexicon), pa.binary())
        self.known = np.array(list(lexicon.values()), np.int64).reshape(-1, 3)
        self.forms = np.array(forms, np.int32)

    def places(self, words: pa.Array) -> np.ndarray:
        """Each word's place among the hot ones, -1 for others."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def symbols(self, places: np.ndarray, form_no: np.ndarray) -> np.ndarray:
        out = self.forms[form_no]
        out[places >= 0] = self.known[places[places >= 0], 0]
        return out


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Bounded groups of texts, in lower case."""
    for batch in batches:
        texts = pc.fill_null(batch.column("t"), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = int(ends[start - 1]) if start else 0
            stop = min(int(np.searchsorted(ends, base + POOL)) + 1, batch.num_rows)
            yield batch.slice(start, stop - start), pc.ascii_lower(texts.slice(start, stop - start))
            start = stop


def learn(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: int = 1500,
    hot_words: int = 100_000, rounds: int = 2, seed: int = 3,
) -> tuple[dict, DataFrame]:
    """The model and the stored counts of all training words.

    Counts and network both learn from the whole texts of all training documents; a round takes
    the documents of one remainder of their ids' hash. ``hot_words`` bounds the words (64 bytes
    at most) that are sent to executors; counts of all others are joined.
    """
    train = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).filter(~held_out("id"))
    counts = save(
        train.select(F.explode(words_of(fold(F.col("t")))).alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("c")
        ),
        "lm-counts",
    )
    ends = train.count()
    all_, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    total, kinds = all_ + ends, distinct + (ends > 0)
    hot = _hottest(counts, hot_words)
    frequent = hot[:vocabulary]
    # rare words by form: all counts less those of the vocabulary
    mass, types = np.zeros(FORMS), np.zeros(FORMS)
    for r in counts.groupBy(form_of(F.col("word")).alias("f")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["f"]], types[r["f"]] = r["n"], r["v"]
    for word, c in frequent:
        mass[form(word)] -= c
        types[form(word)] -= 1
    symbols = [(c, ("word", w)) for w, c in frequent] + [(ends, ("end", None))]
    symbols += [(int(mass[f]), ("form", f)) for f in range(FORMS)]
    symbols.sort(key=lambda s: -s[0])
    number = {name: i for i, (_, name) in enumerate(symbols)}
    forms = [number["form", f] for f in range(FORMS)]
    lexicon = {}
    for i, (word, c) in enumerate(hot):
        f = form(word)
        lexicon[word] = (number["word", word] if i < len(frequent) else forms[f], c, -1 if i < len(frequent) else f)
    model = {
        "lexicon": lexicon, "forms": forms, "end": number["end", None], "total": total, "kinds": kinds,
        "ends": ends, "scale": np.log10(total + 0.5 * (kinds + 1)),
        "form_scale": np.log10(mass + 0.5 * (types + 1)),
        "net": gru.new_model(np.array([s[0] for s in symbols], float), seed),
    }
    for turn in range(rounds):
        mine = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(rounds)) == turn
        model["net"] = _round(train.filter(mine), model)
    return model, counts


def _hottest(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most ``most`` words, the most frequent first. Counts are cut at a step of a fine
    logarithmic scale, so that no task sends more than its own part of the answer."""
    short = counts.filter(F.octet_length("word") <= 64).withColumn(
        "step", F.floor(F.log2("c") * 16).cast("int")
    )
    steps = short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect()  # under 1,024
    taken, least = 0, 1 << 30
    for step, n in sorted(((r["step"], r["n"]) for r in steps), reverse=True):
        if taken + n > most:
            break
        taken, least = taken + n, step
    rows = short.filter(F.col("step") >= least).select("word", "c").collect()
    return sorted(((r["word"].encode(), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


def _round(docs: DataFrame, model: dict) -> dict:
    """One pass over ``docs``: every task trains its own copy, the copies are averaged by their
    tokens, block by block, so that only one model's weights reach the driver."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        net, tokens, lexicon = known["net"], 0, Lexicon(known["lexicon"], known["forms"])
        for _, raw in _pools(batches):
            codes, owner, words = encoded(raw)
            symbols = lexicon.symbols(lexicon.places(words), forms_of(words))
            texts = with_ends(symbols[codes], owner, len(raw), known["end"])
            del raw, words, codes, owner  # not needed by the network
            net = gru.train(net, texts, known["end"])
            tokens += sum(map(len, texts))
        if tokens:
            flat = np.concatenate([net[k].ravel() for k in gru.NAMES]).astype(np.float64)
            parts = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(len(parts)), pa.int32()), pa.array([tokens] * len(parts), pa.int64()),
                 pa.array([p.tolist() for p in parts], pa.list_(pa.float64()))],
                names=["block", "tokens", "part"],
            )

    def average(table: pa.Table) -> pa.Table:
        weights = table["tokens"].to_numpy().astype(float)
        rows = np.array(table["part"].to_pylist())
        mean = (rows * (weights / weights.sum())[:, None]).sum(0)
        return pa.table({"block": table["block"][:1], "part": pa.array([mean.tolist()], pa.list_(pa.float64()))})

    sent = docs.select("t").mapInArrow(run, "block int, tokens bigint, part array<double>")
    blocks = sent.groupBy("block").applyInArrow(average, "block int, part array<double>").collect()
    if not blocks:
        return model["net"]
    flat = np.concatenate([np.array(b["part"]) for b in sorted(blocks, key=lambda b: b["block"])])
    net, at = {}, 0
    for k in gru.NAMES:
        old = model["net"][k]
        net[k] = flat[at : at + old.size].reshape(old.shape).astype(np.float32)
        at += old.size
    return net


_SCORED = (
    "row bigint, n_tokens bigint, n_known bigint, base double, score double, "
    "words array<struct<word:binary,n:int,form:int>>"
)


def score(docs: DataFrame, model: dict, counts: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``held_out``, ``n_tokens``, ``n_known``,
    ``train_tokens``, ``base_score``, ``score`` (both log10 probabilities of the whole text).

    Every text runs through the network with its state carried from window to window. Words
    outside the hot ones leave the tasks once per document and get their counts by a join.

    NULL, empty and blank texts are one end. Repeated rows and NULL ids (never held out) are
    rows like others; other columns are not looked at. Without any training text all counts are
    0. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        lexicon, end = Lexicon(known["lexicon"], known["forms"]), known["end"]
        scale, form_scale = known["scale"], known["form_scale"]
        for batch, raw in _pools(batches):
            codes, owner, words = encoded(raw)
            distinct, n = max(len(words), 1), len(raw)
            places, form_no = lexicon.places(words), forms_of(words)
            hot = places >= 0
            log_c, more = np.zeros(len(words)), np.zeros(len(words))
            log_c[hot] = np.log10(lexicon.known[places[hot], 1] + 0.5)
            by_form = hot.copy()
            by_form[hot] = lexicon.known[places[hot], 2] >= 0
            more[by_form] = log_c[by_form] - form_scale[form_no[by_form]]
            texts = with_ends(lexicon.symbols(places, form_no)[codes], owner, n, end)
            total = lambda values: np.bincount(owner, values[codes], n)  # noqa: E731, B023
            sizes = np.bincount(owner, minlength=n) + 1
            base = total(log_c) + np.log10(known["ends"] + 0.5) - scale * sizes
            extra = total(more)
            seen = total(hot.astype(float)).astype(np.int64) + (1 if known["ends"] else 0)
            # words outside the hot ones, once per text
            cold = ~hot[codes]
            pairs, often = np.unique(owner[cold].astype(np.int64) * distinct + codes[cold], return_counts=True)
            at, code = np.divmod(pairs, distinct)
            rare = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(at, np.arange(n + 1)), pa.int32()),
                pa.StructArray.from_arrays(
                    [words.take(pa.array(code)), pa.array(often, pa.int32()), pa.array(form_no[code])],
                    names=["word", "n", "form"],
                ),
            )
            del raw, words, codes, owner, cold, pairs, at, code  # not needed by the network
            logs = gru.log_likelihoods(known["net"], texts, end) / np.log(10) + extra
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("held_out"), batch.column("row"),
                 pa.array(sizes, pa.int64()), pa.array(seen, pa.int64()),
                 pa.array(base, pa.float64()), pa.array(logs, pa.float64()), rare],
                names=["id", "held_out", "row", "n_tokens", "n_known", "base", "score", "words"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"), held_out(id_col).alias("held_out"),
        F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    scored = save(rows.mapInArrow(run, f"id {kind}, held_out boolean, {_SCORED}"), "lm-scored")
    left = scored.select("row", F.inline("words")).withColumn("word", F.decode("word", "UTF-8"))
    form_scale = F.array(*(F.lit(float(x)) for x in model["form_scale"]))
    log_c = F.log10(F.coalesce(F.col("c"), F.lit(0)) + 0.5)
    joined = left.join(counts, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(F.col("n") * log_c).alias("more_base"),
        F.sum(F.col("n") * (log_c - F.get(form_scale, F.col("form")))).alias("more_score"),
    )
    zero = F.lit(0.0)
    return scored.drop("words").join(joined, "row", "left").select(
        F.col("id").alias(id_col), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("bigint").alias("n_known"),
        F.lit(model["total"]).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )
