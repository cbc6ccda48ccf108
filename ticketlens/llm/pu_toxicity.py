"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017), in numpy.

Confirmed toxic documents are the positives, all others unlabelled: their risk as negatives is
corrected by the class prior, and where the corrected part turns negative its gradient is
reversed, which keeps the classifiers from fitting the unlabelled toxic texts as clean.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.common import raw_bytes, save, text_slices
from ticketlens.llm.decontaminate import normal_words

FOLDS = 5


def held_out(id_col: str):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _counts(docs: DataFrame) -> DataFrame:
    """(positive, n, words, counts) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in text_slices(batch, "t"):
                part = batch.slice(start, stop - start)
                sizes, words, counts = [], [], []
                for text in part.column("t"):
                    found = Counter(normal_words(text.as_buffer().to_pybytes() if text.is_valid else b""))
                    sizes.append(sum(found.values()))
                    words.append(list(found))
                    counts.append(list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("positive"), pa.array(sizes, pa.int64()),
                     pa.array(words, pa.list_(pa.binary())), pa.array(counts, pa.list_(pa.int32()))],
                    names=["positive", "n", "words", "counts"],
                )

    return docs.mapInArrow(
        run, "positive boolean, n bigint, words array<binary>, counts array<int>"
    )


def features(hits: list[int], n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sparse features of a text from the numbers of its known words: how often, and how dense."""
    found = Counter(hits)
    at = np.fromiter(found.keys(), np.int64, len(found))
    tf = np.fromiter(found.values(), np.float64, len(found))
    return np.concatenate((at, at + size)), np.concatenate((np.log1p(tf), np.minimum(50 * tf / max(n, 1), 1.5)))


def fit_nnpu(
    rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, positive: np.ndarray, dims: int,
    prior: float, epochs: int, seed: int, l2: float = 5e-4, rate: float = 0.05,
) -> np.ndarray:
    """Weights and, last, the bias of a linear classifier of least non-negative risk."""
    rng = np.random.default_rng(seed)
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)
    w[-1] = np.log(prior / (1 - prior))
    starts = np.searchsorted(rows, np.arange(len(positive) + 1))
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    if not len(pos) or not len(unl):
        return w
    steps, batches = 0, max(1, len(unl) // 512)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for _ in range(max(epochs, -(-200 // batches))):
        for u in np.array_split(rng.permutation(unl), batches):
            p = rng.choice(pos, min(len(pos), 512), replace=False)
            chosen = np.concatenate((p, u))
            sizes = starts[chosen + 1] - starts[chosen]
            item = np.repeat(np.arange(len(chosen)), sizes)
            at = np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts[chosen], sizes)
            z = np.bincount(item, vals[at] * w[cols[at]], len(chosen)) + w[-1]
            s, is_p = sigmoid(z), np.arange(len(chosen)) < len(p)
            soft = np.logaddexp(0, z)  # loss as a negative; as a positive it is soft - z
            negative = soft[~is_p].mean() - prior * soft[is_p].mean()
            grad = np.where(is_p, -prior * s / len(p), s / len(u))  # of the corrected negative risk
            if negative < 0:
                grad = -grad
            else:
                grad = grad + np.where(is_p, prior * (s - 1) / len(p), 0)
            g = np.bincount(cols[at], grad[item] * vals[at], dims + 1) + l2 * w
            g[-1] = grad.sum()
            steps += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.999**steps)) + 1e-8)
    return w


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text",
    label: str = "toxic", max_positive: int = 4000, max_unlabelled: int = 12000,
    max_words: int = 2048, min_docs: int = 8, models: int = 3, epochs: int = 20, seed: int = 5,
) -> dict:
    """The classifiers: words, weights. Learns from rows that are not held out: at most
    ``max_positive`` toxic ones and ``max_unlabelled`` others, those of smallest id hash (a
    bounded sample of labelled rows; the only part of this operator that is bounded), with the
    class prior of all usable labels."""
    keys = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(
        F.max(label).alias("toxic")
    ).filter(~held_out(id_col))
    share = keys.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    prior = float(np.clip(share or 0.05, 0.005, 0.5))
    ids = docs.select(F.col(id_col).alias("id")).filter(F.col("id").isNotNull()).distinct()
    toxic = keys.filter("toxic = 1").select(F.col(id_col).alias("id"))
    order = [F.xxhash64("id", F.lit(seed)), F.col("id")]
    pos = toxic.join(ids, "id").orderBy(*order).limit(max_positive).withColumn("positive", F.lit(True))
    others = ids.filter(~held_out("id")).join(toxic, "id", "left_anti")
    unl = others.orderBy(*order).limit(max_unlabelled).withColumn("positive", F.lit(False))
    sample = F.broadcast(pos.unionByName(unl))  # bounded by the two parameters
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")).join(sample, "id")
    # copies of one text say no more than the text
    rows = rows.withColumn("seen", F.xxhash64("t")).dropDuplicates(["positive", "seen"])
    rows = save(rows.drop("seen"), "toxicity-sample")
    counted = _counts(rows.select("positive", "t"))
    # words that tell positives from the rest, by the distance of their document shares
    per_word = counted.select("positive", F.explode("words").alias("w")).filter(
        F.octet_length("w") <= 64
    ).groupBy("w").agg(
        F.count_if("positive").cast("double").alias("p"), F.count_if(~F.col("positive")).cast("double").alias("u")
    ).filter(F.col("p") + F.col("u") >= min_docs)
    sizes = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_p, n_u = float(sizes.get(True, 0) or 1), float(sizes.get(False, 0) or 1)
    both = (F.col("p") + F.col("u")) / (n_p + n_u)
    far = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both + 1e-9) * (1 / n_p + 1 / n_u))
    best = per_word.withColumn("far", far).filter("far > 3").orderBy(F.desc("far"), "w").limit(max_words)
    words = [bytes(r["w"]) for r in best.select("w").collect()]
    number = {w: i for i, w in enumerate(words)}
    known = rows.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for start, stop in text_slices(batch, "t"):
                for text in batch.column("t").slice(start, stop - start):
                    w = normal_words(text.as_buffer().to_pybytes() if text.is_valid else b"")
                    hits = [i for i in map(known.value.get, w) if i is not None]
                    out.append(features(hits, len(w), len(known.value)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("positive"),
                 pa.array([c.tolist() for c, _ in out], pa.list_(pa.int64())),
                 pa.array([x.tolist() for _, x in out], pa.list_(pa.float64()))],
                names=["id", "positive", "cols", "vals"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    got = rows.select("id", "positive", "t").mapInArrow(
        run, f"id {kind}, positive boolean, cols array<bigint>, vals array<double>"
    ).toArrow().sort_by([("id", "ascending")])  # bounded as the sample is
    positive = got["positive"].to_numpy().astype(bool)
    sizes_ = np.array([len(x) for x in got["cols"]], np.int64)
    cols = np.concatenate([np.asarray(x.values) for x in got["cols"]] or [np.zeros(0)]).astype(np.int64)
    vals = np.concatenate([np.asarray(x.values) for x in got["vals"]] or [np.zeros(0)]).astype(float)
    fitted = [
        fit_nnpu(np.repeat(np.arange(len(positive)), sizes_), cols, vals, positive, 2 * len(words), prior, epochs, seed + i)
        for i in range(models)
    ]
    return {"number": number, "weights": np.mean(fitted, axis=0), "prior": prior}


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: id (every column with ``keep``), ``score`` from 0 to 1.

    The whole text counts. NULL, empty and wordless texts get the score of no known word.
    Repeated rows and NULL ids are rows like others; with ``keep`` a column named ``score`` is
    replaced. An empty table gives an empty result.
    """
    names = [c for c in docs.columns if c != "score"] if keep else [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weights = shared.value["number"], shared.value["weights"]
        get = number.get
        for batch in batches:
            scores = []
            for start, stop in text_slices(batch, "__t"):
                data, offsets = raw_bytes(batch.column("__t").slice(start, stop - start))
                whole = data.tobytes()
                for a, b in zip(offsets[:-1], offsets[1:]):
                    words = normal_words(whole[a:b])
                    hits = [i for i in map(get, words) if i is not None]
                    z = weights[-1]
                    if hits:
                        at, value = features(hits, len(words), len(number))
                        z += float(weights[at] @ value)
                    scores.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
            columns = {n: batch.column(n) for n in batch.schema.names if n != "__t"}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(scores, pa.float64())})

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)), F.col(text).alias("__t"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "__t")
    return rows.mapInArrow(run, f"{fields}, score double").select(
        *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "score"
    )
