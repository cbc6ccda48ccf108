"""Ranked search, phrase mining and the n-gram Jaccard join against brute force."""

import itertools
import math
import os
import random
import re
import sys
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from ticketlens.llm import bitmap_join  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, component_id int, lang string"  # component_id clashes


def near_corpus():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeXYZé") for _ in range(rng.randint(1, 5))) for _ in range(40)]
    base = [" ".join(rng.choice(words) for _ in range(n)) for n in (60, 120, 30, 300)]
    texts = []
    for b in base:
        texts.append(b)
        for k in range(6):  # near copies: one or two words changed, or a few added
            w = b.split()
            for _ in range(k % 3):
                w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w + ["tail"] * (k // 3)))
    texts += [base[0].upper(), "a b", "A B", "a", "", None, " \t\n", "x" * 5000 + " y z",
              "é" * 70 + " long word", "é" * 70 + " long word"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 80))) for _ in range(30)]
    huge = " ".join(rng.choice(words) for _ in range(250_000))  # over 1 MiB: several slices
    texts += [huge, huge + " one more"]
    rows = [(i, t, 1, "en") for i, t in enumerate(texts)]
    return rows + [rows[2], (None, base[0], 1, "en")]


def brute_components(rows, percent):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(ids, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return sets, {i: find(i) for i in ids}


@pytest.mark.parametrize("chunk", [1 << 22, 200])
def test_jaccard_components(spark, chunk):
    rows = near_corpus()
    sets, root = brute_components(rows, 90)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = bitmap_join.jaccard_components(docs, chunk_shingles=chunk).collect()
    assert len(got) == len(rows)
    assert len({r.component_id for r in got if r.doc_id is not None}) < len(root)  # links were found
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root.get(r.doc_id))


def test_jaccard_components_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert bitmap_join.jaccard_components(empty).count() == 0


def test_a_tile_needs_little_more_memory_than_its_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(1, 1 << 62, 300 + i % 20)) for i in range(3000)]
    for i in range(0, 3000, 3):  # linked with the one before: 290 of its elements and up to 10 others
        sets[i] = np.unique(np.concatenate((sets[i - 1][:290], rng.integers(1, 1 << 62, 5))))
    n = len(sets)
    sizes = np.array([len(x) for x in sets])
    tile = pa.table({
        "doc_id": np.arange(n), "k1": np.arange(n), "k2": np.arange(n), "x": np.zeros(n, int), "y": np.zeros(n, int),
        "side": np.zeros(n, int), "band": bitmap_join.band_of(sizes, 90),
        "shingles": pa.array([x.tolist() for x in sets], pa.list_(pa.int64())),
    })
    tracemalloc.start()
    found = bitmap_join._tile_links(90)(tile)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = set()
    for i in range(n):
        both = np.intersect1d(sets[i], sets[i - 1]).size
        if 100 * both >= 90 * (sizes[i] + sizes[i - 1] - both):
            want.add((min(i, (i - 1) % n), max(i, (i - 1) % n)))
    pairs = zip(found["a"].to_pylist(), found["b"].to_pylist())
    assert {(min(p), max(p)) for p in pairs} == want and len(want) == 900
    assert peak < 20 << 20


def test_bands_bound_the_size_ratio():
    edges = bitmap_join.bands(90, 10**6)
    sizes = list(range(1, 3000))
    band = dict(zip(sizes, bitmap_join.band_of(__import__("numpy").array(sizes), 90)))
    for a in sizes[::7]:
        for b in sizes[::5]:
            if a <= b and 100 * a >= 90 * b:
                assert band[b] - band[a] <= 1
    assert all(bitmap_join.bitmap_words(s) * 64 >= 2 * s for s in (1, 2, 63, 64, 65, 1000, 10**6))


def brute_phrases(rows, shortest, longest, least, top):
    f, n = Counter(), Counter()
    for _, text, _, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, " ".join(w[i : i + k])] += 1
    out = []
    for (lang, p), a in f.items():
        w = p.split(" ")
        if not (shortest <= len(w) <= longest and a >= least):
            continue
        if any(len(q.split(" ")) == len(w) + 1 and b >= a and (q.split(" ")[1:] == w or q.split(" ")[:-1] == w)
               for (g, q), b in f.items() if g == lang):
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, " ".join(w[:k])], f[lang, " ".join(w[k:])]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, p, a, l, r, n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(o[0], i + 1, *o[1:]) for i, o in enumerate(mine[:top])]
    return sorted(ranked)


def test_phrase_graph(spark):
    from ticketlens.llm import phrase_graph

    rng = random.Random(3)
    words = ["ab", "Cd", "ef", "gh", "ij", "é", "x\ty"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
        text = text.replace(" gh ", ". gh ").replace(" ij ", "\nij ")
        rows.append((i, text, 0, rng.choice(["en", None, "fr"])))
    rows += [(60, None, 0, "en"), (61, "ab cd ef gh ij " * 30, 0, "en"), rows[5], (62, "x" * 100000, 0, None)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in phrase_graph.collocations(docs, 2, 5, 3, 7).collect())
    assert got == brute_phrases(rows, 2, 5, 3, 7)
    assert phrase_graph.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs, items, k):
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t, *_ in docs]
    big_n, big_l = sum(1 for t in terms if t), sum(len(t) for t in terms)
    df = Counter(x for t in terms for x in set(t))
    out = []
    queries = {}
    for item, text in items:
        queries.setdefault(item, set()).update(TERM.findall((text or "").translate(LOWER)))
    for item, q in queries.items():
        scored = []
        for (doc, *_), t in zip(docs, terms):
            tf, n = Counter(t), len(t)
            if not n:
                continue
            m = 50 + (50 * n * big_n) // big_l
            s = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 20 * m))
                    for x in q if tf[x])
            if s > 0:
                scored.append((s, doc))
        scored.sort(key=lambda p: (-p[0], float("inf") if p[1] is None else p[1]))
        out += [(item, i + 1, d, s) for i, (s, d) in enumerate(scored[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard_rows,leaf", [(20000, 32), (7, 2)])
def test_ball_search_equals_brute_force(spark, shard_rows, leaf):
    from ticketlens.llm import ball_search

    rng = random.Random(11)
    words = ["Alpha", "beta", "gamma", "délta", "e1", "zz", "x_y", "naïve", "42"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), 0, "en") for i in range(80)]
    rows += [(80, None, 0, "en"), (81, "", 0, "en"), (82, "beta " * 5000, 0, "en"), rows[4], (None, "gamma beta", 0, "en")]
    rows += [(83 + i, "alpha beta gamma", 0, "en") for i in range(6)]  # ties
    items = [(1, "alpha beta"), (2, "Gamma, naïve!"), (3, None), (4, "zz"), (5, "unknown words"), (2, "e1")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ball_search.rank(docs, bench, k=5, shard_rows=shard_rows, leaf_size=leaf).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_search(rows, items, 5)


def test_ball_tree_bounds_hold():
    import numpy as np
    from ticketlens.llm import ball_search

    rng = np.random.default_rng(5)
    dense = rng.integers(0, 4, (300, 12)) * rng.integers(1, 10**9, (1, 12)) * (rng.random((300, 12)) < 0.3)
    indptr = np.concatenate(([0], np.cumsum((dense != 0).sum(1))))
    indices, values = np.nonzero(dense)[1], dense[dense != 0]
    tree = ball_search.BallTree(indptr, indices, values.astype(np.int64), 12, 4)
    ids = np.arange(300, dtype=float)
    for q in ([0], [1, 2, 3], list(range(12))):
        want = sorted(((int(dense[i, q].sum()), -i) for i in range(300) if dense[i, q].sum() > 0), reverse=True)[:10]
        got = sorted(((s, int(i)) for s, i, _ in tree.search(np.array(q), ids, 10)), reverse=True)
        assert got == [(s, i) for s, i in want]


def test_ball_search_keeps_64_bit_ids(spark):
    from ticketlens.llm import ball_search

    big = 2**62 + 1  # neighbours that one double stands for
    rows = [(big + i, "alpha beta", 0, "en") for i in range(40)] + [(None, "alpha beta", 0, "en")]
    rows += [(i, "other", 0, "en") for i in range(60)]
    items = [(big, "alpha"), (big + 1, "beta alpha")]
    docs = spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for k in (5, 41):
        got = ball_search.rank(docs, bench, k=k, shard_rows=30, leaf_size=4).collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_search(rows, items, k)


def test_ball_tree_of_outliers_stays_shallow():
    import numpy as np
    from ticketlens.llm import ball_search

    n = 3000  # no two vectors share a term: far pivots would peel them off one by one
    values = np.arange(1, n + 1, dtype=np.int64)
    tree = ball_search.BallTree(np.arange(n + 1), np.arange(n), values, n, 1000)
    place = np.arange(n)
    assert [(s, int(r)) for s, _, r in tree.search(np.array([7, 2000]), place, 1)] == [(2001, 2000)]
    deep = ball_search.BallTree(np.arange(n + 1), np.arange(n), values, n, 2)
    assert sorted(s for s, _, _ in deep.search(np.arange(n), place, 3)) == [n - 2, n - 1, n]


def test_phrase_graph_prunes_what_cannot_be_frequent(spark):
    from ticketlens.llm import phrase_graph

    rng = np.random.default_rng(4)
    texts = [
        " ".join(f"{'Rare' if w % 2 else 'w'}{rng.integers(4000) if w % 2 else w % 7}" for w in rng.integers(0, 30, 60))
        + ". A  steady\tphrase of Five words, É" for _ in range(80)
    ]
    docs = spark.createDataFrame(
        [(i, t, [None, "en", "fr"][i % 3]) for i, t in enumerate(texts)] + [(900, None, "en"), (901, "", None)],
        "doc_id long, text string, lang string",
    ).repartition(3)
    whole = {tuple(r) for r in phrase_graph.phrase_counts(docs, 5, 1).collect()}
    pruned = {tuple(r) for r in phrase_graph.phrase_counts(docs, 5, 20).collect()}
    assert pruned == {r for r in whole if r[1] == 0 or r[3] >= 20}
    assert ("en", 5, "a steady phrase of five", 27) in pruned and ("en", 1, "É", 27) in pruned
    longer = lambda least: phrase_graph._records(docs, 5, least).filter("gram LIKE '% %'").distinct().count()
    assert longer(20) < 0.2 * longer(1)


def test_bitmap_join_sends_whole_sets_only_where_they_may_link(spark, monkeypatch):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    texts = [text(rng.randint(30, 90)) for _ in range(120)]
    near = text(60)
    texts += [near, near + " end", near.upper()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, real = [], bitmap_join.save
    monkeypatch.setattr(bitmap_join, "save", lambda df, label: seen.append((label, out := real(df, label))) or out)
    got = {r["doc_id"]: r["component_id"] for r in bitmap_join.jaccard_components(docs, chunk_shingles=900).collect()}
    assert got == {i: 120 if i >= 120 else i for i in range(123)}
    marked = dict(seen)["jaccard-marked"]
    assert 2 <= marked.select("k1", "k2").distinct().count() <= 6  # of 122 sets


def test_bitmaps_fold_to_narrower_ones():
    values = np.random.default_rng(5).integers(0, 1 << 63, 300, np.uint64)
    packed = bitmap_join.packed_bitmaps(values, np.array([0, 300]), bitmap_join.band_of(np.array([300]), 90), 90)
    wide = packed.values.to_numpy().view(np.uint64)[None, :]
    assert wide.shape[1] >= bitmap_join.bitmap_words(300)
    assert (bitmap_join.folded(wide, 2) == bitmap_join._bitmaps([values], 2)).all()
