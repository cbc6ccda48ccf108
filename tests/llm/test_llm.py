"""The corpus operators against brute force on small tables with nulls, ties, repeats and names
that clash with results."""

import hashlib
import inspect
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from ticketlens.llm import (  # noqa: E402
    bounded_packing, circulant_minhash, decontaminate, gru, induced_dedup, line_quality, line_runs,
    preferences, pseudonyms, pu_toxicity, recurrent_lm, suffix_arrays,
)

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = sentence(40)
    texts = ["\n".join(sentence(rng.randint(1, 30)) for _ in range(rng.randint(1, 8))) for _ in range(24)]
    texts += [texts[0], texts[1] + " end", passage, "x\n" + passage + "\ny", texts[2] + "\n" + passage]
    texts += [None, "", " \n\t", "Word", "aaaa" * 200, "\n".join([sentence(25)] * 5), "é" * 300]
    rows = [(i, t, i % 3, None if i % 7 == 0 else f"h{i % 2}") for i, t in enumerate(texts)]
    return rows + [rows[3], rows[26], (None, texts[4], 1, "h0")]


SCHEMA = "doc_id bigint, text string, kept int, source string"  # kept clashes with results


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_bytes(rows, length):
    first, out = set(), []
    distinct = sorted({(-1 << 63 if r[0] is None else r[0], r[1] or "") for r in rows})
    for key, text in distinct:
        data = text.encode()
        gone = bytearray(len(data))
        for s in range(len(data) - length + 1):
            if data[s : s + length] in first:
                gone[s : s + length] = b"\1" * length
            first.add(data[s : s + length])
        out.append((key, data, bytes(b for b, g in zip(data, gone) if not g)))
    return {(k, d): left for k, d, left in out}


@pytest.mark.parametrize("limit", [8192, 1])
def test_repeated_bytes(docs, empty, limit):
    want = brute_bytes(corpus(), 40)
    got = induced_dedup.remove_repeats(docs, length=40, group_limit=limit).collect()
    assert len(got) == len(corpus())
    texts = {(r[0], len((r[1] or "").encode())): r[1] for r in corpus()}
    for r in got:
        data = (texts[r.doc_id, r.n_bytes] or "").encode()
        assert bytes(r.kept) == want[-1 << 63 if r.doc_id is None else r.doc_id, data]
        assert len(r.kept) == r.n_bytes - sum(s.stop - s.start for s in r.spans)
    assert induced_dedup.remove_repeats(empty).count() == 0


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(60):
        letters = b"abcde"[: rng.choice((1, 2, 5))]
        pieces = [bytes(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 6))]
        text, _ = suffix_arrays.shard_of(pieces)
        data, order = text.tobytes(), suffix_arrays.suffix_array(text)
        assert list(order) == sorted(range(len(data)), key=lambda i: data[i:])
        shared = suffix_arrays.permuted_common_prefixes(text, order)
        for i, j in zip(order[1:], order):
            n = 0
            while max(i, j) + n < len(data) and data[i + n] == data[j + n] > 1:
                n += 1
            assert shared[i] == n


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t, *_ in corpus():
        w = (t or "").translate(LOWER)
        w = WORD.findall(w)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets if i is not None}
    for _ in root:
        for a, b in itertools.combinations(root, 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = circulant_minhash.near_duplicates(docs, width=3, percent=85).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), root.get(r.doc_id))
        assert r.kept == (r.doc_id is None or root[r.doc_id] == r.doc_id)
    assert circulant_minhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("stars", [1, 3])
def test_near_duplicates_inside_a_group_of_copies(spark, stars):
    rng = random.Random(stars)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(90)]

    def edited(text, n):
        out = list(text)
        for _ in range(n):
            out[rng.randrange(len(out))] = rng.choice(words)
        return out

    texts = [edited(base, rng.choice([2, 4, 6])) for _ in range(120)]
    texts += [edited(rng.choice(texts), rng.choice([1, 2, 3])) for _ in range(60)]
    texts += [t[rng.randrange(12):] for t in texts[:30]]
    rng.shuffle(texts)
    sets = [{tuple(t[k : k + 3]) for k in range(len(t) - 2)} for t in texts]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(range(len(sets)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    want = {i: top(i) for i in range(len(sets))}
    assert 5 < len(set(want.values())) < len(sets) - 20
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = circulant_minhash.near_duplicates(df, width=3, percent=85, bands=30, stars=stars)
    assert {r.doc_id: r.component_id for r in got.collect()} == want


def test_near_duplicates_of_an_edited_centre_do_not_all_meet(spark, monkeypatch):
    """Every text has its own deviation from one that is absent: what the centre's deviation
    makes the others share must not bring them together pair by pair."""
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(18):
        text = list(base)
        text[3 * i + 2] = f"own{i}"
        texts.append((i, " ".join(text)))
    met, meetings = [], circulant_minhash._meetings

    def counted(*args):
        out = meetings(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(circulant_minhash, "_meetings", counted)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = circulant_minhash.near_duplicates(df, width=3, percent=85, bands=30, stars=1).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(18)}
    assert met == [0]  # 136 pairs share one of the absent text's shingles or more


def test_near_duplicates_go_to_the_last_round_when_few_pairs_link(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(18):  # 18 texts that share bands and do not link
        text = list(base)
        text[3 * i + 2] = f"own{i}"
        texts.append((i, " ".join(text)))
    tried, confirm = [], circulant_minhash._confirm
    monkeypatch.setattr(circulant_minhash, "_confirm", lambda *a: tried.append(a[0].count()) or confirm(*a))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = circulant_minhash.near_duplicates(df, width=3, percent=85, bands=30, stars=3).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: i for i in range(18)}
    assert len(tried) == 1 and tried[0] > 0  # the last round leaves no pair to compare


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d", "a b c d e f", ""])
def test_shingles_of_one_text_alone(text):
    """A slice may hold one short text only: its set is what it is among others."""
    alone = list(circulant_minhash.shingle_sets(pa.array([text]), 5))
    among = list(circulant_minhash.shingle_sets(pa.array([text, "v w x y z " * 3]), 5))
    assert len(alone) == 1 and np.array_equal(alone[0], among[0])
    assert len(alone[0]) == max(len(text.split()) - 4, min(1, len(text)))


def test_near_duplicates_of_one_short_text_in_a_task(spark):
    df = spark.createDataFrame([(7, "two words")], "doc_id bigint, text string").coalesce(1)
    got = circulant_minhash.near_duplicates(df).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got] == [(7, 1, 7, True)]


def test_exploded_rows_carry_no_whole_text_or_array(spark, tmp_path, monkeypatch):
    """A text of n lines, or n differences, must not be copied n times."""
    carried = []

    def generates(plan):
        if plan.getClass().getSimpleName() == "Generate":
            out = plan.requiredChildOutput()
            carried.append([out.apply(i).dataType().simpleString() for i in range(out.size())])
        for i in range(plan.children().size()):
            generates(plan.children().apply(i))

    def seen(df, label, save=circulant_minhash.save):
        if label in ("lines", "minhash-prefixes"):
            generates(df._jdf.queryExecution().optimizedPlan())
        return save(df, label)

    monkeypatch.setattr(line_runs, "save", seen)
    monkeypatch.setattr(circulant_minhash, "save", seen)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:3 * i + 2] + [f"own{i}"] + base[3 * i + 3 :]) for i in range(18)]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id bigint, text string")
    assert line_runs.drop_repeated_runs(df).count() == 18
    assert circulant_minhash.near_duplicates(df, width=3, percent=85, bands=30, stars=1).count() == 18
    assert len(carried) >= 3
    assert not any(kind == "string" or kind.startswith("array") for row in carried for kind in row)


def test_circulant_signature_estimates_overlap():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 1 << 63, 1200).astype(np.uint64)
    a, b = (circulant_minhash.signature(np.unique(s), 512, 1) for s in (pool[:1000], pool[200:]))
    assert abs((a == b).mean() - 800 / 1200) < 0.08


def test_line_runs(docs, empty):
    rows = sorted({((r[0] is not None, r[0] or 0), r[1] or "", r[0]) for r in corpus()})
    gone, length = {(r[2], r[1]): set() for r in rows}, 1
    while length <= 16:
        seen = set()
        for _, text, key in rows:
            lines = text.split("\n")
            for p in range(len(lines) - length + 1):
                run = tuple(lines[p : p + length])
                if sum(len(WORD.findall(x)) for x in run) >= 10:
                    if run in seen:
                        gone[key, text].update(range(p, p + length))
                    seen.add(run)
        length *= 2
    texts = {r[0]: r[1] for r in corpus()}
    got = line_runs.drop_repeated_runs(docs, min_words=10).collect()
    assert len(got) == len(corpus()) and got[0].asDict().keys() >= {"kept", "source"}
    for r in got:
        text = texts[r.doc_id]
        cut = gone[r.doc_id, text or ""]
        assert r.n_deleted == len(cut)
        want = None if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in cut)
        assert r.text == want
    assert line_runs.drop_repeated_runs(empty).count() == 0


def test_line_runs_of_every_length(spark, empty):
    rng = random.Random(11)
    line = lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([0, 0, 1, 2, 3, 5])))
    stock = [line() for _ in range(40)]
    rows = []
    for i in range(30):
        text = [line() + f" own{i}" for _ in range(3)]
        for _ in range(2):
            at = rng.randrange(30)
            text += stock[at : at + rng.choice([2, 3, 5, 6, 7, 9])] + [f"end{i}"]
        rows.append((None if i == 0 else i, "\n".join(text)))
    rows += [(rows[3][0], rows[3][1]), (40, None), (41, "")]
    distinct = sorted({((k is not None, k or 0), t or "", k) for k, t in rows})
    gone, seen = {(k, t): set() for _, t, k in distinct}, set()
    for _, text, key in distinct:
        lines = text.split("\n")
        for p in range(len(lines)):
            for stop in range(p + 1, len(lines) + 1):
                run = tuple(lines[p:stop])
                if sum(len(WORD.findall(x)) for x in run) >= 10:
                    if run in seen:
                        gone[key, text].update(range(p, stop))
                    seen.add(run)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    for every in (True, False):
        got = line_runs.drop_repeated_runs(df, min_words=10, every_length=every).collect()
        left = {(r.doc_id, r.text): r.n_deleted for r in got}
        want = {}
        for key, text in rows:
            cut = gone[key, text or ""]
            kept = "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in cut)
            want[key, None if text is None else kept] = len(cut)
        assert (left == want) == every  # lengths of 1, 2, 4 ... lines alone leave some
    assert line_runs.drop_repeated_runs(empty, every_length=True).count() == 0


def test_quality(docs, empty):
    got = line_quality.judge(docs, min_words=5, min_docs=2, max_share=0.01).collect()
    assert len(got) == len(corpus())
    texts = {r[0]: r[1] or "" for r in corpus()}
    for r in got:
        words = WORD.findall(texts[r.doc_id])
        three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        often = Counter(three)
        covered = {i + k for i, t in enumerate(three) if often[t] > 1 for k in range(3)}
        assert (r.n_words, r.n_repeat_words) == (len(words), len(covered))
        assert r.base_failed == (len(words) < 5 or 2 * len(covered) > len(words))
    assert any(r.lost_words for r in got) and line_quality.judge(empty).count() == 0


def test_decontamination(spark, docs, empty):
    source = next(t for _, t, *_ in corpus() if t and len(t.split()) > 30).split()
    items = [(1, " ".join(source[3:20])), (2, source[0]), (3, None), (4, "!!"), (None, "x"), (1, " ".join(source[3:20]))]
    items = spark.createDataFrame(items, "item_id bigint, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    patterns = {}
    for i, t in ((1, " ".join(source[3:20])), (2, source[0])):
        w = word.findall(t.translate(LOWER))
        for k in range(len(w) - min(10, len(w)) + 1):
            patterns.setdefault(tuple(w[k : k + min(10, len(w))]), set()).add(str(i))
    texts = {r[0]: r[1] or "" for r in corpus()}
    for block in (1 << 20, 1):
        got = decontaminate.find_leaks(docs, items, block_words=block).collect()
        assert len(got) == len(corpus()) and any(r.contaminated for r in got)
        for r in got:
            w, hit, owners = word.findall(texts[r.doc_id].translate(LOWER)), set(), set()
            for p, o in patterns.items():
                for k in range(len(w) - len(p) + 1):
                    if tuple(w[k : k + len(p)]) == p:
                        hit.update(range(k, k + len(p)))
                        owners |= o
            assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(owners))
            raw = texts[r.doc_id].encode()
            inside = " ".join(raw[s.start : s.stop].decode() for s in r.spans)
            assert len(word.findall(inside.translate(LOWER))) == len(hit)
    assert decontaminate.find_leaks(empty, items).count() == 0
    assert decontaminate.find_leaks(docs, items.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns


def test_packing_is_gapless_and_unpadded(docs, empty):
    from tokenizers import Tokenizer

    tokens = Tokenizer.from_file(VOCAB)
    tokens.encode_special_tokens = True
    want = Counter()
    for key, text, *_ in corpus():
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [0]
        want[key, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = bounded_packing.pack(docs, VOCAB, size=64, open_windows=2).collect()
    assert sum(r.length for r in got) == sum(n * c for (_, n, _), c in want.items())
    assert sum(r.start == 0 for r in got) == len(corpus())
    for _, group in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 64 and at & (at - 1) == 0
    assert bounded_packing.pack(empty, VOCAB).count() == 0


@pytest.mark.parametrize("text", ["a  b", "a   b", " x", "<|endoftext|> hi", "\n a\n \nb", "x \n", "it's", "a\xa0 b",
                                  "œuf été", "漢字 テスト", "a\x1c b", "\r\n  foo", "12 34², ½ x", "", "a <|endoftext|>"])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(VOCAB)
    whole.encode_special_tokens = True
    got = next(iter(bounded_packing.Encoder(VOCAB).encode([text])))
    assert np.frombuffer(got, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pseudonyms(spark, empty):
    text = ("card 4111 1111 1111 1111, 4111-1111-1111-1112, 2020-02-29 2020-02-30 31/12/1999, "
            "10.0.0.1 999.1.1.1, +1 (555) 234-5678, some.one99@example.org")
    rows = [(1, text, 5, "a"), (2, "again 4111 1111 1111 1111 here", 5, "b"), (3, None, 5, None), (4, "", 5, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_pseudonyms int, other string")
    got = {r.doc_id: r for r in pseudonyms.pseudonymise(docs, "k").collect()}
    assert [got[i].n_pseudonyms for i in (1, 2, 3, 4)] == [6, 1, 0, 0]
    assert got[3].text is None and got[4].text == ""
    new = re.search(r"card ((?:\d{4} ){3}\d{4})", got[1].text)[1]
    assert new != "4111 1111 1111 1111" and new in got[2].text  # linked
    digits = [int(d) for d in new.replace(" ", "")][::-1]
    assert sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0
    for same in ("4111-1111-1111-1112", "2020-02-30", "999.1.1.1", "@example.org"):
        assert same in got[1].text
    assert "some.one99" not in got[1].text
    numbers = spark.range(27 * 11).selectExpr("id div 11 AS l", "id % 11 AS r")
    from pyspark.sql import functions as F

    pairs = numbers.select(pseudonyms.permute("t", "k", F.col("l"), F.col("r"), 27, 11).alias("p")).collect()
    assert len({(p.p.l, p.p.r) for p in pairs}) == 27 * 11  # one to one
    assert pseudonyms.pseudonymise(empty, "k").count() == 0


def test_preferences(spark):
    turns = [
        (1, "chosen", 0, "user", "q"), (1, "rejected", 0, "user", "q"), (1, "chosen", 1, "assistant", "good"),
        (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "?"),
        (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", None), (3, "chosen", None, None, "x"),
        (None, "chosen", 0, "user", "lost"), (4, "chosen", 0, "a", "same"), (4, "chosen", 0, "a", "same"),
    ]
    frame = spark.createDataFrame(turns, "pair_id int, side string, turn int, role string, text string")
    got = {r.pair_id: r for r in preferences.preference_records(frame).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].usable
    s = got[1].chosen_spans[0]
    assert got[1].chosen[s.start : s.stop] == "good<|end|>\n" and len(got[1].rejected_spans) == 1
    assert got[2].n_prompt_turns == 1 and got[2].chosen == "" and not got[2].usable
    assert got[4].chosen.count("same") == 2 and got[4].rejected == ""
    assert preferences.preference_records(frame.limit(0)).count() == 0


def test_toxicity_learns_from_positives_and_unlabelled(spark, empty):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        text = [rng.choice(words) for _ in range(40)] + (["vile", "nasty"] * 2 if toxic else [])
        rows.append((i, " ".join(text), 0, "s"))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    rows += [(None, None, 0, "s"), (1, rows[1][1], 0, "s"), (900, "", 0, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame(labels + [(None, 1), (2, None)], "doc_id bigint, toxic int")
    model = pu_toxicity.train(docs, labels)
    got = pu_toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    right = [(r.score >= 0.5) == (r.doc_id % 6 == 0) for r in got
             if r.doc_id is not None and r.doc_id < 600 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum(right) > 0.95 * len(right)
    assert pu_toxicity.score(empty, pu_toxicity.train(empty, labels.limit(0))).count() == 0


def test_language_model(spark, docs, empty):
    model, counts = recurrent_lm.learn(docs, hot_words=10, vocabulary=5)
    got = recurrent_lm.score(docs, model, counts).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    tokens = lambda t: (t or "").translate(LOWER)
    train = [WORD.findall(tokens(r[1])) for r in corpus() if not held(r[0])]
    seen = Counter(w for t in train for w in t)
    total, kinds = sum(seen.values()) + len(train), len(seen) + 1
    texts = {r[0]: WORD.findall(tokens(r[1])) for r in corpus()}
    assert len(got) == len(corpus())
    for r in got:
        own = texts[r.doc_id]
        base = sum(np.log10(seen[w] + 0.5) for w in own) + np.log10(len(train) + 0.5)
        base -= (len(own) + 1) * np.log10(total + 0.5 * (kinds + 1))
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(r.doc_id), len(own) + 1, total)
        assert r.n_known == sum(seen[w] > 0 for w in own) + 1
        assert abs(r.base_score - base) < 1e-6 * abs(base) and r.score < 0
    nothing = recurrent_lm.learn(empty)
    assert recurrent_lm.score(empty, *nothing).count() == 0
    assert recurrent_lm.score(docs, *nothing).filter("train_tokens = 0").count() == len(corpus())


def test_words_are_read_as_python_splits_them():
    """Many at a time, and most of a corpus' word occurrences are symbols of their own."""
    texts = ["", " a\t\nB. b,  ", "ÄÖ. ñ É\x0bx", None, "中文, 中文,"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["t"])
    pools = list(recurrent_lm._pools([batch]))
    assert sum(len(raw) for _, raw in pools) == len(texts)
    lexicon = {b"a": (5, 9, -1), b"b.": (6, 4, 1)}
    forms = list(range(20, 32))
    codes, owner, words = recurrent_lm.encoded(pools[0][1])
    look = recurrent_lm.Lexicon(lexicon, forms)
    symbols = look.symbols(look.places(words), recurrent_lm.forms_of(words))
    got = recurrent_lm.with_ends(symbols[codes], owner, len(texts), 0)
    want = [
        [lexicon[w][0] if w in lexicon else forms[recurrent_lm.form(w)] for w in (t or "").encode().lower().split()] + [0]
        for t in texts
    ]
    assert [g.tolist() for g in got] == want
    assert inspect.signature(recurrent_lm.learn).parameters["vocabulary"].default >= 1500  # 371 before


def test_network_gives_probabilities_and_right_gradients():
    counts = np.arange(40, 0, -1).astype(float)
    net = {k: v.astype(np.float64) for k, v in gru.new_model(counts).items()}
    one = gru.log_likelihoods(net, [np.array([3, s]) for s in range(40)], 0)
    first = gru.log_likelihoods(net, [np.array([3])], 0)
    assert abs(np.exp(one - first).sum() - 1) < 1e-4
    texts = [np.array([1, 2, 3, 0]), np.array([5, 0])]

    def loss(model):
        inputs, targets, _, fresh, live = next(gru.windows(texts, 2, 0))
        _, states, saved = gru.run_window(model, np.zeros((live, gru.HIDDEN)), inputs, fresh, True)
        mask = targets.ravel() >= 0
        grads = {k: np.zeros_like(v) for k, v in model.items()}
        logp, down = gru.read_out(model, states.reshape(-1, gru.HIDDEN)[mask], targets.ravel()[mask], grads)
        whole = np.zeros((targets.size, gru.HIDDEN))
        whole[mask] = down
        gru.backward(model, grads, saved, inputs, fresh, whole.reshape(*targets.shape, gru.HIDDEN))
        return -logp.mean(), grads

    _, grads = loss(net)
    for k in gru.NAMES:
        at = np.unravel_index(np.argmax(np.abs(grads[k])), grads[k].shape)
        sides = []
        for step in (1e-3, -1e-3):
            moved = {n: v.copy() for n, v in net.items()}
            moved[k][at] += step
            sides.append(loss(moved)[0])
        assert abs((sides[0] - sides[1]) / 2e-3 - grads[k][at]) < 1e-3
    trained = gru.train(gru.new_model(counts), [np.array([7, 0])] * 300, 0)
    assert gru.log_likelihoods(trained, [np.array([7, 0])], 0)[0] > gru.log_likelihoods(net, [np.array([7, 0])], 0)[0]


def test_pipeline_stages_keep_columns_and_clean_documents(spark, docs):
    import corpus_pipeline as pipeline

    labels_free = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", "kept", "source")
    cut = pipeline.line_dedup(spark, labels_free, "")
    assert cut.columns == labels_free.columns and cut.count() >= 20
    left = pipeline.near_duplicates(spark, labels_free, "")
    assert left.columns == labels_free.columns
    ids = {r.doc_id for r in left.collect()}
    assert 0 in ids and 24 not in ids and {29, 30, 31} <= ids  # a copy goes, empty texts stay
    assert pipeline.packing(spark, left, "").count() >= left.count()
    assert [n for n, _ in pipeline.STAGES] == [
        "toxicity", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_digest_of_removed_bytes_is_stable(docs):
    one, two = (sorted(hashlib.sha256(bytes(r.kept)).hexdigest() for r in induced_dedup.remove_repeats(d).collect())
                for d in (docs, docs.repartition(5)))
    assert one == two


def test_recurrent_lm_holds_narrow_numbers():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from ticketlens.llm import gru, recurrent_lm

    texts = pa.array([" ".join(f"w{i % 50}" for i in range(2000))] * 60)
    codes, owner, words = recurrent_lm.encoded(texts)
    lexicon = recurrent_lm.Lexicon({w: (i, 5, -1) for i, w in enumerate(words.to_pylist())}, [60 + f for f in range(12)])
    symbols = lexicon.symbols(lexicon.places(words), recurrent_lm.forms_of(words))[codes]
    assert owner.itemsize == symbols.itemsize == 4
    parts = recurrent_lm.with_ends(symbols, owner, 60, 59)
    assert [len(p) for p in parts] == [2001] * 60
    del codes, owner, symbols
    tracemalloc.start()
    for _ in gru.windows(parts, 8, 59):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * 60 * 2001  # a symbol and an owner of 4 bytes each, and a window
