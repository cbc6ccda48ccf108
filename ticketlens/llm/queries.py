"""The operators over the given tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import (
    ball_search, bitmap_join, bounded_packing, circulant_minhash, decontaminate, induced_dedup, line_quality, line_runs, phrase_graph,
    preferences, pseudonyms, pu_toxicity, recurrent_lm,
)
from ticketlens.llm.common import table


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = preferences.swapped_replies(table(spark, sf_dir, "conversations"))

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["start"], s["stop"])), ";")

    return preferences.preference_records(turns).withColumns(
        {c: text(F.col(c)) for c in ("chosen_spans", "rejected_spans")}
    )


def op2_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.drop_repeated_runs(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_lines", "n_deleted", "n_runs", F.sha2("text", 256).alias("kept_sha256")
    )


def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, key="key of the registered query")


def op4_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, counts = recurrent_lm.learn(docs)
    return recurrent_lm.score(docs, model, counts)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.judge(table(spark, sf_dir, "documents"))


def op7_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = pu_toxicity.train(docs, table(spark, sf_dir, "labels"))
    return pu_toxicity.score(docs, model).select(
        "doc_id", pu_toxicity.held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant_minhash.near_duplicates(
        table(spark, sf_dir, "documents"), width=3, percent=85, bands=30, rows=6
    )


def op9_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_induced_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = induced_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["stop"] - s["start"])
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op13_bitmap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitmap_join.jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_ball_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_phrase_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_graph.collocations(
        table(spark, sf_dir, "documents"), shortest=2, longest=5, min_count=100, top=2000
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_preferences, op2_line_runs, op3_pseudonyms, op4_recurrent_lm, op5_decontaminate,
        op6_line_quality, op7_pu_toxicity, op8_circulant_minhash, op9_bounded_packing,
        op10_induced_dedup, op11_ball_search, op12_phrase_graph, op13_bitmap_join,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

ORACLES = {
    "op1_preferences": """
WITH reply AS (
  SELECT conv_id, max(turn) AS reply_at, arg_max(text, turn) AS reply
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id
), pair AS (
  SELECT r.conv_id, r.reply_at, o.reply AS other,
    CASE WHEN r.reply <> o.reply THEN r.reply_at ELSE 1000000 END AS fork
  FROM reply r JOIN reply o ON o.conv_id = xor(r.conv_id, 1)
), shown AS (
  SELECT c.conv_id, c.turn, p.fork, c.role = 'assistant' AS learned,
    '<|' || c.role || '|>' || chr(10) AS head, c.text AS chosen_text,
    CASE WHEN c.turn = p.reply_at THEN p.other ELSE c.text END AS rejected_text
  FROM conversations c JOIN pair p USING (conv_id)
), sides AS (
  SELECT conv_id, turn, fork, learned, side, head || t || '<|end|>' || chr(10) AS shown, length(head) AS lead
  FROM (SELECT *, 'chosen' AS side, chosen_text AS t FROM shown
        UNION ALL SELECT *, 'rejected', rejected_text FROM shown)
), placed AS (
  SELECT *, coalesce(sum(length(shown)) FILTER (turn >= fork) OVER (
    PARTITION BY conv_id, side ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM sides
)
SELECT conv_id AS pair_id,
  coalesce(string_agg(shown, '' ORDER BY turn) FILTER (turn < fork AND side = 'chosen'), '') AS prompt,
  count(*) FILTER (turn < fork AND side = 'chosen') AS n_prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY turn) FILTER (turn >= fork AND side = 'chosen'), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY turn) FILTER (turn >= fork AND side = 'rejected'), '') AS rejected,
  coalesce(string_agg(CAST(begins + lead AS BIGINT) || ':' || CAST(begins + length(shown) AS BIGINT), ';' ORDER BY turn)
    FILTER (turn >= fork AND side = 'chosen' AND learned), '') AS chosen_spans,
  coalesce(string_agg(CAST(begins + lead AS BIGINT) || ':' || CAST(begins + length(shown) AS BIGINT), ';' ORDER BY turn)
    FILTER (turn >= fork AND side = 'rejected' AND learned), '') AS rejected_spans,
  count(*) FILTER (turn >= fork AND learned) > 0 AS usable
FROM placed GROUP BY conv_id""",
    "op2_line_runs": rf"""
WITH d AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
runs AS (
  SELECT doc_id, k, unnest(range(len(l) - k + 1)) AS p, l
  FROM d, (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024]) AS k) WHERE len(l) >= k
), shown AS (
  SELECT doc_id, k, p, array_to_string(list_slice(l, p + 1, p + k), chr(10)) AS t FROM runs
), again AS (
  SELECT doc_id, k, p FROM (
    SELECT doc_id, k, p, len({_WORDS.format("t")}) AS w,
      row_number() OVER (PARTITION BY k, t ORDER BY doc_id, p) AS nth FROM shown
  ) WHERE nth > 1 AND w >= 20
), gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS i FROM again),
stretch AS (SELECT doc_id, count(*) AS n, count(DISTINCT g) AS runs FROM (
  SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM gone) GROUP BY doc_id),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') AS t FROM (
    SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d
  ) ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(l) END AS n_lines,
  coalesce(s.n, 0) AS n_deleted, coalesce(s.runs, 0) AS n_runs,
  CASE WHEN text IS NOT NULL THEN sha256(coalesce(k.t, '')) END AS kept_sha256
FROM d LEFT JOIN stretch s USING (doc_id) LEFT JOIN kept k USING (doc_id)""",
    "op5_decontaminate": rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), pattern AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t FROM (
    SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS i
    FROM item WHERE len(w) > 0)
), doc AS (
  SELECT doc_id, regexp_extract_all({_FOLD}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), hit AS (
  SELECT doc_id, i, n, item_id FROM (
    SELECT doc_id, n, i, array_to_string(list_slice(w, i + 1, i + n), ' ') AS t FROM (
      SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
      FROM doc, (SELECT DISTINCT n FROM pattern) WHERE len(w) >= n)
  ) JOIN pattern USING (n, t)
), words AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS all_items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(all_items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op6_line_quality": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w FROM documents
), lines AS (
  SELECT doc_id, source, line, CAST(len({_WORDS.format("line")}) AS BIGINT) AS n,
    trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS same
  FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS line FROM d)
), worded AS (SELECT * FROM lines WHERE n > 0),
repeats AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup FROM worded GROUP BY doc_id),
windows AS (
  SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS t
  FROM (SELECT doc_id, w, unnest(range(len(w) - 2)) AS i FROM d WHERE len(w) > 2)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n_rep FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS n FROM windows) WHERE n > 1
  ) GROUP BY doc_id
), common AS (
  SELECT c.source, c.same FROM (
    SELECT source, same, count(DISTINCT doc_id) AS n FROM worded GROUP BY ALL) c
  JOIN (SELECT source, count(*) AS docs FROM d GROUP BY source) h ON c.source IS NOT DISTINCT FROM h.source
  WHERE n >= 10 AND n > 0.05 * docs
), lost AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS lost_words FROM worded l
  JOIN common c ON c.same = l.same AND c.source IS NOT DISTINCT FROM l.source GROUP BY doc_id
), judged AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_rep, 0) AS n_repeat_words,
    len(w) < 50 OR 100 * coalesce(n_rep, 0) > 50 * len(w) AS base_failed, coalesce(lost_words, 0) AS lost_words
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN repeated USING (doc_id) LEFT JOIN lost USING (doc_id)
)
SELECT *, NOT base_failed AND lost_words <= 0.5 * n_words AS kept FROM judged""",
    "op8_circulant_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_FOLD)} AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1))) AS i FROM d WHERE len(w) > 0)
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT x, y FROM shared s JOIN size a ON a.doc_id = x JOIN size b ON b.doc_id = y
  WHERE 100 * s.n >= 85 * (a.n + b.n - s.n)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y
)
SELECT x AS doc_id, coalesce(max(n), 0) AS n_shingles, min(y) AS component_id, min(y) = x AS kept
FROM reach LEFT JOIN size ON size.doc_id = x GROUP BY x""",
}
ORACLES["op12_phrase_graph"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), p AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)
), g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i
        FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k) ks WHERE len(w) >= k)
), c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM c WHERE k = 1 GROUP BY lang),
cand AS (
  SELECT c.* FROM c WHERE k >= 2 AND f >= 100 AND NOT EXISTS (
    SELECT 1 FROM c q WHERE q.lang = c.lang AND q.k = c.k + 1 AND 100 * q.f >= 100 * c.f
      AND (array_to_string(string_split(q.phrase, ' ')[1:c.k], ' ') = c.phrase
        OR array_to_string(string_split(q.phrase, ' ')[2:c.k + 1], ' ') = c.phrase))
), cut AS (
  SELECT cand.lang, cand.phrase, cand.f AS a, x.cut, n.n,
    array_to_string(string_split(cand.phrase, ' ')[1:x.cut], ' ') AS first,
    array_to_string(string_split(cand.phrase, ' ')[x.cut + 1:cand.k], ' ') AS rest
  FROM cand JOIN n USING (lang), (SELECT unnest([1, 2, 3, 4]) AS cut) x WHERE x.cut < cand.k
), s AS (
  SELECT cut.*, l.f AS l, r.f AS r,
    CAST((1000::HUGEINT * cut.a * cut.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM cut JOIN c l ON l.lang = cut.lang AND l.phrase = cut.first
  JOIN c r ON r.lang = cut.lang AND r.phrase = cut.rest
), b AS (
  SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS pick FROM s
)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank,
  phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM b WHERE pick = 1
QUALIFY rank <= 2000"""
_TERMS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)
ORACLES["op11_ball_search"] = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS big_n, sum(len(t)) AS big_l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
p AS (
  SELECT rid, doc_id, n, term, count(*) AS tf
  FROM (SELECT rid, doc_id, len(t) AS n, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (
  SELECT p.rid, p.doc_id, p.term,
    CAST(floor(1000 * ln((2.0 * s.big_n + 2) / (2.0 * df.df + 1))) AS BIGINT)
    * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * s.big_n) // s.big_l))) AS v
  FROM p JOIN df USING (term), s
), sc AS (SELECT q.item_id, c.rid, c.doc_id, sum(c.v) AS score FROM q JOIN c USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, rid) AS INTEGER) AS rank,
  doc_id, CAST(score AS BIGINT) AS score
FROM sc WHERE score > 0 QUALIFY rank <= 50"""
