"""The operators as queries on the given tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from wearline.llm import (
    interactions,
    language,
    licenses,
    lines,
    mixing,
    near,
    packing,
    quality,
    sharding,
    tokens,
    topk,
    toxicity,
    whitening,
)
from wearline.llm.shared import read_documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def _quality_sql(rules: quality.QualityRules = quality.DEFAULT) -> str:
    common = ", ".join(
        f"('{lang}', {i}, '{w}')" for lang, words in rules.common_words.items() for i, w in enumerate(words)
    )
    k = max(map(len, rules.common_words.values()))
    count = "length(regexp_replace(txt, '[^{}]+', '', 'g'))"
    classes = [count.format(m.replace("'", "''")) for m in quality.CLASSES.values()]

    def distance(side: str, width: int) -> str:
        terms = " + ".join(
            f"(CASE WHEN p{i} > 0 THEN p{i} * log2(p{i} / ((p{i} + r{i}) / 2)) ELSE 0 END"
            f" + CASE WHEN r{i} > 0 THEN r{i} * log2(r{i} / ((p{i} + r{i}) / 2)) ELSE 0 END) / 2"
            for i in range(width)
        )
        p = " + ".join(f"{side}{i}" for i in range(width))
        r = " + ".join(f"r{side}{i}" for i in range(width))
        shares = ", ".join(
            f"{side}{i}::DOUBLE / nullif({p}, 0) AS p{i}, r{side}{i}::DOUBLE / nullif({r}, 0) AS r{i}"
            for i in range(width)
        )
        return f"SELECT n, sqrt(greatest(0, {terms})) AS d FROM (SELECT n, {shares} FROM joined)"

    n_classes = len(classes) + 3
    return f"""
WITH docs AS (SELECT row_number() OVER () AS n, doc_id, lang, coalesce(text, '') AS txt FROM documents),
split AS (SELECT *, regexp_extract_all(txt, '[^\\x20\\x09-\\x0D]+') AS words FROM docs),
pos AS (SELECT n, unnest(range(1, len(words) - 3)) AS i, words FROM split WHERE len(words) >= 5),
win AS (SELECT n, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS w FROM pos),
twice AS (SELECT n, i FROM win QUALIFY count(*) OVER (PARTITION BY n, w) > 1),
cover AS (SELECT DISTINCT n, i + k AS p FROM twice, range(5) AS r(k)),
rep AS (SELECT n, count(*) AS n_repeat_words FROM cover GROUP BY n),
common(lang, i, w) AS (VALUES {common}),
each_word AS (SELECT n, lang, unnest(words) AS w FROM split),
hits AS (SELECT n, i, count(*) AS c FROM each_word JOIN common USING (lang, w) GROUP BY n, i),
wide AS (SELECT n, sum(c) AS hit, {", ".join(f"coalesce(sum(c) FILTER (i = {i}), 0) AS h{i}" for i in range(k))}
  FROM hits GROUP BY n),
base AS (
  SELECT s.n, doc_id, s.lang, length(txt) AS n_chars, len(words) AS n_words,
    coalesce(length(array_to_string(words, '')), 0) AS word_chars,
    length(regexp_replace(txt, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(len(list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))), 0)
      - coalesce(len(list_distinct(list_filter(string_split(txt, chr(10)),
          lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))), 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    {", ".join(f"{c} AS c{i}" for i, c in enumerate(classes))},
    octet_length(encode(txt)) - length(txt) AS c{len(classes)},
    {", ".join(f"coalesce(h{i}, 0) AS w{i}" for i in range(k))}, len(words) - coalesce(hit, 0) AS w{k}
  FROM split s LEFT JOIN rep USING (n) LEFT JOIN wide USING (n)),
feat AS (SELECT *, n_chars - word_chars AS c{n_classes - 2},
    word_chars - {" - ".join(f"c{i}" for i in range(len(classes)))} AS c{n_classes - 1} FROM base),
refs AS (SELECT lang, {", ".join(f"sum(c{i}) AS rc{i}" for i in range(n_classes))},
    {", ".join(f"sum(w{i}) AS rw{i}" for i in range(k + 1))}, sum(n_words) AS ref_words
  FROM feat WHERE lang IN (SELECT lang FROM common) GROUP BY lang),
joined AS (SELECT * FROM feat JOIN refs USING (lang) WHERE ref_words >= {rules.min_reference}),
class_d AS ({distance("c", n_classes)}),
word_d AS ({distance("w", k + 1)}),
verdict AS (
  SELECT feat.*, n_words < {rules.min_words_kept}
      OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
    coalesce(n_chars >= {rules.min_chars} AND class_d.d > {rules.max_class_distance}, false)
      OR coalesce(n_words >= {rules.min_words} AND word_d.d > {rules.max_word_distance}, false) AS far
  FROM feat LEFT JOIN class_d USING (n) LEFT JOIN word_d USING (n))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT far AS kept
FROM verdict"""


@query("op1_quality_divergence", _quality_sql())
def quality_divergence(spark, sf_dir):
    judged = quality.judge(read_documents(spark, sf_dir), carry=["doc_id"])
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select("doc.doc_id", *counts, "base_failed", "kept")


@query("op2_odd_sketch_near")
def odd_sketch_near(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    return near.near_duplicates(docs, near.Near(shingle=2))


@query("op3_piece_tokens")
def piece_tokens(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return tokens.count_tokens(docs, path).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def _remainder(n: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query("op4_rank_order_language")
def rank_order_language(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    profiles = language.learn(docs.where(_remainder(4) != 2))
    found = language.identify(docs.select("doc_id", "text", held_out.alias("held_out")), profiles)
    return found.select("doc.doc_id", "doc.held_out", "lang_pred", "score")


TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id,
    list_sum(list_transform(range(1, least(len(q.e), len(v.e)) + 1), lambda i: q.e[i] * v.e[i]))::BIGINT AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""


@query("op5_no_random_access_top", TOP_SQL)
def no_random_access_top(spark, sf_dir):
    vectors = read_documents(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


@query("op6_factorization_toxicity")
def factorization_toxicity(spark, sf_dir):
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    labels = read_documents(spark, sf_dir, "labels")
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    machine = toxicity.train(docs, labels.where(_remainder(3) != 1))
    scored = toxicity.score(docs.withColumn("held_out", held_out), machine)
    return scored.select("doc.doc_id", "doc.held_out", "score", "predicted")


@query("op9_license_compression")
def license_compression(spark, sf_dir):
    found = licenses.scan_licenses(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc.doc_id",
        "start",
        "license",
        F.round("saved", 6).alias("saved"),
        F.size("missing").alias("n_missing"),
        F.size("extra").alias("n_extra"),
    )


MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
sources AS (
  SELECT source, sum(size)::DOUBLE AS s,
    [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w,
    row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM sized GROUP BY source),
run AS (
  SELECT *, coalesce(sum(s) OVER (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sb,
    coalesce(sum(w) OVER (ORDER BY s / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wb
  FROM sources),
rates AS (SELECT *, (1.5 * sum(s) OVER () - 2 * sb) / (sum(w) OVER () - wb) AS rate FROM run),
level_rate AS (SELECT arg_min(rate, s / w) AS rate FROM rates WHERE rate <= 2 * s / w),
targets AS (
  SELECT source, s, CASE WHEN (SELECT rate FROM level_rate) IS NULL THEN 2 * s
    ELSE least(2 * s, (SELECT rate FROM level_rate) * w) END AS target FROM sources),
leveled AS (SELECT *, least(length(bin(size)), 16) AS level FROM sized),
groups AS (
  SELECT l.source, level, sum(size)::DOUBLE AS words, (8.0 + level) / 8.0 AS pref, any_value(target) AS target
  FROM leveled l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source GROUP BY 1, 2),
scales AS (
  SELECT *, (target - 2 * coalesce(sum(words) OVER (PARTITION BY source ORDER BY level DESC
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / nullif(sum(words * pref) OVER (PARTITION BY source ORDER BY level ROWS UNBOUNDED PRECEDING), 0) AS scale
  FROM groups),
chosen AS (
  SELECT source, arg_max(scale, level) AS scale FROM scales WHERE scale >= 0 AND scale * pref <= 2 GROUP BY source),
expected AS (
  SELECT g.source, level, target, CASE WHEN target > 0 THEN least(2.0, coalesce(c.scale * pref, 2.0)) ELSE 0 END AS e
  FROM groups g LEFT JOIN chosen c ON g.source IS NOT DISTINCT FROM c.source),
drawn AS (
  SELECT d.*, target, floor(e) AS whole, e - floor(e) AS pi,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || CASE WHEN copy > 0 THEN '#' || copy ELSE '' END), 1, 12))::BIGINT
      + 0.5) / 281474976710656.0 AS u
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) - 1 AS copy FROM leveled) d JOIN expected x ON d.source IS NOT DISTINCT FROM x.source AND d.level = x.level),
ranked AS (
  SELECT *, CASE WHEN pi > 0 AND size > 0 THEN (u::DOUBLE / (1 - u::DOUBLE)) / (pi / (1 - pi)) END AS q,
    target - sum(whole * size) OVER (PARTITION BY source) AS open FROM drawn),
picks AS (
  SELECT *, q IS NOT NULL AND sum(CASE WHEN q IS NOT NULL THEN size ELSE 0 END) OVER (
    PARTITION BY source ORDER BY q NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2 <= open AS picked
  FROM ranked)
SELECT doc_id, size, t.s::BIGINT AS source_size, round(t.target, 3) AS target,
  ((whole + picked::INTEGER) * size)::BIGINT AS taken
FROM picks p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source"""


@query("op7_pareto_mix", MIX_SQL)
def pareto_mix(spark, sf_dir):
    mixed = mixing.mix(read_documents(spark, sf_dir), carry=["doc_id"])
    return mixed.select(
        "doc.doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken"
    )


@query("op10_fuzzy_lines")
def fuzzy_lines(spark, sf_dir):
    found = lines.removals(read_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
    )


@query("op8_deficit_packing")
def deficit_packing(spark, sf_dir):
    docs = read_documents(spark, sf_dir)
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), weights=(5, 2, 1))
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def _crc32_table(polynomial: int = 0xEDB88320) -> list[int]:
    """What each byte value leaves of a reflected CRC of 32 bits."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (polynomial if value & 1 else 0)
        table.append(value)
    return table


SHARD_SQL = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents),
bytes AS (
  SELECT doc_id, source, size,
    list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda b: ('0x' || b)::BIGINT) AS b FROM docs),
summed AS (
  SELECT doc_id, source, size, xor(4294967295::BIGINT, list_reduce(b, lambda a, x:
    xor(a >> 8, ({_crc32_table()})[(xor(a, x) & 255) + 1]::BIGINT), 4294967295::BIGINT)) AS crc FROM bytes),
numbered AS (
  SELECT *, (row_number() OVER (PARTITION BY doc_id, source, size, crc) - 1) // {sharding.TOGETHER} AS part FROM summed),
drawn AS (
  SELECT *, ('0x' || substr(md5('23:' || coalesce(doc_id::VARCHAR, '') || ':' || crc || ':' || part), 1, 12))::BIGINT AS u
  FROM numbered),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY source) AS n,
    (('0x' || substr(md5('23:source:' || coalesce(source, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS shift,
    row_number() OVER (PARTITION BY source ORDER BY u, doc_id NULLS FIRST, size, crc, part) - 1 AS r FROM drawn),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (r + shift) / n::DOUBLE, u, doc_id NULLS FIRST, size, crc, part) - 1 AS place,
    count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, place * 16 // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, crc::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (place - (shard * total + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut"""


@query("op11_stratified_interleaving", SHARD_SQL)
def stratified_interleaving(spark, sf_dir):
    placed = sharding.assign_shards(read_documents(spark, sf_dir), shards=16, carry=["doc_id"])
    law, grown = F.lit("rows").alias("law"), F.lit(None).cast("int").alias("grown_shard")
    return placed.select("doc.doc_id", "size", "text_crc32", law, "shard", "slot", grown)


@query("op12_jacobi_davidson_whitening")
def jacobi_davidson_whitening(spark, sf_dir):
    white = whitening.whiten(read_documents(spark, sf_dir, "embeddings"), components=32)
    entry = F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "entry")
    each = white.select("doc.vec_id", "n", "deviation", "identity_error", entry)
    component = (F.col("place") + 1).alias("component")
    return each.select(
        "vec_id", component, "n", "deviation", "entry.whitened", "entry.explained", "identity_error"
    )


AUDIT_SQL = """
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (
  SELECT doc_id, part,
    (len(w) < 200)::INTEGER + 2 * (100 * coalesce(len(list_distinct(w)), 0) < 50 * len(w))::INTEGER
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INTEGER
    + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask
  FROM docs),
marks AS (
  SELECT doc_id, max(coalesce(quality = 1, false)::INTEGER) AS good, max(coalesce(toxic = 1, false)::INTEGER) AS toxic
  FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS docs, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM judged LEFT JOIN marks USING (doc_id) GROUP BY part, mask),
letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, range(1, 6) AS r(step)),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(docs) FILTER (mask & (before + bit) = 0), 0) AS kept,
    coalesce(sum(docs) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS removed,
    coalesce(sum(docs) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS redundant,
    coalesce(sum(docs) FILTER (mask = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM counted"""


@query("op13_gray_code_audit", AUDIT_SQL)
def gray_code_audit(spark, sf_dir):
    return interactions.audit(read_documents(spark, sf_dir), read_documents(spark, sf_dir, "labels"))
