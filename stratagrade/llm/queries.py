"""The operators bound to the `documents` table, one query each, with the DuckDB
twins of those that SQL can express."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, language_model, licenses, mixing, orc_tokens, pieces, quality_model, rules, search, sharding, similarity_join, tiling, token_counts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), k AS (
  SELECT *, -ln((('0x' || substr(md5(concat_ws('|', '11', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / greatest(0.05, 1.0 - coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::DOUBLE / greatest(size, 1)) AS key FROM d
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::DOUBLE AS w FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / w AS ratio FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE ratio >= level) * w, cap))::DOUBLE AS target FROM l
), g AS (
  SELECT source, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END::BIGINT AS epochs,
    floor(target - CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END * source_size)::BIGINT AS budget FROM t
), p AS (
  SELECT k.doc_id, k.size, g.source_size, g.target, g.epochs, g.budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key RANGE UNBOUNDED PRECEDING) AS upto,
    sum(k.size) OVER (PARTITION BY k.source, k.key) AS tied, count(*) OVER (PARTITION BY k.source, k.key) AS ties
  FROM k JOIN g ON k.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target, (epochs * size + CASE WHEN upto <= budget THEN size WHEN upto - tied <= budget THEN least(size, (budget - upto + tied) // ties) ELSE 0 END)::BIGINT AS taken FROM p
"""


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(documents(spark, sf_dir))


#: crc32 bit by bit; the heap step by step over the groups; of a size's groups, the lower shards first by md5.
OP4_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 8 AS size, md5(coalesce(text, '')) AS g FROM documents
), q AS (
  SELECT g, sum(size)::BIGINT AS bytes FROM d GROUP BY g
), o AS (
  SELECT bytes, row_number() OVER (ORDER BY bytes DESC) AS i FROM q
), h AS (
  SELECT 0::BIGINT AS i, list_transform(range(24), lambda x: 0::BIGINT) AS loads, 0::BIGINT AS bytes, 0 AS shard
  UNION ALL
  SELECT o.i, list_transform(h.loads, lambda x, j: CASE WHEN j = list_position(h.loads, list_min(h.loads)) THEN x + o.bytes ELSE x END), o.bytes, list_position(h.loads, list_min(h.loads)) - 1
  FROM h JOIN o ON o.i = h.i + 1
), s AS (
  SELECT q.g, p.shard FROM (SELECT g, bytes, row_number() OVER (PARTITION BY bytes ORDER BY g) AS k FROM q) q
  JOIN (SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS k FROM h WHERE i > 0) p ON p.bytes = q.bytes AND p.k = q.k
)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(t), '..'), lambda x: [('0x' || x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS text_crc32,
  'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY d.g, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM d JOIN s ON d.g = s.g
"""


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.verdicts(documents(spark, sf_dir))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d)
), c AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM c WHERE n > 1) GROUP BY doc_id
), l AS (
  SELECT doc_id, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words, len(regexp_extract_all(line, '[#*$%&|<>]')) AS symbols,
    len(regexp_extract_all(line, '[|\x{bb}\x{2022}\x{203a}]')) AS bars, len(regexp_extract_all(line, '[!?]{2,}')) AS shouts
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
), f AS (
  SELECT *, words > 0 AND (
    greatest(symbols - bars, shouts) * 10 > words * 3
    OR words < 3 AND NOT regexp_matches(line, '[.!?:;,\x{2026}\x{3002}\x{ff01}\x{ff1f}"''\x{201d}\x{bb})\]][\x09-\x0D\x20]*$')
    OR bars >= 2 AND bars * 4 >= words
    OR words <= 4 AND regexp_matches(line, '(?i)^[^\p{L}]*(MENU)[^\p{L}]*$')
    OR words <= 40 AND regexp_matches(line, '(?i)BOILERPLATE')) AS fails FROM l
), s AS (
  SELECT doc_id, sum(symbols) AS n_symbols, count(*) FILTER (WHERE words > 0) - count(DISTINCT CASE WHEN words > 0 THEN line END) AS n_dup, sum(CASE WHEN fails THEN words ELSE 0 END) AS lost
  FROM f GROUP BY doc_id
), b AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup::BIGINT AS n_dup_lines,
    coalesce(n_repeat, 0)::BIGINT AS n_repeat_words, lost FROM d JOIN s USING (doc_id) LEFT JOIN r USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost * 100 <= n_words * 50 AS kept FROM b
""".replace("MENU", "|".join(rules.MENU)).replace("BOILERPLATE", "|".join(rules.BOILERPLATE))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _pattern(tokens: list[str]) -> str:
    """A template as a regular expression over words that each follow a blank."""
    out = ""
    for t in tokens:
        if t == "<<optional>>":
            out += "(?:"
        elif t == "<<end>>":
            out += ")?"
        elif t.startswith("<<any"):
            out += "(?: [^ ]+){0," + t[6:-2] + "}"
        elif t.startswith("<<one of"):
            out += "(?:" + "|".join(" " + " ".join(x.split()) for x in t[9:-2].split("|")) + ")"
        else:
            out += " " + t
    return out + " "


def _op5_sql() -> str:
    places = []
    for phrase, _ in licenses.PHRASES:
        words = phrase.split()
        places.append(f"list_filter(range(1, len(w) - {len(words) - 2}), lambda i: " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(words)) + ")")
    base = [f"CASE WHEN len(p[{i}]) > 0 THEN '{label}' END" for i, (_, label) in enumerate(licenses.PHRASES, 1)]
    accepted, shares = [], ["CASE WHEN len(flatten(p)) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"]
    for markup, label in licenses.TEMPLATES:
        tokens = licenses.marks(markup)
        depth, ends = 0, []  # where mandatory words end
        for i, t in enumerate(tokens):
            depth += (t == "<<optional>>") - (t == "<<end>>")
            if not depth and not re.match("<<(optional|end|any)", t):
                ends.append(i + 1)
        opening = f"contains(s, ' {' '.join(tokens[: licenses.OPENING])} ')"
        accepted.append(f"CASE WHEN {opening} AND regexp_matches(s, '{_pattern(tokens)}') THEN '{label}' END")
        steps = "".join(f" WHEN regexp_matches(s, '{_pattern(tokens[:end])}') THEN {k}::DOUBLE / {len(ends)}" for k, end in reversed(list(enumerate(ends, 1))[licenses.OPENING :]))
        shares.append(f"CASE WHEN {opening} THEN CASE{steps or ' WHEN false THEN 0'} ELSE {licenses.OPENING}::DOUBLE / {len(ends)} END ELSE 0 END")
    joined = lambda found: f"array_to_string(list_sort(list_distinct([{', '.join(found)}])), ',')"
    return f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), e AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS s, [{", ".join(places)}] AS p FROM d)
      SELECT doc_id, len(w)::BIGINT AS n_words, len(flatten(p))::BIGINT AS n_base, (list_min(flatten(p)) - 1)::BIGINT AS first_word, (list_max(flatten(p)) - 1)::BIGINT AS last_word,
        {joined(base)} AS base_labels, {joined(base + accepted)} AS labels, greatest({", ".join(shares)}) AS score FROM e"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join.link(documents(spark, sf_dir), words=4, similarity=(85, 100))


#: Links between all pairs that share a shingle, and their closure.
OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d
), n AS (
  SELECT doc_id, len(g)::BIGINT AS n FROM s
), u AS (
  SELECT doc_id, unnest(g) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT a AS doc_id, n AS n_shingles, min(b) AS component_id FROM r JOIN n ON n.doc_id = r.a GROUP BY ALL
"""


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.tokens_round_trip(documents(spark, sf_dir), tokenizer=_vocabulary(), end_id=2)


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(documents(spark, sf_dir))


def llm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op8's contract defines without a model."""
    scored = language_model.score(documents(spark, sf_dir), order=1)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


#: crc32 bit by bit.
BASE_SCORES_SQL = r"""
WITH d AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), chr(10)) AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(regexp_extract_all(hex(doc_id::VARCHAR), '..'), lambda x: [('0x' || x)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) % 5 = 1 AS held_out FROM documents
), t AS (
  SELECT doc_id, held_out, unnest(w) AS w FROM d
), c AS (
  SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w
), n AS (
  SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v FROM c
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(c) AS n_known, n AS train_tokens, round(sum(log10((coalesce(c, 0) + 0.5::DOUBLE) / (n + 0.5::DOUBLE * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c ON c.w = t.w, n GROUP BY doc_id, held_out, n
"""


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.suffix_sums(token_counts.length_histogram(documents(spark, sf_dir), tokenizer=_vocabulary()))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.coverage(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), short_items=True)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


OP11_SQL = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), c AS (
  SELECT lang, source, w, count(*) AS n FROM (SELECT lang, source, unnest(w) AS w FROM d) GROUP BY ALL
), k AS (
  SELECT lang, w FROM (SELECT lang, unnest(list_distinct(w)) AS w FROM d) GROUP BY ALL HAVING count(*) >= 3
), v AS (
  SELECT lang, count(*) AS v FROM k GROUP BY lang
), x AS (
  SELECT g.lang, g.source, k.w, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w
), p AS (
  SELECT x.lang, source, w, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY x.lang, source) + v) AS p,
    1 + 1000000000 * (sum(n) OVER (PARTITION BY x.lang, w) + 1) // (sum(n) OVER (PARTITION BY x.lang) + v) AS q
  FROM x JOIN v ON v.lang = x.lang
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, w AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""


def _pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(documents(spark, sf_dir), model=_pieces()), model=_pieces())


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT count(*)::BIGINT AS docs, sum(len(w))::BIGINT AS words FROM d WHERE len(w) > 0
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), t AS (
  SELECT doc_id, n, w, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM i) GROUP BY ALL
), f AS (
  SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM t, s GROUP BY w, docs
), r AS (
  SELECT i.item_id, t.doc_id, sum(f.weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // words))))::BIGINT AS score FROM i JOIN t ON t.w = i.w JOIN f ON f.w = i.w, s GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM r WHERE score > 0) WHERE rank <= 50
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_mix_sources, op2_quality_classifier, op3_quality_rules, op4_shard_documents, op5_license_scan,
        op6_ngram_join, op7_orc_tokens, op8_language_model, op9_token_counts, op10_decontaminate, op11_source_divergence, op12_piece_round_trip, op13_ranked_search, llm_base_scores,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": OP1_SQL, "op3_quality_rules": OP3_SQL, "op4_shard_documents": OP4_SQL, "op5_license_scan": _op5_sql(), "op6_ngram_join": OP6_SQL,
        "op11_source_divergence": OP11_SQL, "op13_ranked_search": OP13_SQL, "llm_base_scores": BASE_SCORES_SQL,
    }
