"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, collocations, lm, mixing, packing, pii, quality, runs, sharding, simhash, suffix_dedup, warc
from .common import cut, table


#: For the synthetic tables, where the session has no key of its own.
SYNTHETIC_KEY = "for synthetic tables"


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.neighbour_preferences(table(spark, sf_dir, "conversations")))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), pii.session_key(spark, SYNTHETIC_KEY))


def op4_simhash_vp_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op6_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(mixing.leaf_rows(table(spark, sf_dir, "documents")))
    return mixing.mixture(rows, mixing.plan_mixture(rows))


def op8_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sharding.shard(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES: dict[str, str] = {}

def op9_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.remove_passages(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_content_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), warc.archive_path(spark))
    return warc.digest_rows(warc.read_archive(spark, archive))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = runs.word_runs(table(spark, sf_dir, "documents"), plant=True, digests=True)
    return got.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_length_buckets": op1_length_buckets,
    "op2_preference_format": op2_preference_format,
    "op3_surrogates": op3_surrogates,
    "op4_simhash_vp_tree": op4_simhash_vp_tree,
    "op5_robust_graph": op5_robust_graph,
    "op6_attention_scores": op6_attention_scores,
    "op7_source_mixture": op7_source_mixture,
    "op8_byte_shards": op8_byte_shards,
    "op9_suffix_family": op9_suffix_family,
    "op10_quality_rules": op10_quality_rules,
    "op11_content_archive": op11_content_archive,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_collocations": op13_collocations,
}


#: The words of a text in DuckDB.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op10_quality_rules"] = rf"""
WITH d AS (
  SELECT doc_id, lang, coalesce(text, '') AS t, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), win AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), rep AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM win, (VALUES (0), (1), (2)) v(o) WHERE c >= 2 GROUP BY doc_id
), c AS (
  SELECT d.doc_id, coalesce(lang, '') AS stratum, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN rep USING (doc_id)
), s AS (
  SELECT *, (n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words) AS base_failed,
         coalesce(n_symbols::DOUBLE / nullif(n_words, 0), 0) AS symbol_share, coalesce(n_dup_lines::DOUBLE / nullif(n_lines, 0), 0) AS dup_line_share,
         coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0) AS repeat_share, coalesce(n_capitals::DOUBLE / nullif(word_chars, 0), 0) AS capital_share
  FROM c
), firsts AS (
  SELECT *, CASE {" ".join(f"WHEN {r} > CAST({c} AS DOUBLE) THEN {i}" for i, (r, c) in enumerate(quality.PATH))} ELSE {len(quality.PATH)} END AS first FROM s
), good AS (
  SELECT DISTINCT ON (stratum, t) stratum, first FROM firsts
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) >= 1 AND max(coalesce(toxic, 0)) = 0)
), strata AS (
  SELECT stratum, count(*) AS n FROM good GROUP BY stratum HAVING count(*) >= {quality.MIN_GOOD}
), terms AS (
  SELECT stratum, n, i, n * ln(1 - a) + sum(CASE WHEN i = 0 THEN 0 ELSE ln((n - i + 1)::DOUBLE / i) + ln(a / (1 - a)) END) OVER (PARTITION BY stratum ORDER BY i) AS lt
  FROM (SELECT stratum, n, CAST({quality.ALPHA} AS DOUBLE) AS a, unnest(range(0, greatest(CAST(floor(n * CAST({quality.ALPHA} AS DOUBLE)) AS BIGINT), 1) + 1)) AS i FROM strata)
), tail AS (
  SELECT stratum, i, ln(greatest(sum(exp(lt)) OVER (PARTITION BY stratum ORDER BY i), 1e-300)) AS ls FROM terms
), most AS (
  SELECT stratum, coalesce(max(i) FILTER (ls <= ln(CAST({quality.DELTA} AS DOUBLE) / (SELECT count(*) FROM strata))), -1) AS most FROM tail GROUP BY stratum
), steps AS (
  SELECT stratum, count(*) FILTER (k <= most) AS steps
  FROM (SELECT m.stratum, most, step, count(*) FILTER (first <= step) AS k FROM most m JOIN good USING (stratum), range({len(quality.PATH)}) r(step) GROUP BY ALL) GROUP BY stratum
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND first >= coalesce(steps, 0) AS kept
FROM firsts LEFT JOIN steps USING (stratum)
"""

ORACLES["op1_length_buckets"] = rf"""
WITH RECURSIVE seqs AS (
  SELECT doc_id, chunk, least({packing.MAX_LEN}, n - chunk * {packing.MAX_LEN}) AS seq_len
  FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // {packing.MAX_LEN} + 1)) AS chunk FROM (SELECT doc_id, len({_WORDS}) AS n FROM documents) WHERE n > 0)
), hist AS (
  SELECT seq_len AS b, row_number() OVER (ORDER BY seq_len) AS j, sum(count(*)) OVER (ORDER BY seq_len) AS rows, sum(count(*) * seq_len) OVER (ORDER BY seq_len) AS tokens FROM seqs GROUP BY seq_len
), ends AS (SELECT b, j, rows, tokens FROM hist UNION ALL SELECT 0, 0, 0, 0),
dp AS (
  SELECT 0 AS k, 0::BIGINT AS j, 0::HUGEINT AS cost, []::BIGINT[] AS limits
  UNION ALL
  SELECT k + 1, h.j, min(dp.cost + h.b * (h.rows - e.rows) - (h.tokens - e.tokens)),
         arg_min(list_append(dp.limits, h.b), (dp.cost + h.b * (h.rows - e.rows) - (h.tokens - e.tokens)) * 100000 + dp.j)
  FROM dp JOIN ends e ON e.j = dp.j JOIN hist h ON h.j > dp.j WHERE dp.k < {packing.BUCKETS} GROUP BY k, h.j
), best AS (
  SELECT limits FROM dp WHERE j = (SELECT max(j) FROM ends) AND k = least({packing.BUCKETS}, (SELECT max(j) FROM ends))
), placed AS (
  SELECT doc_id, chunk, seq_len, list_min(list_filter(limits, lambda x: x >= seq_len)) AS bucket_len, md5('{packing.SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || chunk::VARCHAR) AS place FROM seqs, best
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY place, doc_id, chunk, seq_len) - 1 AS r, greatest(1, {packing.TOKEN_BUDGET} // bucket_len) AS fit FROM placed
)
SELECT doc_id, chunk, seq_len, bucket_len, r // fit AS batch, r % fit AS slot, bucket_len - seq_len AS padding FROM ranked
"""

ORACLES["op2_preference_format"] = r"""
WITH conv AS (SELECT conv_id, coalesce(turn, -4611686018427387904) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
lasts AS (SELECT conv_id, max({'turn': turn, 'text': text}) AS last FROM conv WHERE role = 'assistant' GROUP BY conv_id),
marked AS (
  SELECT conv.*, coalesce(role = 'assistant' AND turn = own.last.turn, false) AS swap, other.last.text AS said
  FROM conv LEFT JOIN lasts own USING (conv_id) LEFT JOIN lasts other ON other.conv_id = xor(conv.conv_id, 1)
), sides AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM marked
  UNION ALL SELECT conv_id, 'rejected', turn, role, CASE WHEN swap THEN said ELSE text END FROM marked WHERE NOT swap OR said IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn, role, text) - 1 AS place FROM (SELECT DISTINCT * FROM sides)
), met AS (
  SELECT pair_id, place, count(*) AS n, count(DISTINCT {'r': role, 't': text}) AS kinds FROM placed GROUP BY ALL
), split AS (
  SELECT pair_id, min(place) FILTER (n < 2 OR kinds > 1) AS split FROM met GROUP BY pair_id
), parts AS (
  SELECT pair_id, CASE WHEN split IS NULL OR place < split THEN 'prompt' ELSE side END AS part,
         CASE WHEN split IS NULL OR place < split THEN place ELSE place - split END AS seq, role,
         length('<|' || replace(role, '<|', '< |') || '|>' || chr(10)) AS head,
         '<|' || replace(role, '<|', '< |') || '|>' || chr(10) || replace(text, '<|', '< |') || '<|end|>' || chr(10) AS rendered
  FROM placed JOIN split USING (pair_id) WHERE NOT (split IS NULL OR place < split) OR side = 'chosen'
), ends AS (
  SELECT *, sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY seq) AS char_end FROM parts
)
SELECT pair_id, part, seq, role, rendered, CAST(char_end - length(rendered) AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN char_end - length(rendered) + head END AS BIGINT) AS mask_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN char_end END AS BIGINT) AS mask_end
FROM ends
"""


def _when(level: str) -> str:
    named = {k: v for k, v in mixing.WEIGHTS[level].items() if k != "*"}
    other = mixing.WEIGHTS[level].get("*", 0)
    return f"CASE {' '.join(f'WHEN {level} = {k!r} THEN {v}' for k, v in named.items())} ELSE {other} END" if named else str(other)


def _shares(name: str, level: str, parent: str) -> str:
    above = mixing.LEVELS[: mixing.LEVELS.index(level)]
    keys = ", ".join([*above, level])
    on = f"JOIN {parent} USING ({', '.join(above)})" if above else f"CROSS JOIN {parent}"
    part = f"PARTITION BY {', '.join(above)}" if above else ""
    return f"""
{name}_w AS (
  SELECT {keys}, most, weight, budget AS b, sum(most) OVER ({part} ORDER BY most / weight, {level} ROWS UNBOUNDED PRECEDING) - most AS before,
         sum(weight) OVER ({part}) - sum(weight) OVER ({part} ORDER BY most / weight, {level} ROWS UNBOUNDED PRECEDING) + weight AS weight_on
  FROM (SELECT {keys}, sum(most)::DOUBLE AS most, {_when(level)}::DOUBLE AS weight FROM leaves GROUP BY {keys}) {on}
), {name} AS (
  SELECT {keys}, CAST(least(most, floor(weight * max((b - before) / weight_on) OVER ({part}))) AS BIGINT) AS budget FROM {name}_w
)"""


ORACLES["op7_source_mixture"] = rf"""
WITH rows AS (
  SELECT doc_id, coalesce(CASE n % 4 WHEN 0 THEN 'web' WHEN 1 THEN 'books' WHEN 2 THEN 'papers' WHEN 3 THEN 'code' END, 'other') AS domain, lang, source, n_tokens
  FROM (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS BIGINT) AS n, len({_WORDS}) AS n_tokens FROM documents) WHERE n_tokens > 0
), leaves AS (
  SELECT domain, lang, source, sum(n_tokens) AS tokens, sum(n_tokens) * {mixing.MAX_EPOCHS} AS most FROM rows GROUP BY ALL
), total AS (SELECT CAST(floor(sum(tokens)::DOUBLE * {mixing.BUDGET_PERCENT} / 100) AS BIGINT) AS budget FROM leaves),
{_shares("dom", "domain", "total")}, {_shares("lng", "lang", "dom")}, {_shares("src", "source", "lng")},
plan AS (
  SELECT *, CAST(budget // tokens AS BIGINT) AS full, CAST(budget % tokens AS BIGINT) AS rest FROM leaves JOIN src USING (domain, lang, source)
), ordered AS (
  SELECT rows.*, tokens, plan.full, rest, md5('{mixing.SEED}:' || (plan.full + 1)::VARCHAR || ':' || coalesce(doc_id::VARCHAR, '')) AS place FROM rows JOIN plan USING (domain, lang, source)
), run AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) - n_tokens AS start FROM ordered
)
SELECT doc_id, domain, lang, source, n_tokens, unnest(range(1, "full" + 1)) AS epoch, n_tokens AS take_tokens FROM ordered
UNION ALL
SELECT doc_id, domain, lang, source, n_tokens, "full" + 1, CAST(least(n_tokens, rest - start) AS BIGINT) FROM run WHERE start < rest
"""

ORACLES["op11_content_archive"] = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(8), lambda g: array_to_string(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, CAST(5 * g + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM m
"""

ORACLES["op13_collocations"] = rf"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), f AS (
  SELECT lang, words, g, count(*) AS n FROM (
    SELECT lang, 1 AS words, unnest(w) AS g FROM pieces
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) FROM pieces
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) FROM pieces
  ) GROUP BY ALL
), total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
cand AS (SELECT lang, words, g, string_split(g, ' ') AS s, n AS a FROM f WHERE words >= 2 AND n >= {collocations.MIN_COUNT}),
cuts AS (
  SELECT lang, words, g, a, k, array_to_string(s[1:k], ' ') AS head, array_to_string(s[k + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, words)) AS k FROM cand)
), scored AS (
  SELECT c.lang, c.words, c.g, c.a, k, l.n AS l, r.n AS r, (1000000::HUGEINT * c.a * c.a) // (l.n::HUGEINT * r.n) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = c.head JOIN f r ON r.lang = c.lang AND r.g = c.rest
), best AS (
  SELECT lang, words, g, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS c FROM scored GROUP BY ALL
), inner_ AS (
  SELECT lang, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS g, a AS around FROM cand WHERE words = 3
), covered AS (SELECT lang, g, max(around) AS around FROM inner_ GROUP BY ALL),
ranked AS (
  SELECT b.lang, b.g AS phrase, b.a, b.c.l AS l, b.c.r AS r, CAST(b.c.score AS BIGINT) AS score,
         row_number() OVER (PARTITION BY b.lang ORDER BY b.c.score DESC, b.a DESC, b.g) AS rank
  FROM best b LEFT JOIN covered USING (lang, g) WHERE around IS NULL OR 100 * around < {collocations.COVER_PERCENT} * b.a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {collocations.TOP}
"""
