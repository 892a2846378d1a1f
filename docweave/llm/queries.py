"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import (
    byte_bpe,
    collocations,
    decontaminate,
    mixing,
    quality_model,
    quality_rules,
    rlz_dedup,
    secrets,
    simhash,
    spelling,
    suffix_dedup,
    token_store,
    toxicity,
)
from docweave.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_rules(spark, d):
    rows = quality_rules.apply_rules(table(spark, d, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


ORACLES["op1_quality_rules"] = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM t),
g AS (SELECT doc_id, len(ws) AS n, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k
      FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
twice AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat FROM twice, unnest([0, 1, 2]) AS u(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
        CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat, 0) AS BIGINT) AS n_repeat_words,
        len(list_filter(ws, lambda x: regexp_matches(x, '\p{L}'))) AS n_letter,
        len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}{2,}\W*!+$|^\p{Lu}{4,}\W*$'))) AS n_shout,
        len(list_filter(ws, lambda x: x IN (__STOP__))) AS n_stop
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN false ELSE word_chars / n_words BETWEEN 2.0 AND 14.0 AND n_symbols / n_words <= 0.3
    AND n_dup_lines / n_lines <= 0.5 AND n_letter / n_words >= 0.7 AND n_stop / n_words >= 0.02
    AND n_shout / n_words <= 0.5 END AS kept
FROM f
""".replace("__STOP__", ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS)))


@query
def op5_mix_sources(spark, d):
    return mixing.mix(table(spark, d, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLES["op5_mix_sources"] = r"""
WITH s AS (SELECT doc_id, source,
        CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
      FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
wt AS (SELECT *, [3.0, 1.0, 2.0][1 + CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS INT)]::DOUBLE AS weight FROM src),
c AS (SELECT *, coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / weight, source
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
        sum(weight) OVER (ORDER BY 2.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight,
        (SELECT sum(source_size) FROM src) AS total FROM wt),
lev AS (SELECT (1.5 * total - full_before)::DOUBLE AS words, open_weight::DOUBLE AS per FROM c
        WHERE 2.0 * source_size * open_weight >= (1.5 * total - full_before) * weight ORDER BY 2.0 * source_size / weight LIMIT 1),
tg AS (SELECT source, source_size, least(2.0 * source_size, coalesce((SELECT words FROM lev) * weight / (SELECT per FROM lev), 0.0))::DOUBLE AS target FROM wt),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
        row_number() OVER (PARTITION BY s.source ORDER BY size, doc_id) - 1 AS rank
      FROM s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source)
SELECT doc_id, size, source_size, target,
  CAST((floor((rank + 1) * rate + __U__) - floor(rank * rate + __U__)) * size AS BIGINT) AS taken FROM r
""".replace("__U__", f"CAST({mixing.offset_of(mixing.SEED)!r} AS DOUBLE)")


@query
def op9_secret_scan(spark, d):
    import public_tokenizers

    rows = secrets.find_secrets(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", joined.alias("spans"))


@query
def op8_token_files(spark, d):
    import public_tokenizers

    folder = token_store.token_folder(spark)
    manifest = token_store.write_tokens(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return token_store.token_digests(manifest, folder)


@query
def op4_simhash_groups(spark, d):
    rows = simhash.near_duplicates(table(spark, d, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op2_toxicity(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = toxicity.fit(docs, labels, ~held_out(F.col("doc_id")))
    rows = toxicity.score_texts(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op7_quality_model(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = quality_model.fit(docs, labels, ~held_out(F.col("doc_id")))
    rows = quality_model.score_texts(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_decontaminate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = decontaminate.marked(docs, table(spark, d, "benchmark"), as_sql=True)
    ids = F.array_join(F.transform("items", lambda i: i.cast("string")), ",")
    return rows.select("doc_id", F.size("items").cast("long").alias("n_items"), ids.alias("items"), (F.size("items") > 0).alias("leaked"))


ORACLES["op6_decontaminate"] = r"""
WITH src AS (SELECT 'd' AS side, doc_id AS id, coalesce(text, '') AS text FROM documents
             UNION ALL SELECT 'b', item_id, coalesce(text, '') FROM benchmark),
r AS (SELECT side, id, list_filter(string_split(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace(text,
        '([^.!?:\x20\x09-\x0D][\x20\x09-\x0D])(\p{Lu})', '\1^\2', 'g'), '([0-9])[.,]([0-9])', '\1\2', 'g'), '([0-9])(\p{L})', '\1 \2', 'g')),
        '[^\p{L}\p{M}\p{N}^]+', ' ', 'g'), ' '), lambda w: w <> '' AND w <> '^') AS raw FROM src),
t AS (SELECT *, list_transform(raw, lambda w: CASE WHEN substr(w, 1, 1) BETWEEN '0' AND '9' THEN '<num>' WHEN substr(w, 1, 1) = '^' THEN '<name>'
        WHEN w IN (__UNITS__) THEN '<unit>' ELSE w END) AS typed FROM r),
sizes AS (SELECT DISTINCT least(len(raw), 5) AS size FROM t WHERE side = 'b' AND len(raw) > 0),
w AS (SELECT side, id, size, i, len(raw) AS n, typed[i + 1 : i + size] AS key, raw[i + 1 : i + size] AS vals
      FROM t, sizes, unnest(range(0, len(raw) - size + 1)) AS u(i) WHERE len(raw) >= size),
b AS (SELECT *, count(*) OVER (PARTITION BY id) AS item_windows FROM w WHERE side = 'b' AND (size = 5 OR n = size)
        AND len(list_filter(key, lambda x: NOT starts_with(x, '<'))) >= least(3, size)),
h AS (SELECT d.id AS doc_id, b.id AS item_id, b.item_windows, b.i AS item_at, d.key, d.vals AS dv, b.vals AS bv
      FROM w d JOIN b ON d.side = 'd' AND d.size = b.size AND d.key = b.key),
s AS (SELECT DISTINCT doc_id, item_id, key[k] AS kind, bv[k] AS item_value, dv[k] AS doc_value
      FROM h, unnest(range(1, 6)) AS u(k) WHERE starts_with(key[k], '<')),
c AS (SELECT doc_id, item_id, count(*) = count(DISTINCT (kind, item_value)) AND count(*) = count(DISTINCT (kind, doc_value)) AS consistent
      FROM s GROUP BY ALL),
g AS (SELECT doc_id, item_id, count(DISTINCT item_at) AS n, any_value(item_windows) AS item_windows FROM h GROUP BY ALL),
l AS (SELECT g.doc_id, g.item_id FROM g LEFT JOIN c ON g.doc_id = c.doc_id AND g.item_id = c.item_id
      WHERE coalesce(consistent, true) AND n / item_windows >= 0.8),
a AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM l GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items, '') AS items, coalesce(n_items, 0) > 0 AS leaked
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
""".replace("__UNITS__", ", ".join(f"'{u}'" for u in decontaminate.UNITS))


def _removed(name: str):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]).alias("n_removed")
    return "doc_id", name, removed, F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")


@query
def op3_suffix_dedup(spark, d):
    return suffix_dedup.remove_repeats(table(spark, d, "documents")).select(*_removed("n_bytes"))


@query
def op10_rlz_dedup(spark, d):
    return rlz_dedup.remove_repeats(table(spark, d, "documents")).select(*_removed("n_words"))


@query
def op11_spelling_variants(spark, d):
    return spelling.variants(table(spark, d, "documents"))


@query
def op12_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


ORACLES["op12_collocations"] = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM t),
tot AS (SELECT lang, CAST(sum(len(ws)) AS HUGEINT) AS n FROM p GROUP BY lang),
f AS (SELECT lang, size, array_to_string(ws[i : i + size - 1], ' ') AS phrase, count(*) AS f, any_value(ws[i : i + size - 1]) AS words
      FROM p, unnest([1, 2, 3, 4, 5]) AS u(size), unnest(range(1, len(ws) - size + 2)) AS v(i) GROUP BY 1, 2, 3 HAVING count(*) >= 100),
c AS (SELECT lang, phrase, size, f AS a, words FROM f WHERE size > 1),
s AS (SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, n, (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM c CROSS JOIN unnest([1, 2, 3, 4]) AS u(k)
      JOIN f x ON k < c.size AND x.lang = c.lang AND x.phrase = array_to_string(c.words[1 : k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.words[k + 1 : c.size], ' ') JOIN tot ON tot.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inn AS (SELECT lang, array_to_string(c.words[i : i + m - 1], ' ') AS phrase, max(a) AS longer
        FROM c, unnest([2, 3, 4]) AS u(m), unnest(range(1, c.size - m + 2)) AS v(i) WHERE m < c.size GROUP BY 1, 2),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
      FROM b LEFT JOIN inn ON inn.lang = b.lang AND inn.phrase = b.phrase WHERE coalesce(100 * longer < 100 * a, true))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""


@query
def op13_byte_bpe(spark, d):
    import public_tokenizers

    rows = byte_bpe.round_trip(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return rows.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
