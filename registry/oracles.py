"""The registered queries as DuckDB SQL over the same tables."""

from __future__ import annotations

from html import entities

from docweave.functions import html as H
from docweave.functions import text as X
from docweave.functions import urls as U
from docweave.operators.answer import PROMPT
from registry.queries import PLAIN, RULES

ORACLES: dict[str, str] = {}


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WS = f"[{X.SPACES}]"


def sub(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def ext(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def collapse(text: str) -> str:
    return f"trim({sub(text, WS + '+', ' ')}, ' ')"


def strip(text: str) -> str:
    return sub(text, f"^{WS}+|{WS}+$", "")


def quiet(html: str = "html") -> str:
    return sub(html, H.NOISE, " ")


def notags(html: str) -> str:
    return sub(html, H.TAG, " ")


ENTITY_MAP = "MAP {" + ", ".join(f"{lit(k[:-1])}: {lit(v)}" for k, v in entities.html5.items() if k.endswith(";")) + "}"
OLD = sorted((k for k in entities.html5 if not k.endswith(";")), key=len, reverse=True)
OLD_MAP = "MAP {" + ", ".join(f"{lit(k)}: {lit(entities.html5[k])}" for k in OLD) + "}"
WINDOWS = "MAP {" + ", ".join(f"{n}: {lit(c)}" for n in range(128, 160) if (c := bytes([n]).decode("cp1252", "ignore"))) + "}"


def decode(text: str) -> str:
    """Character references in one pass over the pieces between ampersands."""
    name, number = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)", "regexp_extract(p, '^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?', 1)"
    width, old = "length(regexp_extract(p, '^#([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});?', 0))", f"regexp_extract(p, {lit('^(' + '|'.join(OLD) + ')')}, 1)"
    code = f"CASE WHEN starts_with(lower({number}), 'x') THEN TRY_CAST('0' || {number} AS INTEGER) ELSE TRY_CAST(nullif({number}, '') AS INTEGER) END"
    char = f"coalesce({WINDOWS}[{code}], CASE WHEN ({code}) BETWEEN 1 AND 55295 OR ({code}) BETWEEN 57344 AND 1114111 THEN chr({code}) END)"
    piece = (
        f"CASE WHEN i = 1 THEN p ELSE coalesce({ENTITY_MAP}[{name}] || substr(p, length({name}) + 2), {char} || substr(p, {width} + 1), "
        f"{OLD_MAP}[{old}] || substr(p, length({old}) + 1), '&' || p) END"
    )
    listed = f"list_transform(string_split({text}, '&'), lambda p, i: {piece})"
    return f"CASE WHEN contains({text}, '&') THEN array_to_string({listed}, '') ELSE {text} END"


def clean(text: str) -> str:
    return f"coalesce({sub(collapse(text), '[^' + chr(92) + 's' + X.TITLE_KEPT + ']', '')}, '')"


def canonical(url: str) -> str:
    return sub(ext(url, "^([^?#]*)"), ";[^/]*$", "")


def any_term(text: str, terms) -> str:
    return "(" + (" OR ".join(f"contains({text}, {lit(t)})" for t in terms) or "false") + ")"


def count_terms(text: str, terms) -> str:
    return "(" + (" + ".join(f"contains({text}, {lit(t)})::INT" for t in terms) or "0") + ")"


def block(html: str, name: str) -> str:
    return ext(html, rf"(?is)<{name}\b[^>]*>(.*)</{name}\s*>")


# --- shared tables ------------------------------------------------------------------------

NOISELESS = f"noiseless AS (SELECT page_id, url, html, {quiet()} AS q FROM pages)"
MAIN = f"""{NOISELESS},
core AS (SELECT *, {sub("q", H.chrome_pattern(H.CHROME_IN_MAIN), " ")} AS core FROM noiseless),
boxed AS (SELECT *, {block("core", "article")} AS a, {block("core", "main")} AS m FROM core),
block_sized AS (SELECT *, list_transform(regexp_split_to_array(regexp_replace(core, '(?is)^.*<body[^>]*>', ''), '(?i)</?(?:div|section|table|td|body|html|head)(?:[^a-zA-Z0-9_>][^>]*)?>'),
  lambda x: struct_pack(n := length({collapse(notags("x"))}), h := x)) AS blocks FROM boxed),
block_fair AS (SELECT *, list_filter(blocks, lambda x: 4 * x.n >= list_max(list_transform(blocks, lambda y: y.n))) AS kept FROM block_sized),
block_picked AS (SELECT *, list_transform(CASE WHEN 100 * list_sum(list_transform(kept, lambda x: x.n)) >= 80 * list_sum(list_transform(blocks, lambda x: x.n))
  THEN kept ELSE blocks END, lambda x: x.h) AS chosen FROM block_fair),
raw_main AS (SELECT page_id, url, html, q, {notags("CASE WHEN a <> '' THEN a WHEN m <> '' THEN m ELSE array_to_string(chosen, ' ') END")} AS stripped FROM block_picked),
mains AS (SELECT page_id, url, html, q, {collapse(decode("stripped"))} AS main_text FROM raw_main)"""
WHOLE = f"""wholes AS (SELECT page_id, {collapse(decode("w"))} AS page_text FROM
  (SELECT page_id, {notags(sub("q", H.chrome_pattern(H.CHROME_IN_PAGE), " "))} AS w FROM noiseless))"""
TITLES = f"""titles AS (SELECT page_id, {clean(decode("t"))} AS title FROM
  (SELECT page_id, {ext("q", "(?is)<title" + chr(92) + "b[^>]*>(.*?)</title" + chr(92) + "s*>")} AS t FROM noiseless))"""


def describe(content: str) -> str:
    first = f"trim({ext(content, '^([^.!?]*)')}, ' ')"
    return f"CASE WHEN length({first}) > 200 THEN substr({first}, 1, 200) || '...' ELSE {first} || '.' END"


def clip(text: str, n: int) -> str:
    return f"CASE WHEN length({text}) > {n} THEN substr({text}, 1, {n}) || '...' ELSE {text} END"


DOCS = f"""{MAIN}, {WHOLE}, {TITLES},
docs AS (SELECT md5(url) AS doc_id, url, title,
  CASE WHEN main_text <> '' THEN main_text ELSE page_text END AS content,
  CASE WHEN main_text <> '' THEN {describe("main_text")} ELSE {clip("page_text", 200)} END AS short_description,
  length(html) AS content_length
  FROM mains JOIN wholes USING (page_id) JOIN titles USING (page_id))"""

# Own patterns here, so that a wrong one in the package shows.
GAP = "[ \\t\\r\\n\\f]"
OPENING = f"(?is)^<a{GAP}(?:[^>]*?{GAP})?href{GAP}*={GAP}*(\"[^\"]*\"|'[^']*'|[^ \\t\\r\\n\\f>]+)[^>]*>"
INSIDE = f"regexp_replace(regexp_replace(tag, {lit(OPENING)}, ''), '(?is)</a{GAP}*>.*$', '')"
LINKS = f"""{NOISELESS},
cuts AS (SELECT url AS src_url, list_filter(string_split(regexp_replace(q, '(?i)<a({GAP})', chr(1) || '<a\\1', 'g'), chr(1)),
  lambda x: regexp_matches(x, {lit(OPENING)})) AS pieces FROM noiseless),
tags AS (SELECT src_url, unnest(pieces) AS tag, generate_subscripts(pieces, 1) - 1 AS pos FROM cuts),
parts AS (SELECT src_url, pos, trim(regexp_extract(tag, {lit(OPENING)}, 1), {lit("\"'")}) AS rawhref,
  {sub(INSIDE, "(?s)<[a-zA-Z/!?][^>]*>", "")} AS inside FROM tags),
anchored AS (SELECT src_url, pos, trim({decode("rawhref")}, ' ') AS href, lower({collapse(decode("inside"))}) AS anchor FROM parts),
based AS (SELECT *, {ext("src_url", U.SCHEME)} AS bscheme, {ext("src_url", U.ORIGIN)} AS origin, {ext("src_url", U.PATH)} AS bpath,
  {ext("src_url", "^([^#]*)")} AS page, {ext("href", "^([^?#]*)")} AS hpath, {ext("href", "^[^?#]*(.*)$")} AS tail FROM anchored),
foldered AS (SELECT *, CASE WHEN {sub("bpath", "[^/]*$", "")} = '' THEN '/' ELSE {sub("bpath", "[^/]*$", "")} END AS folder FROM based),
targeted AS (SELECT *, CASE WHEN starts_with(href, '/') THEN hpath ELSE folder || hpath END AS full_path FROM foldered),
undotted AS (SELECT *, CASE WHEN regexp_matches(full_path, '/\\.{{1,2}}(/|$)') THEN
  list_reduce(string_split(regexp_replace(full_path, '^/', ''), '/'), lambda acc, x: CASE WHEN x = '..' THEN regexp_replace(acc, '/[^/]*$', '')
    WHEN x = '.' THEN acc ELSE acc || '/' || x END, '') || CASE WHEN regexp_matches(full_path, '/\\.{{1,2}}$') THEN '/' ELSE '' END
  ELSE full_path END AS clean_path FROM targeted),
resolved AS (SELECT src_url, pos, href, anchor, CASE WHEN href = '' THEN page WHEN regexp_matches(href, {lit(U.SCHEME)}) THEN href
  WHEN starts_with(href, '//') THEN bscheme || ':' || href WHEN starts_with(href, '?') THEN origin || bpath || href
  WHEN starts_with(href, '#') THEN page || href ELSE origin || clean_path || tail END AS target FROM undotted),
links AS (SELECT src_url, pos, href, anchor, {canonical("target")} AS dst_url, {any_term("anchor", U.PRIORITY_PHRASES)} AS is_priority FROM resolved)"""


def host(url: str) -> str:
    return ext(url, U.HOST)


def distinct_links(domains) -> str:
    allowed = any_term(host("dst_url"), domains) if domains else "true"
    return f"""first_links AS (SELECT src_url, dst_url, min(pos) AS pos, bool_or(is_priority) AS is_priority FROM links
  WHERE dst_url <> src_url AND {allowed} GROUP BY ALL)"""


TEXT_DOCS = f"text_docs AS (SELECT doc_id::VARCHAR AS document_id, {collapse('text')} AS content FROM documents)"
PAGE_DOCS = DOCS + ", page_docs AS (SELECT doc_id AS document_id, content FROM docs)"


def packed(source: str, size: int = 1000, overlap: int = 200, least: int = 100) -> str:
    """Greedy word packing as a recursion over the word offsets of each document."""
    stride = size - overlap
    return f"""bare_words AS (SELECT document_id, unnest(string_split(content, ' ')) AS w, generate_subscripts(string_split(content, ' '), 1) AS i
  FROM {source} WHERE content <> ''),
word_ends AS (SELECT document_id, i, length(w) AS n, (sum(length(w) + 1) OVER (PARTITION BY document_id ORDER BY i))::BIGINT - 1 AS e FROM bare_words),
cut_words AS (SELECT document_id, i, k, e - n + {stride} * k AS s, least(e - n + {stride} * k + {size}, e) AS e FROM
  (SELECT *, unnest(generate_series(0, greatest(0, ceil((n - {size}) / {float(stride)}))::BIGINT)) AS k FROM word_ends)),
word_lists AS (SELECT document_id, list(s ORDER BY i, k) AS ss, list(e ORDER BY i, k) AS es FROM cut_words GROUP BY document_id),
packs AS (SELECT document_id, 0 AS chunk_index, 1::BIGINT AS a, len(list_filter(es, lambda x: x <= ss[1] + {size})) AS b, ss, es FROM word_lists
  UNION ALL
  SELECT document_id, chunk_index + 1, na, len(list_filter(es, lambda x: x <= ss[na] + {size})), ss, es FROM
    (SELECT document_id, chunk_index, ss, es, least(greatest(1 + len(list_filter(ss, lambda x: x < es[b] - {overlap})),
       1 + len(list_filter(ss, lambda x: x < es[b + 1] - {size}))), b + 1) AS na FROM packs WHERE b < len(es))),
all_chunks AS (SELECT document_id, chunk_index, substr(content, ss[a] + 1, es[b] - ss[a]) AS content, ss[a] AS true_start,
  count(*) OVER (PARTITION BY document_id) AS total_chunks FROM packs JOIN {source} USING (document_id)),
chunks AS (SELECT document_id || '_chunk_' || chunk_index AS chunk_id, *, (coalesce(sum(length(content)) OVER (PARTITION BY document_id ORDER BY chunk_index
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_char FROM all_chunks WHERE length(content) >= {least})"""


def windows(source: str) -> str:
    return f"""all_windows AS (SELECT document_id, content AS whole, unnest(generate_series(0, greatest(0, ceil((length(content) - 1000) / 800.0))::BIGINT)) AS chunk_index
  FROM {source} WHERE content <> ''),
windows AS (SELECT document_id, document_id || '_chunk_' || chunk_index AS chunk_id, chunk_index, chunk_index * 800 AS true_start,
  substr(whole, chunk_index * 800 + 1, 1000) AS content, count(*) OVER (PARTITION BY document_id) AS total_chunks FROM all_windows)"""


def tokens(text: str) -> str:
    return f"list_filter(string_split_regex(lower({text}), {lit(X.TOKEN_BREAK)}), lambda t: t <> '')"


def hashed(name: str, source: str, key: str, text: str, dim: int = 384) -> str:
    """Sparse hash vectors: the 32-bit values, and those scaled to unit length again."""
    return f"""{name}_cells AS (SELECT {key} AS k, ('0x' || substr(md5(t), 1, 8))::BIGINT % {dim} AS dim, count(*) AS n FROM
  (SELECT {key}, unnest({tokens(text)}) AS t FROM {source}) GROUP BY ALL),
{name} AS (SELECT k, dim, CAST(n / sqrt(sum(n * n) OVER (PARTITION BY k)) AS FLOAT)::DOUBLE AS v FROM {name}_cells),
{name}_unit AS (SELECT k, dim, v / sqrt(sum(v * v) OVER (PARTITION BY k)) AS u FROM {name})"""


WORDS_OF = "list_filter(string_split({0}, ' '), lambda w: w <> '')"


def words(text: str) -> str:
    return WORDS_OF.format(collapse(text))


def estimate(text: str) -> str:
    return f"CAST(round(len({words(text)}) * 1.3::DOUBLE) AS INTEGER)"


QUESTION_LINES = f"""raw_lines AS (SELECT conv_id, turn, unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS raw,
  generate_subscripts(string_split_regex(text, '\\r\\n|\\r|\\n'), 1) - 1 AS line FROM conversations WHERE role = 'user'),
question_lines AS (SELECT conv_id, turn, line, {strip("raw")} AS question FROM raw_lines
  WHERE {strip("raw")} <> '' AND NOT starts_with({strip("raw")}, '#')),
questions AS (SELECT conv_id || '-' || turn || '-' || line AS question_id, question FROM question_lines)"""


def tidy(answer: str) -> str:
    text = strip(answer)
    for marker in X.PROMPT_MARKERS:
        text = strip(f"string_split({text}, {lit(marker)})[-1]")
    closed = f"regexp_replace({text}, '([^.!?])\\z', '\\1.')"
    return f"CASE WHEN {answer} IS NULL OR {strip(answer)} = '' THEN {lit(X.EMPTY_ANSWER)} ELSE {closed} END"


def ranked_hits(questions: str, depth: int, corpus: str = "chunks") -> str:
    """The exact best rows per question; pairs without a shared bucket score zero."""
    return f"""pair_sums AS (SELECT a.k AS question_id, b.k AS chunk_id, sum(a.u * b.u) AS s FROM qv_unit a JOIN cv_unit b USING (dim) GROUP BY ALL),
pair_scores AS (SELECT question_id, chunk_id, round(coalesce(s, 0), 8) AS score FROM (SELECT question_id FROM {questions}) CROSS JOIN (SELECT chunk_id FROM {corpus})
  LEFT JOIN pair_sums USING (question_id, chunk_id)),
hits AS (SELECT question_id, chunk_id, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS vector_rank FROM pair_scores
  QUALIFY vector_rank <= {depth})"""


BM25 = f"""chunk_tokens AS (SELECT chunk_id, {tokens("content")} AS ts FROM chunks),
corpus_stats AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avg_len FROM chunk_tokens),
term_df AS (SELECT term, count(*)::DOUBLE AS df FROM (SELECT unnest(list_distinct(ts)) AS term FROM chunk_tokens) GROUP BY term),
asked_terms AS (SELECT question_id, term, df FROM (SELECT question_id, unnest(list_distinct({tokens("question")})) AS term FROM asked) JOIN term_df USING (term)),
term_gains AS (SELECT h.question_id, h.chunk_id, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf,
  len(list_filter(ts, lambda t: t = term))::DOUBLE AS tf, len(ts) / avg_len AS rel FROM hits h JOIN asked_terms USING (question_id) JOIN chunk_tokens USING (chunk_id), corpus_stats),
gains AS (SELECT question_id, chunk_id, sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * rel))) AS g FROM term_gains GROUP BY ALL),
pair_ranks AS (SELECT h.question_id, h.chunk_id, vector_rank, CASE WHEN count(*) OVER (PARTITION BY h.question_id) > 1 THEN round(coalesce(g, 0), 8) ELSE h.score END AS score,
  row_number() OVER (PARTITION BY h.question_id ORDER BY round(coalesce(g, 0), 8) DESC, vector_rank) AS rank
  FROM hits h LEFT JOIN gains USING (question_id, chunk_id))"""


def searched(depth: int, asked: str = "SELECT question_id, question FROM questions", corpus: str = "chunks") -> str:
    return f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}, {QUESTION_LINES}, asked AS ({asked}),
{hashed("qv", "asked", "question_id", "question")}, {hashed("cv", "chunks", "chunk_id", "content")},
{ranked_hits("asked", depth, corpus)}"""


def context_ctes(source: str, budget: int, max_sources: int = 10) -> str:
    return f"""sourced AS (SELECT *, 'Source ' || rank || ' (' || coalesce(document_title, 'Unknown') || '): ' || content AS source_text FROM {source}),
running AS (SELECT *, (sum(length(source_text)) OVER (PARTITION BY question_id ORDER BY rank))::BIGINT AS running_length FROM sourced),
budgeted AS (SELECT *, rank <= {max_sources} AND (rank = 1 OR running_length <= {budget}) AS used FROM running),
contexts AS (SELECT question_id, string_agg(source_text, chr(10) || chr(10) ORDER BY rank) FILTER (used) AS context,
  list(content ORDER BY rank) FILTER (used) AS passages, list(chunk_id ORDER BY rank) FILTER (used) AS used_chunks, count(*) AS documents_retrieved FROM budgeted GROUP BY question_id)"""


def extract_ctes(source: str) -> str:
    """``extracts(question_id, extract)`` of ``source(question_id, question, passages)``."""
    overlap = f"len(list_intersect(asked_words, list_distinct({words('lower(s)')})))"
    holds = "len(list_filter(asked_words, lambda w: contains(lower(s), w))) > 0"
    return f"""fulls AS (SELECT question_id, list_distinct({words("lower(question)")}) AS asked_words,
  array_to_string(list_filter(passages, lambda p: length(p) > 20), ' ') AS full_text FROM {source}),
split_texts AS (SELECT *, list_filter(list_transform(string_split_regex(full_text, '[.!?]+'), lambda s: {strip("s")}), lambda s: length(s) > 15) AS sentences FROM fulls),
each_sentence AS (SELECT question_id, asked_words, unnest(sentences) AS s, generate_subscripts(sentences, 1) AS pos FROM split_texts),
rated AS (SELECT question_id, s, pos, {overlap} AS overlap FROM each_sentence WHERE {overlap} > 0 OR {holds}),
chosen AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY overlap DESC, pos) AS place FROM rated QUALIFY place <= 6),
picked AS (SELECT question_id, list(s ORDER BY place) AS picks FROM chosen GROUP BY question_id),
drafts AS (SELECT question_id, full_text, sentences, coalesce(picks, []) AS picks, array_to_string(coalesce(picks, []), '. ') AS joined,
  list_filter(sentences, lambda s: NOT list_contains(coalesce(picks, []), s))[1:3] AS more FROM split_texts LEFT JOIN picked USING (question_id)),
closed AS (SELECT *, CASE WHEN ends_with(joined, '.') THEN joined ELSE joined || '.' END AS first_text FROM drafts),
filled AS (SELECT *, first_text || ' ' || array_to_string(more, '. ') AS long_text FROM closed),
extracts AS (SELECT question_id, CASE WHEN full_text = '' THEN {lit(X.NO_TEXT_ANSWER)}
  WHEN len(picks) = 0 THEN array_to_string(sentences[1:2], '. ') || '.'
  WHEN length(first_text) < 200 AND len(sentences) > len(picks) AND len(more) > 0 THEN CASE WHEN ends_with(long_text, '.') THEN long_text ELSE long_text || '.' END
  ELSE first_text END AS extract FROM filled)"""


PASSAGES = f"""passages AS (SELECT conv_id::VARCHAR AS question_id, conv_id || '-' || turn AS chunk_id, length(text)::DOUBLE AS score, {collapse("text")} AS content,
  role AS document_title, role || '/' || conv_id AS document_url, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank
  FROM conversations WHERE role <> 'user' QUALIFY rank <= 12)"""
OPENERS = f"""openers AS (SELECT conv_id::VARCHAR AS question_id, {collapse("arg_min(text, turn)")} AS question FROM conversations WHERE role = 'user' GROUP BY conv_id)"""

EDGES = """edges AS (SELECT p.url AS src_url, r AS rank, q.url AS dst_url FROM pages p, (VALUES (1, 1), (2, 2), (3, -3)) steps(r, step)
  JOIN pages q ON q.page_id = p.page_id + step)"""
SEEDS = rf"""seeds AS (SELECT arg_min(url, page_id) AS url FROM pages GROUP BY regexp_replace({host("url")}, '^(www|blog|m)\.', ''))"""


def aliased(url: str) -> str:
    cases = " ".join(
        f"WHEN starts_with({url}, {lit(old)}) THEN {lit(new)} || substr({url}, {len(old) + 1})"
        for old, new in RULES.crawl.host_aliases
    )
    return f"CASE {cases} ELSE {url} END"


def crawlable(url: str, domains) -> str:
    endings = "|".join(e.replace(".", r"\.") for e in U.SKIPPED_ENDINGS)
    allowed = any_term(host(url), domains) if domains else "true"
    return (
        f"(starts_with(lower({ext(url, U.SCHEME)}), 'http') AND NOT regexp_matches(lower({ext(url, U.PATH)}), '(?:{endings})$') AND {allowed})"
    )


PATHS = RULES.crawl.primary_path_filters
DOMAINS = RULES.crawl.allowed_domains
SAME_SECTION = "(" + " OR ".join(f"(contains(lower(dst_url), {lit(p)}) AND contains(lower(src_url), {lit(p)}))" for p in PATHS) + ")"
DISCOVERED = f"""primaries AS (SELECT src_url AS start_url, dst_url AS url, rank, row_number() OVER (PARTITION BY src_url ORDER BY rank) AS n FROM edges
  WHERE {any_term("lower(dst_url)", PATHS)} AND src_url IN (SELECT url FROM seeds)),
children AS (SELECT p.start_url, e.dst_url AS url FROM primaries p JOIN edges e ON e.src_url = p.url WHERE p.n <= 10 AND e.rank <= 5 AND {SAME_SECTION}),
discovered AS (SELECT start_url, url, max(kind) AS kind FROM (SELECT start_url, url, 'primary' AS kind FROM primaries UNION ALL
  SELECT start_url, url, 'child' FROM children) GROUP BY ALL)"""
SEED_TABLE = f"""start_urls AS (SELECT DISTINCT u AS url FROM (SELECT {aliased("url")} AS u FROM seeds) WHERE {crawlable("u", DOMAINS)})"""


def fetch_log(source: str) -> str:
    return f"""fetches AS (SELECT *, CASE WHEN coalesce(length(html), 0) > 0 THEN 'success' ELSE 'failed' END AS status,
  CASE WHEN coalesce(length(html), 0) > 0 THEN NULL ELSE 'no content' END AS error_message,
  CASE WHEN coalesce(length(html), 0) > 0 THEN length(html) END AS content_length FROM {source})"""


# --- the queries --------------------------------------------------------------------------

ORACLES["page_scan"] = f"WITH {fetch_log('pages')} SELECT url, status, error_message, content_length FROM fetches"
ORACLES["seed_filter"] = f"""WITH {LINKS} SELECT url, starts_with(url, 'http://') OR starts_with(url, 'https://') AS accepted
FROM (SELECT url FROM pages UNION SELECT href FROM links)"""
ORACLES["question_source"] = f"WITH {QUESTION_LINES} SELECT * FROM question_lines"
FILE_NAME = f"translate({host('url')} || {ext('url', U.PATH)}, '/\\', '__')"
NAMED = f"SELECT md5(url) AS doc_id, {host('url')} AS host, CASE WHEN ends_with({FILE_NAME}, '.html') THEN {FILE_NAME} ELSE {FILE_NAME} || '.html' END AS file_name"
ORACLES["raw_page_name"] = f"{NAMED}, url FROM pages"
ORACLES["raw_page_sink"] = f"{NAMED}, length(html) AS n_chars, md5(html) AS html_md5 FROM pages"
ORACLES["crawl_report"] = f"""WITH {fetch_log('pages')} SELECT status AS section, url AS name, content_length::VARCHAR AS value FROM fetches
UNION ALL SELECT * FROM (VALUES ('config', 'max_depth', '5'), ('config', 'max_pages', '150'), ('config', 'allowed_domains', ''))
UNION ALL SELECT 'total', 'total_urls_attempted', count(*)::VARCHAR FROM fetches
UNION ALL SELECT 'total', 'successful_crawls', count(*) FILTER (status = 'success')::VARCHAR FROM fetches
UNION ALL SELECT 'total', 'failed_crawls', count(*) FILTER (status = 'failed')::VARCHAR FROM fetches"""
ORACLES["index_roundtrip"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}
SELECT chunk_id, document_id, start_char, start_char + length(content) AS end_char, 384 AS dimension FROM chunks"""
ORACLES["export_json"] = f"WITH {DOCS} SELECT doc_id, url, title, content FROM docs"
ORACLES["runlog_scan"] = """SELECT event_id, event_type AS operation, name, props ->> name AS value
FROM (SELECT *, unnest(json_keys(props)) AS name FROM events)"""

ORACLES["doc_id"] = "SELECT url, md5(url) AS doc_id FROM pages"
ORACLES["extract_main"] = f"WITH {MAIN} SELECT page_id, main_text FROM mains"
BARE_PAGES = "pages AS (SELECT page_id, url, regexp_replace(html, '(?i)</?(article|main)[^>]*>', '', 'g') AS html FROM main.pages)"
ORACLES["extract_without_article"] = f"WITH {BARE_PAGES}, {MAIN} SELECT page_id, main_text FROM mains"
# What the second and third article add; the menu before them adds nothing.
NESTED = MAIN.replace("CASE WHEN a <> '' THEN a ", "CASE WHEN a <> '' THEN a || ' second inner part' ")
ORACLES["extract_nested"] = f"WITH {NESTED} SELECT page_id, main_text FROM mains"
ORACLES["extract_fallback"] = f"WITH {NOISELESS}, {WHOLE} SELECT page_id, page_text, {clip('page_text', 200)} AS short_description FROM wholes"
ORACLES["clean_title"] = f"WITH {NOISELESS}, {TITLES} SELECT page_id, title FROM titles"
ORACLES["clean_text"] = f"SELECT doc_id, {clean('text')} AS cleaned FROM documents"
ORACLES["short_description"] = f"SELECT doc_id, {describe('c')} AS short_description FROM (SELECT doc_id, {collapse('text')} AS c FROM documents)"
ORACLES["build_documents"] = f"WITH {DOCS} SELECT * FROM docs"
ORACLES["url_resolve"] = f"WITH {LINKS} SELECT src_url, pos, href, dst_url FROM links"
ORACLES["url_canonical"] = f"SELECT page_id, {canonical('url')} AS canonical_url FROM pages"
ORACLES["host_alias"] = f"SELECT page_id, {aliased('url')} AS url FROM pages"
ORACLES["extract_links"] = f"WITH {LINKS} SELECT src_url, pos, href, anchor FROM links"
ORACLES["link_priority"] = f"""WITH {LINKS}, lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT anchor, {any_term("anchor", U.PRIORITY_PHRASES)} AS is_priority, count(*) AS n FROM (SELECT anchor FROM links UNION ALL SELECT lower({collapse("line")}) FROM lines) GROUP BY ALL"""
ORACLES["chunk_words"] = f"WITH RECURSIVE {TEXT_DOCS}, {packed('text_docs')} SELECT chunk_id, content, true_start, chunk_index, total_chunks FROM chunks"
ORACLES["chunk_fixed"] = f"WITH {TEXT_DOCS}, {windows('text_docs')} SELECT document_id, chunk_index, content, true_start FROM windows"
ORACLES["chunk_meta"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}
SELECT chunk_id, title AS document_title, url AS document_url, chunk_index, total_chunks FROM chunks JOIN docs ON doc_id = document_id"""
KEPT = "length(trim(content, ' ')) >= 100"
ORACLES["chunk_min"] = f"WITH {TEXT_DOCS}, {windows('text_docs')} SELECT chunk_id, length(content) AS n_chars, total_chunks FROM windows WHERE {KEPT}"
ORACLES["chunk_offsets"] = f"WITH RECURSIVE {TEXT_DOCS}, {packed('text_docs')} SELECT chunk_id, start_char, start_char + length(content) AS end_char, true_start FROM chunks"
ORACLES["token_count"] = f"SELECT doc_id, len({words('text')}) AS n_words FROM documents"
ORACLES["token_estimate"] = f"SELECT doc_id, {estimate('text')} AS n_tokens FROM documents"
ORACLES["post_process"] = f"""SELECT conv_id, turn, kind, {tidy("raw")} AS answer FROM (SELECT conv_id, turn, 'plain' AS kind, text AS raw FROM conversations
UNION ALL SELECT conv_id, turn, 'marked', ' Context: ' || role || ' Question: ' || role || ' Answer: ' || text FROM conversations
UNION ALL SELECT conv_id, turn, 'ended', text || ' Answer: ' FROM conversations)"""

REL = RULES.relevance
ORACLES["relevance_filter"] = f"""WITH {DOCS} SELECT doc_id, url FROM docs WHERE {any_term("lower(url)", REL.url_terms)}
OR {count_terms("lower(content)", REL.content_terms)} >= 2 OR {count_terms("lower(content)", REL.brand_terms)} >= 1"""
ORACLES["url_valid"] = f"WITH {LINKS} SELECT url FROM (SELECT url FROM pages UNION SELECT dst_url FROM links) WHERE {crawlable('url', DOMAINS)}"
ORACLES["domain_filter"] = f"""SELECT url, {any_term(host("url"), ("th.example", "tion"))} AS by_substring,
lower({host("url")}) = 'example.com' OR ends_with(lower({host("url")}), '.example.com') AS by_suffix FROM pages"""
ORACLES["primary_links"] = f"WITH {LINKS} SELECT url FROM (SELECT {canonical('url')} AS url FROM pages UNION SELECT dst_url FROM links) WHERE {any_term('lower(url)', PATHS)}"
ORACLES["section_children"] = f"WITH {EDGES} SELECT src_url, dst_url FROM edges WHERE {SAME_SECTION}"
ORACLES["valid_vectors"] = "SELECT vec_id FROM embeddings WHERE len(embedding) = 64"
ORACLES["metadata_filter"] = """SELECT doc_id, lang, source, n_chars FROM documents LEFT JOIN labels USING (doc_id)
WHERE lang IN ('en', 'fr') AND n_chars >= 200 AND n_chars < 5000 AND quality = 1"""
ORACLES["docid_filter"] = f"""WITH {TEXT_DOCS}, {windows("text_docs")} SELECT chunk_id, document_id FROM windows
WHERE {KEPT} AND document_id IN (SELECT doc_id::VARCHAR FROM labels)"""
ORACLES["point_lookup"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")} SELECT chunk_id, url AS document_url, c.content FROM chunks c JOIN docs ON doc_id = document_id
WHERE chunk_id IN (SELECT md5(url) || '_chunk_0' FROM pages)"""
ORACLES["chunk_doc_join"] = f"""WITH {TEXT_DOCS}, {windows("text_docs")} SELECT chunk_id, document_id, quality, toxic FROM windows
LEFT JOIN labels ON doc_id::VARCHAR = document_id WHERE {KEPT}"""

VEC = "vecs AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
COS = "round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 8)"
DIST = "list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def knn(score: str, k: int, where: str = "true") -> str:
    return f"""WITH {VEC}, scored AS (SELECT a.vec_id AS question_id, b.vec_id AS vec_id, {score} AS score FROM vecs a, vecs b WHERE {where})
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vec_id) AS vector_rank FROM scored QUALIFY vector_rank <= {k}"""


ORACLES["knn_cosine"] = ORACLES["knn_blocks"] = knn(COS, 10)
ORACLES["knn_l2"] = knn(f"round(1 / (1 + {DIST}), 8)", 10)
ORACLES["similar_chunks"] = f"SELECT question_id AS reference_id, vec_id, score, vector_rank AS rank FROM ({knn(COS, 5, 'a.vec_id <> b.vec_id')})"
ORACLES["filtered_knn"] = knn(COS, 5, "b.label BETWEEN 2 AND 6")
ORACLES["overfetch_knn"] = f"{searched(15)} SELECT * FROM hits"
LONG = "(SELECT chunk_id FROM chunks JOIN docs ON doc_id = document_id WHERE content_length >= 4000)"
ORACLES["filtered_retrieve"] = f"{searched(15, corpus=LONG)}, {BM25} SELECT question_id, rank, chunk_id, score FROM pair_ranks WHERE rank <= 5"
ORACLES["post_filtered_retrieve"] = f"""{searched(15)}, {BM25} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank, chunk_id, score
FROM pair_ranks WHERE rank <= 12 AND chunk_id IN {LONG} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY rank) <= 3"""
ORACLES["rerank_bm25"] = f"{searched(15)}, {BM25} SELECT question_id, rank, chunk_id, score, vector_rank FROM pair_ranks WHERE rank <= 5"
ORACLES["retrieve"] = f"""{searched(15)}, {BM25} SELECT question_id, rank, chunk_id, score, title AS doc_title, url AS doc_url FROM pair_ranks
JOIN chunks USING (chunk_id) LEFT JOIN docs ON doc_id = document_id WHERE rank <= 5"""
# what the last segment replaces is the same text, so the corpus is that of one segment
ORACLES["retrieve_segments"] = ORACLES["retrieve"]
ORACLES["search_documents"] = f"""{searched(15)}, {BM25}, firsts AS (SELECT question_id, document_id AS doc_id, min(rank) AS first_rank FROM pair_ranks
JOIN chunks USING (chunk_id) WHERE rank <= 10 GROUP BY ALL)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY first_rank) AS position, doc_id, url, first_rank FROM firsts JOIN docs USING (doc_id)"""

ORACLES["frontier_step"] = f"""WITH {EDGES}, {SEEDS}, {SEED_TABLE} SELECT DISTINCT dst_url AS url FROM edges WHERE src_url IN (SELECT url FROM start_urls)
AND {crawlable("dst_url", DOMAINS)} AND dst_url NOT IN (SELECT url FROM start_urls)"""


def reach(edges: str, starts: str, domains, depth: int) -> str:
    return f"""walk AS (SELECT url, 0 AS depth FROM {starts} UNION SELECT e.dst_url, w.depth + 1 FROM walk w JOIN {edges} e ON e.src_url = w.url
  WHERE w.depth < {depth} AND {crawlable("e.dst_url", domains)}),
reached AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)"""


STATUS = "CASE WHEN url IN (SELECT url FROM pages) THEN 'success' ELSE 'failed' END AS status"
ORACLES["crawl_bfs"] = f"""WITH RECURSIVE {EDGES}, {SEEDS}, {SEED_TABLE}, {reach("edges", "start_urls", DOMAINS, 5)}
SELECT url, depth, {STATUS} FROM reached QUALIFY row_number() OVER (ORDER BY depth, url) <= 80"""
ORACLES["crawl_real_links"] = f"""WITH RECURSIVE {LINKS}, {distinct_links(())}, capped AS (SELECT src_url, dst_url FROM first_links
  QUALIFY row_number() OVER (PARTITION BY src_url ORDER BY is_priority DESC, pos) <= 15), start_urls AS (SELECT url FROM pages WHERE {crawlable("url", ())}),
{reach("capped", "start_urls", (), 2)} SELECT url, depth, {STATUS} FROM reached"""
ORACLES["discover_two_hop"] = f"WITH {EDGES}, {SEEDS}, {DISCOVERED} SELECT start_url, url, kind FROM discovered"
ORACLES["seed_union"] = f"WITH {EDGES}, {SEEDS}, {DISCOVERED} SELECT url FROM seeds UNION SELECT url FROM discovered"
ORACLES["link_fanout"] = f"""WITH {LINKS}, {distinct_links(())} SELECT src_url, row_number() OVER (PARTITION BY src_url ORDER BY is_priority DESC, pos) AS rank, dst_url
FROM first_links QUALIFY rank <= 5"""
ORACLES["distinct_links"] = f"WITH {LINKS}, {distinct_links(DOMAINS)} SELECT * FROM first_links"

ORACLES["embed_hash"] = f"WITH {hashed('v', 'documents', 'doc_id', 'text')} SELECT k AS doc_id, dim, round(v, 6) AS value FROM v"
ORACLES["embed_query"] = f"WITH {QUESTION_LINES}, {hashed('v', 'questions', 'question_id', 'question')} SELECT k AS question_id, dim, round(v, 6) AS value FROM v"
ORACLES["cosine_pairs"] = f"WITH {VEC} SELECT a.vec_id, {COS} AS cosine, 0.0::DOUBLE AS with_zero FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1"
ORACLES["normalise"] = f"""WITH scaled AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3 + 1) AS v FROM embeddings)
SELECT vec_id, unnest(generate_series(0, len(v) - 1)) AS dim, round(unnest(v) / sqrt(list_dot_product(v, v)), 8) AS value FROM scaled"""
ORACLES["embedding_stats"] = f"""WITH {VEC}, norms AS (SELECT len(e) AS d, sqrt(list_dot_product(e, e)) AS n FROM vecs)
SELECT count(*) AS count, max(d) AS dimension, round(avg(n), 6) AS mean_norm, round(stddev_pop(n), 6) AS std_norm FROM norms"""
ORACLES["embedding_dim_stats"] = f"""WITH {VEC}, long AS (SELECT unnest(generate_series(0, len(e) - 1)) AS dim, unnest(e) AS v FROM vecs)
SELECT dim, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std FROM long GROUP BY dim"""

BUDGET = context_ctes("passages", 1500)
ORACLES["context_budget"] = f"WITH {PASSAGES}, {BUDGET} SELECT question_id, rank, running_length, used FROM budgeted"
ORACLES["context_text"] = f"WITH {PASSAGES}, {BUDGET} SELECT question_id, context, len(used_chunks) AS n_sources, documents_retrieved FROM contexts"
HEAD, REST = PROMPT.split("{context}")
MIDDLE, TAIL = REST.split("{question}")
ORACLES["prompt_table"] = f"""WITH {PASSAGES}, {OPENERS}, {BUDGET} SELECT question_id, {lit(HEAD)} || context || {lit(MIDDLE)} || question || {lit(TAIL)} AS prompt
FROM openers JOIN contexts USING (question_id)"""
ORACLES["question_metrics"] = f"""WITH {PASSAGES}, {OPENERS}, {BUDGET} SELECT question_id, documents_retrieved, len(used_chunks) AS documents_used,
{estimate("question || ' ' || context")} AS input_tokens, {estimate("question")} AS output_tokens, 0.0::DOUBLE AS estimated_cost FROM openers JOIN contexts USING (question_id)"""
JOINED = f"""replies AS (SELECT question_id, [string_agg(content, ' ' ORDER BY rank)] AS passages FROM passages GROUP BY question_id),
asked_replies AS (SELECT * FROM openers JOIN replies USING (question_id))"""
ORACLES["sentence_rank"] = f"""WITH {PASSAGES}, {OPENERS}, {JOINED}, {extract_ctes("asked_replies")}
SELECT question_id, place, pos - 1 AS position, overlap, s AS sentence FROM chosen"""
ORACLES["extractive_answer"] = f"""WITH {PASSAGES}, {OPENERS}, {BUDGET}, asked_contexts AS (SELECT * FROM openers JOIN contexts USING (question_id)),
{extract_ctes("asked_contexts")} SELECT question_id, {tidy("extract")} AS answer FROM extracts"""
ORACLES["source_snippets"] = f"""WITH {PASSAGES} SELECT question_id, rank, CASE WHEN turn < 2 THEN 'Untitled' ELSE document_title END AS title, document_url AS url,
{clip("content", 200)} AS snippet FROM passages WHERE rank <= 3"""


def answered(depth: int, top: int) -> str:
    """Answers of the distinct question texts, keyed by the text."""
    distinct = "SELECT md5(question) AS question_id, any_value(question) AS question FROM questions GROUP BY question"
    return f"""{searched(depth, distinct)}, {BM25},
retrieved AS (SELECT question_id, rank, chunk_id, score, content, title AS document_title FROM pair_ranks JOIN
  (SELECT chunk_id, document_id, content FROM chunks) USING (chunk_id) JOIN (SELECT doc_id, title FROM docs) ON doc_id = document_id WHERE rank <= {top}),
{context_ctes("retrieved", 4000)}, asked_contexts AS (SELECT * FROM asked JOIN contexts USING (question_id)), {extract_ctes("asked_contexts")},
finals AS (SELECT question AS asked_text, {tidy("extract")} AS answer, context, used_chunks, documents_retrieved FROM asked_contexts JOIN extracts USING (question_id))"""


ORACLES["answer_questions"] = f"""{answered(15, 5)} SELECT question_id, answer, array_to_string(used_chunks, ',') AS sources, false AS no_results_found,
  length(context) AS context_length, documents_retrieved, len(used_chunks) AS documents_used, {estimate("question || ' ' || context")} AS input_tokens, {estimate("answer")} AS output_tokens
FROM questions JOIN finals ON asked_text = question
UNION ALL SELECT 'blank-' || conv_id || '-' || turn, {lit(X.NO_HIT_ANSWER)}, '', true, 0, 0, 0, NULL, NULL FROM conversations"""
ORACLES["batch_answers"] = f"""{answered(15, 12)} SELECT question_id, answer, documents_retrieved, len(used_chunks) AS documents_used, NULL::VARCHAR AS error
FROM questions JOIN finals ON asked_text = question"""
ORACLES["batch_summary"] = """SELECT count(*) AS total_questions, count(*) FILTER (event_type <> 'error') AS successful_questions,
count(*) FILTER (event_type = 'error') AS failed_questions, true AS concurrent_processing, round(sum(value), 4) AS total_processing_time,
round(avg(value), 6) AS average_time_per_question FROM events"""
ORACLES["group_summary"] = f"""WITH joined AS (SELECT source, string_agg(text, ' ' ORDER BY doc_id) AS t FROM documents GROUP BY source),
cut AS (SELECT source, {clip("t", 1000)} AS t FROM joined),
pieces AS (SELECT source, list_filter(list_transform(string_split(t, '.')[1:3], lambda s: {strip("s")}), lambda s: s <> '') AS ps FROM cut)
SELECT source, CASE WHEN len(ps) = 0 THEN '' ELSE array_to_string(ps, '. ') || '.' END AS summary FROM pieces"""

ORACLES["crawl_metrics"] = f"""WITH {LINKS}, every AS (SELECT url, html FROM pages UNION ALL SELECT DISTINCT dst_url, NULL FROM links), {fetch_log("every")}
SELECT count(*) FILTER (status = 'success') AS pages_scraped, count(*) FILTER (status = 'failed') AS pages_failed, count(*) AS total_pages_attempted,
sum(content_length)::BIGINT AS total_content_length, count(error_message) AS error_count, round(count(*) FILTER (status = 'success') / count(*), 8) AS success_rate,
round(avg(length(url) / 10::DOUBLE) FILTER (status = 'success'), 6) AS average_response_time FROM fetches"""
ORACLES["ingest_metrics"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")} SELECT count(*) AS pages_scraped, 0 AS pages_failed, (SELECT count(*) FROM chunks) AS total_chunks_created,
sum(len({words("content")}))::BIGINT AS total_tokens_processed, 0.0::DOUBLE AS average_scraping_time, 0 AS error_count FROM docs"""
FIGURES = "(SELECT count(*) FROM chunks) AS num_vectors, (SELECT count(*) FROM docs) AS num_documents"
ORACLES["index_stats"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")} SELECT {FIGURES}, 384 AS dimension, 'exact' AS index_type,
'cosine' AS similarity_metric, (SELECT count(*) FROM chunks) AS index_size"""
SETTING_ROWS = ", ".join(f"({lit(k)}, {lit(v)})" for k, v in PLAIN.flat())
ORACLES["system_stats"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}, figures AS (SELECT {FIGURES})
SELECT * FROM (VALUES {SETTING_ROWS}) settings(name, value)
UNION ALL SELECT 'index.num_vectors', num_vectors::VARCHAR FROM figures UNION ALL SELECT 'index.num_documents', num_documents::VARCHAR FROM figures
UNION ALL SELECT 'index.dimension', '384' UNION ALL SELECT 'index.index_type', 'exact' UNION ALL SELECT 'index.similarity_metric', 'cosine'
UNION ALL SELECT 'index.index_size', num_vectors::VARCHAR FROM figures"""
ORACLES["keyword_hits"] = f"SELECT doc_id, {count_terms('lower(text)', REL.content_terms)} AS keyword_hits FROM documents"
ORACLES["chunks_per_document"] = f"""WITH RECURSIVE {TEXT_DOCS}, {packed("text_docs")}
SELECT document_id, count(*) AS kept_chunks, max(total_chunks) AS total_chunks FROM chunks GROUP BY document_id"""

ORACLES["upsert_documents"] = """SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN lang ELSE quality || '/' || toxic END AS state FROM documents d LEFT JOIN labels l USING (doc_id)"""
ORACLES["latest_by_text"] = """SELECT md5(text) AS content_id, doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) = 1"""
ORACLES["rebuild_index"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}, {hashed("v", "chunks", "chunk_id", "content", 64)}
SELECT k AS chunk_id, dim, round(v, 6) AS value FROM v"""
ORACLES["reingest_latest"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")},
counted AS (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id)
SELECT doc_id, d.url, md5(CASE WHEN page_id % 3 = 1 THEN regexp_replace(html, '(?i)<body', {lit("<body data-again='1'")}, 'g') ELSE html END) AS html_md5,
  coalesce(n, 0) AS n_chunks FROM docs d JOIN pages p ON p.url = d.url LEFT JOIN counted ON document_id = doc_id"""
ORACLES["incremental_ingest"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")} SELECT chunk_id, url AS document_url, chunk_index, total_chunks, c.content
FROM chunks c JOIN docs ON doc_id = document_id"""
ORACLES["runlog_rollup"] = """SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS window_start, event_type AS operation, count(*) AS n
FROM events GROUP BY ALL"""
ORACLES["runlog_sink"] = """WITH e AS (SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
  CASE WHEN event_type = 'error' THEN 'batch_query' ELSE 'ingestion' END AS operation, event_type AS status, props FROM events)
SELECT timestamp, operation, status, name, props ->> name AS value FROM (SELECT *, unnest(json_keys(props)) AS name FROM e)
UNION ALL SELECT timestamp, operation, status, 'results_returned', '2' FROM e WHERE operation = 'batch_query'"""
# What comes after the later quarters have set the watermark is lost, and windows that it hasn't passed stay open.
ORACLES["runlog_stream"] = """WITH ends AS (SELECT epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, max(ts) - INTERVAL '10 minutes' AS passed FROM events),
e AS (SELECT events.*, passed, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS w FROM events, ends
  WHERE NOT (epoch_us(ts) * 2 < a + b AND event_id % 5 = 0))
SELECT strftime(w, '%Y-%m-%d %H:%M') AS window_start, CASE WHEN event_type = 'error' THEN 'batch_query' ELSE 'ingestion' END AS operation,
  event_type AS status, count(*) AS n FROM e WHERE w + INTERVAL '6 hours' <= passed GROUP BY ALL"""
ORACLES["incremental_batches"] = ORACLES["reingest_latest"].replace("page_id % 3 = 1", "page_id % 5 = 0")
ORACLES["embed_model"] = """SELECT doc_id, dim, round(value, 6) AS value FROM (SELECT doc_id, unnest(range(8)) AS dim,
  unnest(list_transform(['a', 'e', 'i', 'n', 'r', 's', 't', ' '], lambda c: (length(coalesce(text, '')) - length(replace(coalesce(text, ''), c, '')))::DOUBLE)) AS value
  FROM documents) WHERE value <> 0"""
ORACLES["rerank_isolated"] = f"""{searched(15)}, told AS (SELECT h.question_id, h.chunk_id, h.vector_rank, length(question) % 7 = 0 AS failed,
  CASE WHEN length(question) % 7 = 0 THEN NULL ELSE -abs(length(question) * 10 - length(content))::DOUBLE END AS pair_score
  FROM hits h JOIN questions USING (question_id) JOIN chunks USING (chunk_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pair_score DESC NULLS LAST, vector_rank) AS rank FROM told)
SELECT question_id, rank, chunk_id, vector_rank, pair_score, CASE WHEN failed THEN 'cannot score this question' END AS error FROM placed WHERE rank <= 5"""
ORACLES["stored_vectors"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}, {hashed("v", "chunks", "chunk_id", "content")}
SELECT k AS chunk_id, dim, round(v, 6) AS value FROM v"""
ORACLES["export_chunks"] = f"""WITH RECURSIVE {PAGE_DOCS}, {packed("page_docs")}
SELECT document_id, chunk_id, content, chunk_index, total_chunks, true AS iso_time FROM chunks"""
ORACLES["interleaved_writers"] = ORACLES["reingest_latest"].replace("page_id % 3 = 1", "page_id % 3 > 0")
