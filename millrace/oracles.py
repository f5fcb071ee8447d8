"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

#: Lines with page chrome, one for each rule and some that must stay, and what is to be left of them.
BOILERPLATE = (
    ("Read more ✕ (https://whatsapp.com/channel/x) today", "Read more today"),
    ("See https://t.me/some_channel for news", "See for news"),
    ("Send (https://api.com/send?text=a) now", "Send (https://api.com/send?text=a) now"),
    ("Send (https://.com/send?text=a) now", "Send now"),
    ("Rates (source: https://schemesinindia.in/a/b) apply", "Rates apply"),
    ("Link https%3A%2F%2Fschemesinindia.in%2Fa) end", "Link end"),
    ("Box WhatsApp(/a) Telegram(/b) end", "Bo end"),
    ("Join our Telegram group", "Join our group"),
    ("Share on WhatsApp", "Share on"),
    ("Share onWhatsApp", ""),
    ("Help others find this scheme now", "now"),
    ("Tap a document to mark it as ready · Progress saved automatically", ""),
    ("schemesinindia.in — All Indian Government Schemes list", "list"),
    ("3/7 documents ready", ""),
    ("SG Written & fact-checked by the desk How we verify scheme facts (here) tail", "tail"),
    ("by Sanket Ghogare (a) · Editor, Schemes In India How we verify scheme facts (b) tail", "tail"),
    ("Sanket Ghogare (a) Editor Schemes In India tail", "tail"),
    ("How we verify scheme facts (c) tail", "tail"),
    ("Sanket Ghogare, Editor (d) tail", "tail"),
    ("Name · Last verified: 3 May 2024 · rest", "Name · rest"),
    ("SG Written and factchecked tail", "tail"),
    ("Last Verified 3 May 2024 tail", "tail"),
    ("Last Verified ३ May २०२४ tail", "tail"),
    ("A ✕ B", "A B"),
    ("Official link: https://example.gov.in/apply", "Official link: https://example.gov.in/apply"),
    ("- | plain text | -", "plain text"),
    ("  spaced\tout   text  ", "spaced out text"),
)
BOILERPLATE_LINES = tuple(line for line, _ in BOILERPLATE)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SQUEEZE = "trim(regexp_replace(raw, '[ \\t]+', ' ', 'g'))"
#: The different lines of cleaned documents: clean_lines(doc_id, pos, line).
CLEAN = f"""
raw_lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
trimmed AS (SELECT doc_id, pos, trim({_SQUEEZE}, ' |-') AS line FROM raw_lines),
clean_lines AS (SELECT doc_id, min(pos) AS pos, line FROM trimmed WHERE line <> '' GROUP BY doc_id, line)
"""
#: The same of documents that have one line of page chrome after each of theirs, by id: chrome_lines(doc_id, pos, line).
CHROME = f"""{CLEAN},
left_over AS (SELECT doc_id, list_extract([{", ".join(q(x) for _, x in BOILERPLATE)}], CAST(1 + doc_id % {len(BOILERPLATE)} AS INTEGER)) AS line FROM documents),
with_chrome AS (SELECT doc_id, 2 * pos AS pos, line FROM trimmed UNION ALL SELECT doc_id, 2 * min(pos) + 1, line FROM raw_lines JOIN left_over USING (doc_id) GROUP BY ALL),
chrome_lines AS (SELECT doc_id, min(pos) AS pos, line FROM with_chrome WHERE line <> '' GROUP BY doc_id, line)
"""
_SENTINEL = r"string_split(regexp_replace(line, '([.!?]+)(\s|$)', '\1' || chr(1) || '\2', 'g'), chr(1))"
#: Units of cleaned documents: units(doc_id, line_no, unit_no, unit).
UNITS_OF_LINES = rf"""
numbered AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS line_no, line FROM clean_lines),
parts AS (
  SELECT doc_id, line_no, list_filter(list_transform(
    CASE WHEN regexp_matches(line, '^(?:[-*•]|\p{{Nd}}+[.)])\s+') THEN [line] ELSE {_SENTINEL} END, lambda x: trim(x)), lambda x: x <> '') AS u
  FROM numbered
),
units AS (SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, CAST(generate_subscripts(u, 1) - 1 AS INTEGER) AS unit_no, unnest(u) AS unit FROM parts)
"""
UNITS = f"{CLEAN}, {UNITS_OF_LINES}"
_WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"


def words(expr: str) -> str:
    return _WORDS.format(expr)


_URL = "'https://' || source || '/' || doc_id"
#: Chunks of such units with the default limits: chunks(doc_id, chunk_index, text).
CHUNKS_OF_UNITS = rf"""
split_units AS (SELECT *, {words("unit")} AS ws FROM units),
sized AS (
  SELECT doc_id, line_no, unit_no, 0 AS word_no, unit, len(ws) AS w FROM split_units WHERE len(ws) <= 400
  UNION ALL
  SELECT doc_id, line_no, unit_no, generate_subscripts(ws, 1) AS word_no, unnest(ws), 1 FROM split_units WHERE len(ws) > 400
),
placed AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, unit_no, word_no) AS k, unit, w FROM sized
),
cum AS (
  SELECT doc_id, k, CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS c FROM placed
  UNION ALL SELECT DISTINCT doc_id, 0, 0 FROM placed
),
ends AS (
  SELECT s.doc_id, s.k AS s, max(e.k) AS e FROM cum AS s JOIN cum AS e ON e.doc_id = s.doc_id AND e.k > s.k AND e.c - s.c <= 400 GROUP BY ALL
),
nexts AS (
  SELECT x.doc_id, x.s, x.e, min(t.k) AS nxt FROM ends AS x JOIN cum AS ce ON ce.doc_id = x.doc_id AND ce.k = x.e
  JOIN cum AS t ON t.doc_id = x.doc_id AND t.k > x.s AND t.k <= x.e AND ce.c - t.c <= 64 GROUP BY ALL
),
lasts AS (SELECT doc_id, max(k) AS n FROM cum GROUP BY doc_id),
walk AS (
  SELECT doc_id, s, e, nxt, 0 AS i FROM nexts WHERE s = 0
  UNION ALL
  SELECT n.doc_id, n.s, n.e, n.nxt, w.i + 1 FROM walk AS w JOIN lasts AS l ON l.doc_id = w.doc_id JOIN nexts AS n ON n.doc_id = w.doc_id AND n.s = w.nxt
  WHERE w.e < l.n
),
chunks AS (
  SELECT w.doc_id, w.i AS chunk_index, trim(regexp_replace(string_agg(p.unit, ' ' ORDER BY p.k), '[ \t]+', ' ', 'g'), ' |-') AS text
  FROM walk AS w JOIN placed AS p ON p.doc_id = w.doc_id AND p.k > w.s AND p.k <= w.e GROUP BY w.doc_id, w.i
)
"""
#: Chunks of documents.
CHUNKS = f"""{UNITS}, {CHUNKS_OF_UNITS},
full_chunks AS (
  SELECT doc_id, substr(sha256({_URL}), 1, 12) || '-' || printf('%04d', chunk_index) AS chunk_id, chunk_index, c.text,
    len({words("c.text")}) AS n, sha256(c.text) AS content_hash
  FROM chunks AS c JOIN (SELECT doc_id, source FROM documents) AS d USING (doc_id)
)
"""
#: Documents as chunks with what is wrong with them.
ISSUES = f"""
hashed AS (SELECT doc_id, text, len({words("text")}) AS n, count(*) OVER (PARTITION BY sha256(text)) AS same FROM documents),
issues AS (
  SELECT doc_id, list_filter([CASE WHEN same > 1 THEN 'duplicate_text' END, CASE WHEN text = '' THEN 'empty_text' END,
    CASE WHEN text = '' THEN 'missing_metadata' END, CASE WHEN n > 512 THEN 'too_long' END, CASE WHEN n < 20 THEN 'too_short' END],
    lambda x: x IS NOT NULL) AS issues FROM hashed
)
"""
_UNESCAPE = "replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#x27;', ''''), '&amp;', '&')"
#: The same references in text, where the semicolon may be missing, as at the end of titles that were cut in the middle of
#: one; ``&#x2`` is a reference to a character that HTML leaves out.
_DECODE = "{0}"
for _pattern, _to in ((r"&lt;?", "<"), (r"&gt;?", ">"), (r"&quot;?", '"'), (r"&#x27(?:;|([^0-9A-Fa-f;]|$))", r"''\1"), (r"&#x2(?:;|([^0-9A-Fa-f;]|$))", r"\1"), (r"&amp;?", "&")):
    _DECODE = f"regexp_replace({_DECODE}, '{_pattern}', '{_to}', 'g')"
#: Anchors of pages: anchors(url, pos, href, anchor_text, root).
ANCHORS = rf"""
found AS (SELECT url, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS a FROM pages),
each_anchor AS (SELECT url, CAST(generate_subscripts(a, 1) - 1 AS INTEGER) AS pos, unnest(a) AS tag FROM found),
anchors AS (
  SELECT url, pos, {_UNESCAPE.format("regexp_extract(tag, 'href=\"([^\"]*)\"', 1)")} AS href,
    trim({_UNESCAPE.format("regexp_extract(tag, '>([^<]*)<', 1)")}) AS anchor_text, regexp_extract(url, '^[a-z]+://[^/?#]*') AS root
  FROM each_anchor
)
"""
_DOT = "list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"
NEIGHBOURS = f"""
pairs AS (
  SELECT q.vec_id AS query_id, q.label AS query_label, e.vec_id, e.label, {_DOT} AS score
  FROM embeddings AS q, embeddings AS e WHERE q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id
),
best AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs) WHERE rank <= 5
)
"""
_FOLD = "lower(replace({0}, 'ß', 'ss'))"
CASES = f"""
cases AS (
  SELECT CAST(item_id AS VARCHAR) AS id, ['src' || (item_id % 20), 'src' || ((item_id + 7) % 20)] AS sources, string_split(trim(text), ' ')[1:2] AS terms
  FROM benchmark
),
met AS (
  SELECT c.id, contains({_FOLD.format("d.text")}, {_FOLD.format("c.terms[1]")}) AND contains({_FOLD.format("d.text")}, {_FOLD.format("c.terms[2]")}) AS ev
  FROM cases AS c JOIN documents AS d ON list_contains(c.sources, d.source)
),
rows_ AS (
  SELECT c.id, count(m.id) > 0 AS source_url_found, coalesce(bool_or(m.ev), false) AS evidence_found,
    count(m.id) AS source_chunk_count, count(*) FILTER (coalesce(m.ev, false)) AS evidence_chunk_count
  FROM cases AS c LEFT JOIN met AS m ON m.id = c.id GROUP BY c.id
)
"""
CITED = f"""
cited AS (
  SELECT vec_id AS position, embedding, lang AS title, source AS source_url, text, 'v' || vec_id AS chunk_id,
    CASE WHEN vec_id % 2 = 0 THEN '' ELSE 'part ' || vec_id END AS section
  FROM embeddings LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) AS d ON doc_id = vec_id
),
asked AS (SELECT *, list_inner_product(list_transform(range(64), lambda i: CASE WHEN i % 2 = 0 THEN 0.125::DOUBLE ELSE -0.125::DOUBLE END), CAST(embedding AS DOUBLE[])) AS score FROM cited),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY score DESC, position) AS rank FROM asked) WHERE rank <= 20)
"""
#: Parts of pages, of the shape that the test tables have: one article of a heading and paragraphs, some left open.
#: A paragraph's text is all up to its own end tag, or to the end of the article: body(page_id, k, lines).
PAGES = rf"""
inner_ AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<article>(.*)</article>', 1, 's') AS art,
  regexp_extract(html, '</nav>(.*)<footer>', 1, 's') AS outside FROM pages),
cut AS (SELECT page_id, regexp_extract(art, '<h1>([^<]*)</h1>', 1) AS head, string_split(regexp_replace(art, '^.*</h1>', '', 's'), '<p>') AS ps FROM inner_),
paras AS (
  SELECT page_id, head, generate_subscripts(ps, 1) AS k, unnest(ps) AS p, len(ps) AS n FROM cut
),
strings AS (
  SELECT page_id, head, k, NOT contains(p, '</p>') AS is_open,
    trim({_DECODE.format("regexp_replace(p, '<[^>]*>', '', 'g')")}, chr(32) || chr(9) || chr(10) || chr(13)) AS t
  FROM paras WHERE k > 1
),
joined_ AS (
  SELECT a.page_id, a.head, a.k, CASE WHEN a.is_open THEN (
    SELECT string_agg(b.t, ' ' ORDER BY b.k) FROM strings AS b WHERE b.page_id = a.page_id AND b.k >= a.k AND b.t <> '') ELSE a.t END AS t
  FROM strings AS a
),
each_line AS (
  SELECT page_id, head, k, unnest(string_split(t, chr(10))) AS raw, generate_subscripts(string_split(t, chr(10)), 1) AS j FROM joined_ WHERE t <> ''
),
lines_ AS (
  SELECT page_id, head, min((k, j)) AS o, trim({_SQUEEZE}, ' |-') AS line FROM each_line GROUP BY page_id, head, trim({_SQUEEZE}, ' |-')
),
page_secs AS (
  SELECT page_id, trim(regexp_replace({_DECODE.format("head")}, '[ \t]+', ' ', 'g'), ' |-') AS heading, string_agg(line, chr(10) ORDER BY o) AS text
  FROM lines_ WHERE line <> '' GROUP BY page_id, head
)
"""
_LINES = "SELECT conv_id, turn, role, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM conversations"
_STARTS = "How to|Benefits of|Who is|Documents Required|Official|Frequently Asked|Agriculture Infrastructure"
_HEADING = (
    f"(len({words('line')}) BETWEEN 1 AND 12 AND length(line) <= 120 AND (regexp_matches(line, '^(?:.+\\?\\s*|(?:{_STARTS}).+)$') "
    "OR (upper(line) = line AND lower(line) <> line)))"
)

ORACLE_SQL: dict[str, str] = {
    "doc_clean_text": f"WITH {CLEAN} SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS clean_text "
    "FROM documents AS d LEFT JOIN clean_lines USING (doc_id) GROUP BY d.doc_id",
    "doc_line_dedup_stats": "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, "
    "len(list_distinct(string_split(text, chr(10)))) AS n_distinct FROM documents",
    "doc_word_count": f"SELECT doc_id, len({words('text')}) AS n_words FROM documents",
    "doc_content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "page_file_id": "SELECT page_id, substr(md5(url), 1, 12) AS file_id FROM pages",
    "doc_sentences": f"WITH {UNITS} SELECT doc_id, line_no, unit_no, unit FROM units",
    "boilerplate_rules": f"WITH {CHROME} SELECT d.doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS clean_text "
    "FROM documents AS d LEFT JOIN chrome_lines USING (doc_id) GROUP BY d.doc_id",
    "heading_predicate": f"WITH l AS (SELECT * REPLACE (trim(line) AS line) FROM ({_LINES})) SELECT conv_id, turn, role, line_no, {_HEADING} AS is_heading FROM l",
    "faq_predicate": rf"WITH l AS ({_LINES}) SELECT conv_id, turn, role, line_no, regexp_matches(line, '\?\s*$') AND NOT regexp_matches(line, '(?i)whatsapp|https?://') AS is_faq FROM l",
    "clean_conversations": "WITH c AS (SELECT row_number() OVER () AS r, * FROM conversations), "
    "e AS (SELECT r, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM c), "
    f"t AS (SELECT r, min(pos) AS pos, line FROM (SELECT r, pos, trim({_SQUEEZE}, ' |-') AS line FROM e) WHERE line <> '' GROUP BY r, line) "
    "SELECT conv_id, turn, role, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS clean_text FROM c LEFT JOIN t USING (r) GROUP BY r, conv_id, turn, role",
    "casefold_terms": f"SELECT doc_id, contains({_FOLD.format('text')}, 'strasse') AND contains({_FOLD.format('text')}, 'the') AS has_all FROM documents",
    "line_sections": f"""
WITH e AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
l AS (SELECT doc_id, pos, trim(raw) AS line FROM e WHERE trim(raw) <> ''),
h AS (SELECT *, {_HEADING} AS is_heading FROM l),
p AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM h),
heads AS (SELECT doc_id, part, max(line) FILTER (is_heading) AS heading FROM p GROUP BY doc_id, part),
body AS (
  SELECT doc_id, part, min(pos) AS pos, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' |-') AS line FROM p WHERE NOT is_heading
  GROUP BY doc_id, part, trim(regexp_replace(line, '[ \\t]+', ' ', 'g'), ' |-')
),
s AS (SELECT doc_id, part, string_agg(line, chr(10) ORDER BY pos) AS text FROM body WHERE line <> '' GROUP BY doc_id, part)
SELECT doc_id, trim(regexp_replace(coalesce(heading, ''), '[ \\t]+', ' ', 'g'), ' |-') AS heading, text, 1 AS page_number,
  CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS INTEGER) AS section_index
FROM s JOIN heads USING (doc_id, part)""",
    "merge_short_sections": rf"""
WITH RECURSIVE e AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM e),
w AS (SELECT *, len({words('line')}) AS n, max(k) OVER (PARTITION BY doc_id) AS last FROM l),
f AS (
  SELECT doc_id, k, last, 0 AS g, n AS total FROM w WHERE k = 1
  UNION ALL
  SELECT w.doc_id, w.k, w.last, CASE WHEN f.total < 40 THEN f.g ELSE f.g + 1 END, CASE WHEN f.total < 40 THEN f.total + w.n ELSE w.n END
  FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1
),
t AS (SELECT doc_id, g AS last_g, total FROM f WHERE k = last),
m AS (SELECT f.doc_id, f.k, CASE WHEN f.g = t.last_g AND t.total < 40 AND f.g > 0 THEN f.g - 1 ELSE f.g END AS g FROM f JOIN t USING (doc_id))
SELECT doc_id, g AS group_no, CAST(min(k) - 1 AS INTEGER) AS first_line, string_agg(line, chr(10) ORDER BY k) AS text FROM m JOIN l USING (doc_id, k) GROUP BY doc_id, g""",
    "word_window_chunks": rf"""
WITH s AS (SELECT doc_id, {words('text')} AS w FROM documents),
c AS (SELECT doc_id, w, CAST(unnest(range(0, greatest(0, CAST(ceil((len(w) - 50) / 40.0) AS BIGINT)) + 1)) AS INTEGER) AS chunk_index FROM s WHERE len(w) > 0)
SELECT doc_id, chunk_index, chunk_index * 40 AS "begin", CAST(least(chunk_index * 40 + 50, len(w)) AS INTEGER) AS "end",
  array_to_string(w[chunk_index * 40 + 1 : chunk_index * 40 + 50], ' ') AS text FROM c""",
    "doc_chunks": f"WITH RECURSIVE {CHUNKS} SELECT doc_id, chunk_id, chunk_index, 0 AS section_index, false AS is_faq, text, "
    "CAST(n AS INTEGER) AS word_count, CAST(n AS INTEGER) AS token_count, content_hash FROM full_chunks",
    "ready_chunks": f"WITH RECURSIVE {CHUNKS}, dup AS (SELECT *, count(*) OVER (PARTITION BY content_hash) AS same FROM full_chunks) "
    "SELECT doc_id, chunk_id, chunk_index, CAST(n AS INTEGER) AS word_count, content_hash FROM dup WHERE same = 1 AND n BETWEEN 20 AND 512",
    "chunk_id_format": "SELECT doc_id, substr(sha256(source), 1, 12) || '-' || printf('%04d', doc_id * 37) AS chunk_id FROM documents",
    "duplicate_chunks": "SELECT doc_id, count(*) OVER (PARTITION BY sha256(text)) > 1 AS is_duplicate FROM documents",
    "chunk_issues": f"WITH {ISSUES} SELECT 'd' || doc_id AS chunk_id, array_to_string(issues, ',') AS issues FROM issues",
    "issue_counts": f"WITH {ISSUES} SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM issues) GROUP BY issue",
    "quality_report": f"WITH {ISSUES}, c AS (SELECT issue, count(*) AS n FROM (SELECT unnest(issues) AS issue FROM issues) GROUP BY issue) "
    "SELECT count(*) AS total_chunks, count(*) FILTER (len(issues) = 0) AS valid_chunks, count(*) FILTER (len(issues) > 0) AS invalid_chunks, "
    "(SELECT coalesce(string_agg(issue || '=' || n, ',' ORDER BY issue), '') FROM c) AS issue_counts, 20 AS min_words, 512 AS max_tokens, "
    "'preserve_question_headings' AS short_faq_policy, 'hashing' AS embedding_model, count(*) FILTER (len(issues) > 0) = 0 AS passed FROM issues",
    "ready_documents": f"WITH {ISSUES} SELECT doc_id, 'd' || doc_id AS chunk_id FROM issues WHERE len(issues) = 0",
    "inspection_sample": """
WITH n AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS sample_position, count(*) OVER () AS total FROM documents),
s AS (SELECT *, greatest(1, total // least(25, total)) AS step FROM n)
SELECT sample_position, doc_id, source FROM s WHERE sample_position % step = 0 AND sample_position // step < 25""",
    "page_title": f"SELECT url, trim({_DECODE.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))}) AS title FROM pages",
    "page_text": f"WITH {PAGES}, lines AS (SELECT page_id, unnest(string_split(regexp_replace(regexp_replace(html, "
    "'<(script|style|nav|footer)>.*?</(script|style|nav|footer)>', chr(1), 'gs'), '<[^>]*>', chr(10), 'g'), chr(10))) AS raw, "
    "generate_subscripts(string_split(regexp_replace(regexp_replace(html, '<(script|style|nav|footer)>.*?</(script|style|nav|footer)>', chr(1), 'gs'), "
    "'<[^>]*>', chr(10), 'g'), chr(10)), 1) AS k FROM pages), "
    "shown AS (SELECT page_id, k, trim(" + _DECODE.format("raw") + ", chr(1) || chr(32) || chr(9) || chr(13)) AS line FROM lines) "
    "SELECT url, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (line <> ''), '') AS text, "
    "CAST(any_value(p.page_id IN (SELECT page_id FROM joined_ WHERE t <> '')) AS INTEGER) AS n_sections FROM pages AS p JOIN shown USING (page_id) GROUP BY p.page_id, url",
    "page_chunks": f"WITH RECURSIVE {PAGES}, clean_lines AS (SELECT page_id AS doc_id, o AS pos, line FROM lines_ WHERE line <> ''), {UNITS_OF_LINES}, {CHUNKS_OF_UNITS}, "
    "made AS (SELECT c.doc_id AS page_id, chunk_index, url, heading, CASE WHEN heading = '' OR heading = c.text THEN c.text ELSE heading || chr(10) || c.text END AS text "
    "FROM chunks AS c JOIN page_secs AS s ON s.page_id = c.doc_id JOIN (SELECT page_id, url FROM pages) AS p ON p.page_id = c.doc_id) "
    "SELECT page_id, substr(sha256(url), 1, 12) || '-' || printf('%04d', chunk_index) AS chunk_id, url AS source_url, '' AS title, heading AS section, "
    "regexp_matches(heading, '\\?\\s*$') AS is_faq, 0 AS section_index, chunk_index, text, "
    f"CAST(len({words('text')}) AS INTEGER) AS word_count, CAST(len({words('text')}) AS INTEGER) AS token_count, sha256(text) AS content_hash FROM made",
    "page_sections": f"WITH {PAGES} SELECT page_id, 0 AS section_index, heading, text FROM page_secs",
    "url_netloc": "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc, split_part(url, '#', 1) AS defragmented FROM pages",
    "crawlable_urls": rf"WITH {ANCHORS} SELECT url, pos, NOT contains(href, '{{{{') AND NOT regexp_matches(regexp_extract(href, '^[^?#]*'), '(?i)\.(7z|csv|doc|docx|jpg|jpeg|mp3|mp4|pdf|png|rar|svg|zip)$') AS crawlable FROM anchors",
    "page_links_raw": f"WITH {ANCHORS} SELECT url, pos, anchor_text, root || href AS link FROM anchors",
    "category_links": f"WITH {ANCHORS} SELECT DISTINCT url, root || href AS link FROM anchors WHERE starts_with(href, '/t') AND contains(lower(anchor_text), 'th')",
    "crawl_bfs": """
WITH RECURSIVE walk(n, level, path) AS (
  SELECT CAST(0 AS BIGINT), 0, '' UNION ALL
  SELECT c.m, level + 1, path || c.pos FROM walk, (SELECT 2 * n + 2 AS m, '0' AS pos UNION ALL SELECT 2 * n + 1, '2') AS c
  WHERE c.m % 5 <> 4 AND c.m % 7 <> 6 AND c.m IN (SELECT page_id FROM pages)
)
SELECT 'https://site.example/' || n AS url, CAST(row_number() OVER (ORDER BY level, path) AS BIGINT) AS rank FROM walk ORDER BY rank LIMIT 25""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6) AS norm FROM embeddings",
    "vector_normalize": "WITH t AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3) AS v FROM embeddings), "
    "u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM t) "
    "SELECT vec_id, round(sqrt(list_inner_product(v, v)), 6) AS norm, round(v[1], 6) AS first, round(v[-1], 6) AS last FROM u",
    "verify_vectors": "WITH n AS (SELECT vec_id, embedding, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS s FROM embeddings) "
    "SELECT count(*) AS vector_count, count(DISTINCT vec_id) AS id_count, CAST(min(len(embedding)) AS INTEGER) AS min_dimension, "
    "CAST(max(len(embedding)) AS INTEGER) AS max_dimension, bool_and(isfinite(s)) AS finite_vectors, bool_and(s > 0) AS nonzero_vectors, "
    "bool_and(abs(s - 1) <= 1e-3 + 1e-5) AS normalized_vectors FROM n",
    "vector_topk": f"WITH {NEIGHBOURS} SELECT query_id, rank, vec_id, round(score, 6) AS score FROM best",
    "search_hits_citation": f"WITH {NEIGHBOURS} SELECT query_id, rank, vec_id, coalesce(source, 'No source URL') AS source_url, "
    "printf('%d. %s | score=%.4f', rank, coalesce(lang, 'Untitled'), score) AS line FROM best LEFT JOIN documents ON doc_id = vec_id",
    "label_hit_rate": f"WITH {NEIGHBOURS}, p AS (SELECT query_id, bool_or(label = query_label) AS hit, max(score) AS top FROM best GROUP BY query_id) "
    "SELECT count(*) AS queries, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, round(avg(top), 6) AS mean_top_score FROM p",
    "positional_alignment": "SELECT vec_id AS position, label <> 3 AS aligned FROM embeddings",
    "search_citations": f"WITH {CITED} SELECT CAST(rank AS INTEGER) AS rank, round(score, 6) AS score, title, source_url, section, chunk_id FROM hits",
    "rendered_hits": f"WITH {CITED} SELECT CAST(rank AS INTEGER) AS rank, printf('%d. %s | %s | score=%.4f | %s', rank, coalesce(title, 'Untitled'), "
    "CASE WHEN section = '' THEN 'Unspecified section' ELSE section END, score, coalesce(source_url, 'No source URL')) AS line FROM hits",
    "case_hit_rate": f"""WITH {CITED},
scored AS (SELECT q.position AS id, c.*, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s FROM cited AS q, cited AS c WHERE q.position % 50 = 0),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, position) AS rank FROM scored) WHERE rank <= 5),
told AS (
  SELECT position AS id, ['src' || (position % 20), coalesce(source_url, 'none')] AS urls,
    list_filter([upper(string_split(text, ' ')[1]), string_split(text, ' ')[2]], lambda x: x IS NOT NULL) AS terms FROM cited WHERE position % 50 = 0
)
SELECT CAST(id AS VARCHAR) AS id, bool_or(coalesce(list_contains(urls, source_url), false)) AS source_hit,
  bool_or(coalesce(list_contains(urls, source_url) AND len(list_filter(terms, lambda t: contains({_FOLD.format("coalesce(text, '')")}, {_FOLD.format("t")}))) = len(terms), false)) AS evidence_hit,
  round(max(s), 6) AS top_score FROM near JOIN told USING (id) GROUP BY id""",
    "faq_chunk_issues": rf"""
WITH s AS (SELECT doc_id, array_to_string(({words('text')})[1:12], ' ') AS body,
    CASE WHEN doc_id % 2 = 0 THEN 'Who may apply under rule ' ELSE 'Benefits of rule ' END || doc_id || CASE WHEN doc_id % 3 = 0 THEN '?' ELSE '' END AS heading FROM documents),
c AS (SELECT doc_id, heading, doc_id % 3 = 0 AS is_faq, trim(regexp_replace(body, '[ \t]+', ' ', 'g'), ' |-') AS body FROM s WHERE body <> ''),
w AS (SELECT *, len({words('heading')}) + len({words('body')}) AS n, count(*) OVER (PARTITION BY heading, body) AS same FROM c)
SELECT doc_id, heading AS section, is_faq, CAST(n AS INTEGER) AS word_count,
  array_to_string(list_filter([CASE WHEN same > 1 THEN 'duplicate_text' END, CASE WHEN n < 20 AND NOT is_faq THEN 'too_short' END], lambda x: x IS NOT NULL), ',') AS issues,
  n < 20 AND is_faq AS short_faq FROM w""",
    "index_manifest": "SELECT 'data/chunks_ready.jsonl' AS source_file, 'chunks_ready.jsonl' AS source_file_name, 'hashing' AS embedding_model, "
    "'inner_product_on_normalized_embeddings' AS metric, CAST(max(len(embedding)) AS INTEGER) AS dimension, count(*) AS chunk_count, "
    "'chunks_index' AS index_file, 'chunks_index' AS metadata_file FROM embeddings",
    "evidence_cases": f"WITH {CASES} SELECT * FROM rows_",
    "corpus_coverage": f"WITH {CASES} SELECT count(*) AS case_count, (SELECT count(*) FROM documents) AS chunk_count, "
    "round(avg(CAST(source_url_found AS DOUBLE)), 6) AS source_url_coverage, round(avg(CAST(evidence_found AS DOUBLE)), 6) AS evidence_case_coverage, "
    "round(avg(source_chunk_count), 6) AS average_source_chunks, round(avg(evidence_chunk_count), 6) AS average_evidence_chunks FROM rows_",
    "metadata_lookup_join": "WITH m AS (SELECT doc_id, max((quality, toxic)) AS m FROM labels GROUP BY doc_id) "
    "SELECT d.doc_id, d.source, coalesce(m.m[1], -1) AS quality, coalesce(m.m[2], -1) AS toxic FROM documents AS d LEFT JOIN m USING (doc_id)",
    "source_union": "SELECT 0 AS kind, doc_id AS id, CAST(length(text) AS INTEGER) AS n FROM documents UNION ALL "
    "SELECT 1, page_id, CAST(length(html) AS INTEGER) FROM pages UNION ALL SELECT 2, conv_id, CAST(length(text) AS INTEGER) FROM conversations",
    "tpch_join_agg": "SELECT n_name, c_mktsegment, CAST(round(sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(12,2)))), 2) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment",
    "events_session": "WITH g AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), "
    "m AS (SELECT user_id, CAST(sum(CASE WHEN gap IS NULL OR gap > INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM g) "
    "SELECT user_id, session, count(*) AS events FROM m GROUP BY user_id, session",
}
