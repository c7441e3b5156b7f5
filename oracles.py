"""SQL for DuckDB that gives the same rows as the registered queries.

The page expressions lean on the regular make-up of the given pages (lower-case tags, double
quotes, properly closed furniture); the Spark operators do not.
"""

from __future__ import annotations

from pagetable.functions.urls import BINARY_SUFFIXES

BINARY = "|".join(BINARY_SUFFIXES)
URL = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
BLANKS = r"' ' || chr(9) || chr(10) || chr(13) || chr(160)"


def host(url: str) -> str:
    return f"regexp_extract({url}, '{URL}', 2)"


def scheme(url: str) -> str:
    return f"lower(regexp_extract({url}, '{URL}', 1))"


def strip(x: str) -> str:
    return f"trim({x}, {BLANKS})"


def decode(x: str) -> str:
    for entity, char in (("&quot;?", '"'), ("&copy;?", "©"), ("&middot;?", "·"), ("&lt;?", "<"),
                         ("&gt;?", ">"), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{entity}', '{char}', 'g')"
    return x


def title(html: str) -> str:
    return strip(decode(f"regexp_extract({html}, '(?s)<title[^>]*>(.*?)</title>', 1)"))


def without(html: str, *tags: str) -> str:
    for tag in tags:
        html = f"regexp_replace({html}, '(?s)<{tag}[ >].*?</{tag}>', '<x>', 'g')"
    return html


def texts(html: str) -> str:
    """List of trimmed non-empty texts between tags."""
    pieces = f"string_split_regex({html}, '(?s)<[^>]*>')"
    cleaned = f"list_transform({pieces}, lambda p: {strip(decode('p'))})"
    return f"list_filter({cleaned}, lambda t: t <> '')"


def lines(html: str) -> str:
    return f"array_to_string({texts(html)}, chr(10))"


# Elements that are furniture.
FURNITURE = ("script", "style", "nav", "footer", "header", "aside", "noscript")
BODY = "regexp_extract(html, '(?s)<body[^>]*>(.*)$', 1)"
CLEAN = lines(without("html", *FURNITURE))
AD = "'(?s)<div class=\"ad\">.*?</div>'"
BODY_TEXT = lines(f"regexp_replace({without(BODY, *FURNITURE)}, {AD}, '<x>', 'g')")
RENDERED = lines(without(BODY, "script", "style", "noscript"))
CONTENT = f"coalesce(nullif({strip(CLEAN)}, ''), '[No content]')"
STATUS = "[200, 200, 404, 200, 503][page_id % 5 + 1]"
STATUS_ERROR = f"CASE WHEN {STATUS} >= 400 THEN 'HTTP ' || {STATUS} END"

# The article as Markdown: a heading, then paragraphs, some opened by bold text and a break.
_ARTICLE = f"regexp_extract({without(BODY, *FURNITURE)}, '(?s)<article>(.*)$', 1)"
_MD = _ARTICLE
for _pattern, _new in (
    (r"<!--.*?-->", ""),
    (r"[ \t\n\r]+", " "),
    (r"<h1>", "@P@# "),
    (r"</h1>", "@P@"),
    (r"<p><b>(.*?)<br>", r"@P@**\1  @N@**"),
    (r"</?p>", "@P@"),
    (r"<[^>]*>", ""),
    (r"( *@P@ *)+", "@P@"),
):
    _MD = f"regexp_replace({_MD}, '(?s){_pattern}', '{_new}', 'g')"
_MD = f"replace(replace({_MD}, '@P@', chr(10) || chr(10)), '@N@', chr(10))"
MARKDOWN = strip(decode(_MD))

_HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
_ABSOLUTE = (
    f"{scheme('url')} || '://' || {host('url')} || split_part(" + decode("h") + ", '#', 1)"
)
# Every href of the given pages is an absolute path.
LINKS = (
    "list_sort(list_distinct(list_filter(list_transform("
    f"{_HREFS}, lambda h: {_ABSOLUTE}), "
    rf"lambda u: NOT regexp_matches(lower(regexp_extract(u, '{URL}', 3)), '\.({BINARY})$'))))"
)
EDGES = f"""
  SELECT url AS src, CAST(generate_subscripts(links, 1) - 1 AS INTEGER) AS pos, unnest(links) AS dst
  FROM (SELECT url, {LINKS} AS links FROM pages)
"""

# --- The derived site graph and walks over it ------------------------------------------------

GRAPH = f"""
positions AS (
  SELECT page_id, url, {host('url')} AS host,
         row_number() OVER (PARTITION BY {host('url')} ORDER BY page_id) AS r
  FROM pages),
pairs AS (
  SELECT s.url AS src, t.url AS dst FROM positions s JOIN positions t
    ON s.host = t.host AND (t.r = 2 * s.r OR t.r = 2 * s.r + 1 OR t.r = s.r - 1)
  UNION SELECT url, 'http://' || host || '/gone' FROM positions),
edges AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS pos FROM pairs),
seeds AS (SELECT url AS seed FROM positions WHERE r = 1)
"""


def walk(depth: int, limit: int | None, failures_count: bool) -> str:
    """CTEs ``visited`` and ``hits`` of a level-ordered walk, one pair of CTEs per level."""
    counted = "v" if failures_count else "h"
    ctes = [GRAPH, "v0 AS (SELECT seed, seed AS url, 1::BIGINT AS rank, 0 AS depth FROM seeds)"]
    hit = "h{i} AS (SELECT v.* FROM v{i} v JOIN pages p ON p.url = v.url)"
    ctes.append(hit.format(i=0))
    for i in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT seed, url FROM v{j}" for j in range(i))
        used = " UNION ALL ".join(f"SELECT seed FROM {counted}{j}" for j in range(i))
        cut = "" if limit is None else (
            f"WHERE rank <= {limit} - (SELECT count(*) FROM ({used}) u WHERE u.seed = c.seed)"
        )
        ctes.append(f"""v{i} AS (
  SELECT seed, url, rank, {i} AS depth FROM (
    SELECT seed, url, row_number() OVER (PARTITION BY seed ORDER BY place) AS rank FROM (
      SELECT h.seed, e.dst AS url, min(h.rank * 1000000 + e.pos) AS place
      FROM h{i - 1} h JOIN edges e ON e.src = h.url
      WHERE NOT EXISTS (SELECT 1 FROM ({seen}) s WHERE s.seed = h.seed AND s.url = e.dst)
      GROUP BY ALL)) c {cut})""")
        ctes.append(hit.format(i=i))
    for name, prefix in (("visited", "v"), ("hits", "h")):
        union = " UNION ALL ".join(f"SELECT * FROM {prefix}{i}" for i in range(depth + 1))
        ctes.append(f"{name} AS ({union})")
    return "WITH " + ",\n".join(ctes)


def tree_rows() -> str:
    return """
SELECT v.seed AS root, v.url, v.depth, v.rank,
       coalesce((SELECT string_agg(dst, '@' ORDER BY pos) FROM edges e WHERE e.src = v.url), '')
         AS links
FROM visited v"""


TREE_LINKS = "replace(links, '@', chr(10))"

# --- Extraction ------------------------------------------------------------------------------

_H1 = decode("regexp_extract(html, '(?s)<article>.*?<h1>(.*?)</h1>', 1)")
_FIRST_P = "regexp_extract(html, '(?s)<article>.*?<p>(.*?)(?:</p>|<p>|</article>)', 1)"
ITEM_TITLE = strip(_H1)
ITEM_FIRST = f"array_to_string({texts(_FIRST_P)}, '')"
ITEM_JSON = f"CAST(to_json([{{'title': {ITEM_TITLE}, 'first': {ITEM_FIRST}}}]) AS VARCHAR)"

# --- Search ----------------------------------------------------------------------------------


def words(text: str) -> str:
    return rf"list_filter(string_split_regex(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"


def hits(docs: str, terms: list[str], limit: int) -> str:
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
SELECT id, coalesce(title, '') AS title, coalesce(url, '') AS url,
       coalesce(text, '') AS description, score
FROM (SELECT *, CAST(len(list_filter({words('text')}, lambda w: w IN ({listed}))) AS BIGINT)
        AS score FROM ({docs}))
WHERE score > 0 ORDER BY score DESC, id LIMIT {limit}"""


DOCUMENTS = "SELECT doc_id AS id, lang AS title, source AS url, text FROM documents"
PAGE_DOCUMENTS = (
    f"SELECT page_id AS id, {title('html')} AS title, url, {CONTENT} AS text FROM pages"
)
PAGE_TERMS, DOC_TERMS = ["the", "of", "and"], ["stand", "the", "une"]
_TF = ", ".join(
    f"len(list_filter(ws, lambda w: w = '{t}')) AS tf{i}" for i, t in enumerate(DOC_TERMS)
)
_DF = ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(len(DOC_TERMS)))
_SCORE = " + ".join(
    f"ln(1.0::DOUBLE + (n - df{i} + 0.5::DOUBLE) / (df{i} + 0.5::DOUBLE)) * tf{i} * 2.2::DOUBLE"
    f" / (tf{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / mean))"
    for i in range(len(DOC_TERMS))
)
BM25 = f"""
WITH w AS (SELECT *, {words('text')} AS ws FROM ({DOCUMENTS})),
c AS (SELECT id, title, url, text, len(ws) AS dl, {_TF} FROM w),
s AS (SELECT count(*) AS n, avg(dl) AS mean, {_DF} FROM c)
SELECT id, coalesce(title, '') AS title, coalesce(url, '') AS url,
       coalesce(text, '') AS description, round({_SCORE}, 6) AS score
FROM c, s WHERE tf0 + tf1 + tf2 > 0 ORDER BY score DESC, id LIMIT 20"""

_DATE = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_POST_TS = "(TIMESTAMP '2024-01-01' + to_seconds(conv_id * 60 + turn))"
_ACTIVITY = f"""event_id AS id, {_DATE.format('ts')} AS date, event_type AS content,
  CAST(json_extract(props, '$.k') AS BIGINT) AS likes, CAST(floor(value) AS BIGINT) AS retweets,
  CAST(0 AS BIGINT) AS replies, 'https://posts.example/' || event_id AS url"""

SUFFIXES = {
    "/f.PDF": True, "/f.pdf?x=1": True, "/f?file=x.pdf": False, "/f.tar.gz": True,
    "/f.html": False, "/f.js": True, "/f.json": False, "/d.zip/": False, "/f.docx#a": True,
    "/f.css;v=2": True,
}

_PATH = f"regexp_extract(url, '{URL}', 3)"
_ROOT = f"{scheme('url')} || '://' || {host('url')}"
_DIR = f"regexp_replace({_PATH}, '[^/]*$', '')"
_UP = f"regexp_replace({_DIR}, '[^/]+/$', '')"
_SOLID_DIR = f"CASE WHEN {_DIR} = '' THEN '/' ELSE {_DIR} END"
_SOLID_UP = f"CASE WHEN {_UP} = '' THEN '/' ELSE {_UP} END"
HREFS = {
    "": "NULL",
    "#top": "NULL",
    "javascript:void(0)": "NULL",
    "mailto:q@a.com": "NULL",
    "//c.com/z": f"{scheme('url')} || '://c.com/z'",
    "/k#frag": f"{_ROOT} || '/k'",
    " /pad ": f"{_ROOT} || '/pad '",
    "?p=2": f"{_ROOT} || {_PATH} || '?p=2'",
    "k": f"{_ROOT} || {_SOLID_DIR} || 'k'",
    "../k": f"{_ROOT} || {_SOLID_UP} || 'k'",
    "./a//b/../c": f"{_ROOT} || {_SOLID_DIR} || 'a/c'",
    "http://b.com/x?y#z": "'http://b.com/x?y'",
    # A scheme in capitals is only brought to lower case when it is the page's own.
    "HTTPS://b.com/": f"CASE WHEN {scheme('url')} = 'https' THEN 'https://b.com/' END",
    "/../up": f"{_ROOT} || '/up'",
}

# --- The registered queries ------------------------------------------------------------------

ORACLES = {
    "url_parts": f"""
SELECT page_id, {scheme('url')} AS scheme, {host('url')} AS netloc, {_PATH} AS path,
       regexp_extract(url, '{URL}', 4) AS query FROM pages""",
    "same_site": f"""
SELECT a.page_id, {host('a.url')} = {host('b.url')} AS with_next, TRUE AS other_scheme,
       FALSE AS www, FALSE AS port
FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""",
    "normalized_urls": " UNION ALL ".join(
        f"SELECT page_id, '{h}' AS href, {sql} AS resolved FROM pages" for h, sql in HREFS.items()
    ),
    "binary_urls": " UNION ALL ".join(
        f"SELECT page_id, '{s}' AS suffix, {b} AS is_binary FROM pages"
        for s, b in SUFFIXES.items()
    ),
    "page_lookup": """
SELECT url, page_id, CAST(length(html) AS INTEGER) AS n_chars FROM pages
UNION ALL SELECT url || '/missing', NULL, NULL FROM pages""",
    "status_labels": f"""
SELECT page_id, CAST({STATUS} AS INTEGER) AS status_code, {STATUS_ERROR} AS error FROM pages""",
    "fetch_outcomes": """
SELECT error, count(*) AS n FROM (
  SELECT CASE event_type WHEN 'error' THEN 'Timeout after 30s'
           WHEN 'click' THEN 'Connection error: ' || detail
           WHEN 'purchase' THEN 'Request error: ' || detail
           WHEN 'signup' THEN CASE WHEN value < 10 THEN 'URL error: ' || detail ELSE detail END
           ELSE CASE WHEN value < 20 THEN NULL WHEN value < 60 THEN 'HTTP 404' ELSE 'HTTP 500' END
         END AS error
  FROM (SELECT *, 'code ' || json_extract(props, '$.k') AS detail FROM events))
GROUP BY error""",
    "page_title": f"SELECT page_id, {title('html')} AS title FROM pages",
    "clean_text": f"SELECT page_id, {CLEAN} AS text FROM pages",
    "body_text": f"SELECT page_id, {BODY_TEXT} AS text FROM pages",
    "rendered_text": f"SELECT page_id, {RENDERED} AS text FROM pages",
    "scrape_text": f"""
SELECT *, CAST(length(content) AS INTEGER) AS content_length FROM (
  SELECT page_id, url, 'text' AS format, {STATUS_ERROR} AS error, url AS final_url,
         CAST({STATUS} AS INTEGER) AS status_code, {title('html')} AS title, {CONTENT} AS content
  FROM pages)""",
    "scrape_json": f"""
SELECT *, CAST(length(content) AS INTEGER) AS content_length FROM (
  SELECT page_id, url, 'json' AS format, CAST(NULL AS VARCHAR) AS error, url AS final_url,
         CAST(200 AS INTEGER) AS status_code, {title('html')} AS title, {CONTENT} AS content
  FROM pages)""",
    "scrape_markdown": f"""
SELECT *, CAST(length(content) AS INTEGER) AS content_length FROM (
  SELECT page_id, url, 'markdown' AS format, CAST(NULL AS VARCHAR) AS error, url AS final_url,
         CAST(200 AS INTEGER) AS status_code, {title('html')} AS title, {MARKDOWN} AS content
  FROM pages)""",
    "snapshot": f"""
SELECT page_id, url, 'URL:  ' || url || chr(10) || 'Title: ' || {title('html')} || chr(10)
       || repeat('─', 50) || chr(10) || {RENDERED} AS snapshot FROM pages""",
    "internal_links": f"SELECT page_id, url, array_to_string({LINKS}, chr(10)) AS links FROM pages",
    "link_edges": EDGES,
    "link_degrees": f"""
SELECT url, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (
  SELECT src AS url, 1 AS o, 0 AS i FROM ({EDGES}) UNION ALL
  SELECT dst, 0, 1 FROM ({EDGES})) GROUP BY url""",
    "page_links": f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, {_ROOT} || {decode('h')} AS href,
       {strip(decode('t'))} AS text
FROM (SELECT page_id, url, generate_subscripts({_HREFS}, 1) - 1 AS pos, unnest({_HREFS}) AS h,
             unnest(regexp_extract_all(html, '(?s)<a href="[^"]*">(.*?)</a>', 1)) AS t
      FROM pages)""",
    "crawl_limited": walk(3, 5, False) + " SELECT seed, depth, rank, url FROM hits",
    "crawl_records": walk(4, None, False) + f"""
SELECT seed, depth, rank, url, title, content, CAST(length(content) AS INTEGER) AS content_length
FROM (SELECT h.*, {title('p.html')} AS title, {CONTENT} AS content
      FROM hits h JOIN pages p USING (url))""",
    "site_tree": walk(4, None, True) + f"""
SELECT root, url, depth, rank, CASE WHEN url IN (SELECT url FROM pages)
  THEN {TREE_LINKS} ELSE '' END AS links FROM ({tree_rows()})""",
    "site_tree_limited": walk(3, 4, True) + f"""
SELECT root, url, depth, rank, CASE WHEN url IN (SELECT url FROM pages)
  THEN {TREE_LINKS} ELSE '' END AS links FROM ({tree_rows()})""",
    "site_totals": walk(4, None, True) + """
SELECT seed AS root, count(*) AS total_urls FROM visited GROUP BY seed""",
    "site_map": walk(3, 4, True) + f"""
SELECT root, count(*) AS total_urls, string_agg(url, chr(10) ORDER BY url) AS urls,
       string_agg(url || ' -> ' || replace(links, '@', ' '), chr(10)
                  ORDER BY url || ' -> ' || replace(links, '@', ' ')) AS tree
FROM ({tree_rows()}) GROUP BY root""",
    "site_report": walk(4, None, True) + f"""
SELECT t.root, t.url, t.depth, t.rank,
       CAST(CASE WHEN links = '' THEN 0 ELSE len(string_split(links, '@')) END AS INTEGER)
         AS n_links,
       p.title, CAST(length(p.content) AS INTEGER) AS text_length
FROM ({tree_rows()}) t LEFT JOIN
  (SELECT url, {title('html')} AS title, {CONTENT} AS content FROM pages) p USING (url)""",
    "extract_rows": f"""
SELECT page_id, CAST(0 AS INTEGER) AS pos, {ITEM_TITLE} AS title, {ITEM_FIRST} AS first
FROM pages""",
    "extract_lists": f"""
SELECT page_id, CAST(pos AS INTEGER) AS pos, {strip(decode('t'))} AS label,
       CASE WHEN pos % 2 = 0 THEN {strip(decode('t'))} ELSE '' END AS odd, '' AS absent
FROM (SELECT page_id, generate_subscripts({_HREFS}, 1) - 1 AS pos,
             unnest(regexp_extract_all(html, '(?s)<li><a href="[^"]*">(.*?)</a>', 1)) AS t
      FROM pages)""",
    "extract_pages": f"""
SELECT page_id, url, CASE WHEN {STATUS} < 400 THEN {ITEM_JSON} END AS data,
       {STATUS_ERROR} AS error FROM pages""",
    "extract_none": """
SELECT page_id, CAST(NULL AS INTEGER) AS n, 'No data extracted' AS error FROM pages""",
    "scrape_with_schema": f"""
SELECT *, CAST(length(content) AS INTEGER) AS content_length FROM (
  SELECT page_id, url, 'json' AS format, {title('html')} AS title, {ITEM_JSON} AS content
  FROM pages)""",
    "search_pages": hits(PAGE_DOCUMENTS, PAGE_TERMS, 5),
    "search_documents": hits(DOCUMENTS, DOC_TERMS, 20),
    "search_bm25": BM25,
    "post_search": f"""
SELECT conv_id * 1000000 + turn AS id, {_DATE.format(_POST_TS)} AS date,
       CASE role WHEN 'system' THEN 'unknown' ELSE role END AS "user",
       CASE role WHEN 'user' THEN 'User' ELSE '' END AS fullname, text AS content,
       length(text) AS likes, turn AS retweets, conv_id % 7 AS replies,
       'https://posts.example/' || conv_id || '/' || turn AS url
FROM conversations WHERE contains(lower(text), 'the')
ORDER BY {_POST_TS} DESC, id LIMIT 10""",
    "user_timeline": f"""
SELECT {_ACTIVITY} FROM events JOIN customer ON c_custkey = user_id
WHERE c_name = 'Customer#000000007' ORDER BY ts DESC, event_id LIMIT 20""",
    "user_timelines": f"""
WITH posts AS (
  SELECT c_name AS handle,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS INTEGER)
           AS rank, {_ACTIVITY}
  FROM events JOIN customer ON c_custkey = user_id)
SELECT c.c_name AS handle, p.* EXCLUDE (handle),
       CASE WHEN p.rank IS NULL THEN 'No tweets found' END AS error
FROM customer c LEFT JOIN posts p ON p.handle = c.c_name AND p.rank <= 20
UNION ALL BY NAME
SELECT c_name || 'x' AS handle, 'User not found: ' || c_name || 'x' AS error
FROM customer WHERE c_custkey % 10 = 0""",
    "profiles": """
SELECT 'https://profiles.example/' || o_orderkey AS url, 'Person ' || o_custkey AS name,
       CAST(NULL AS VARCHAR) AS about, o_orderpriority AS headline, '' AS location,
       o_orderstatus AS company, lower(o_orderpriority) AS job_title,
       CASE WHEN o_orderstatus = 'P' THEN '[]' ELSE CAST(to_json([{
         'title': o_orderpriority, 'company': o_orderstatus,
         'duration': strftime(o_orderdate, '%Y-%m-%d') || ' - ' ||
           CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y') ELSE 'None' END
       }]) AS VARCHAR) END AS experiences,
       CASE WHEN o_orderstatus = 'F' THEN '[]'
         ELSE '[{"school":"School","degree":"' || o_orderstatus || '"}]' END AS education
FROM orders""",
    "login_forms": """
SELECT page_id,
       ['input[type=email]', 'input[name*=email i]', NULL, 'input[id*=login i]'][page_id % 4 + 1]
         AS user_selector,
       page_id % 4 = 0 AS has_password, page_id % 4 IN (0, 1) AS has_submit,
       [NULL, 'Wrong password', NULL, 'No'][page_id % 4 + 1] AS error_text
FROM pages""",
    "json_lines": f"""
SELECT CAST(to_json({{'page_id': page_id, 'url': url, 'links': {LINKS}}}) AS VARCHAR) AS value
FROM pages""",
    "json_array": f"""
SELECT '[' || string_agg(CAST(to_json({{'score': score, 'id': id, 'title': title, 'url': url}})
         AS VARCHAR), ',' ORDER BY id) || ']' AS value
FROM ({hits(DOCUMENTS, DOC_TERMS, 20)})""",
    "content_only": f"""
SELECT CASE WHEN {STATUS} < 400 THEN {ITEM_JSON} ELSE {CONTENT} END AS value FROM pages""",
    "stream_titles": f"""
SELECT page_id, {title('html')} AS title, CAST(len({LINKS}) AS INTEGER) AS n_links FROM pages""",
}
ORACLES["page_store_lookup"] = ORACLES["page_lookup"]
ORACLES["json_array_pretty"] = f"""
SELECT '[' || chr(10) || string_agg(
    '  {{' || chr(10) || '    "score": ' || score || ',' || chr(10) || '    "id": ' || id || ',' || chr(10)
    || '    "title": ' || CAST(to_json(title) AS VARCHAR) || ',' || chr(10)
    || '    "url": ' || CAST(to_json(url) AS VARCHAR) || chr(10) || '  }}',
    ',' || chr(10) ORDER BY id) || chr(10) || ']' AS value
FROM ({hits(DOCUMENTS, DOC_TERMS, 20)})"""
ORACLES["json_arrays"] = f"""
SELECT host, '[' || chr(10) || string_agg(
    '  {{' || chr(10) || '    "page_id": ' || page_id || ',' || chr(10)
    || '    "url": ' || CAST(to_json(url) AS VARCHAR) || ',' || chr(10)
    || '    "n_chars": ' || n_chars || chr(10) || '  }}',
    ',' || chr(10) ORDER BY n_chars DESC, page_id) || chr(10) || ']' AS value
FROM (SELECT {host('url')} AS host, page_id, url, length(html) AS n_chars FROM pages
  QUALIFY row_number() OVER (PARTITION BY host ORDER BY n_chars DESC, page_id) <= 3)
GROUP BY host"""
ORACLES["internal_links_from_nodes"] = ORACLES["internal_links"]
ORACLES["search_bm25_indexed"] = ORACLES["search_bm25"]
ORACLES["post_search_indexed"] = ORACLES["post_search"]
ORACLES["stream_crawl"] = ORACLES["crawl_limited"]
ORACLES["stream_new_urls"] = f"""
SELECT DISTINCT unnest({LINKS}) AS url FROM pages"""
