"""DuckDB SQL for the registered queries, over the same whole tables."""

from __future__ import annotations

from .inputs import CHARACTERS, LETTERS

TOKENS = "regexp_extract_all(lower({0}), '[a-z0-9]+')"

DOC_TOKENS = f"""
doc_tokens AS (
  SELECT doc_id AS row_idx, unnest(list_distinct({TOKENS.format("text")})) AS tok
  FROM documents
)"""

def asked_at_places(terms: str) -> str:
    """CTE asked: a query for every element of terms, a list made of an item's whole text."""
    return f"""
lists AS (SELECT item_id, {terms} AS terms FROM benchmark),
places AS (SELECT item_id, terms, unnest(range(1, len(terms) + 1)) AS pos FROM lists),
asked AS (SELECT item_id * 1000000 + pos - 1 AS query_id, terms[pos] AS term FROM places)"""


WORDS = "string_split(text, ' ')"
TWO_WORDS = asked_at_places(
    f"list_transform(range(1, len({WORDS}) + 1), lambda i: concat_ws(' ', {WORDS}[i], {WORDS}[i + 1]))"
)
ONE_WORD = asked_at_places("regexp_extract_all(lower(text), '[a-z0-9]+')")
# in the order of their first places
ONE_CHARACTER = asked_at_places(
    "list_transform(list_sort(list_transform(list_distinct(string_split(text, '')), "
    "lambda c: {'place': instr(text, c), 'c': c})), lambda s: s.c)"
)


def english_hits(source: str, key: str) -> str:
    """CTEs toks, hits and ranked for the English search of ``asked`` in a table."""
    return f"""
toks AS (
  SELECT query_id, {TOKENS.format("term")} AS parts FROM asked
),
texts AS (SELECT {key} AS row_idx, lower(text) AS lt FROM {source}),
hits AS (
  SELECT q.query_id, t.row_idx,
    len(q.parts) > 1 AND contains(t.lt, array_to_string(q.parts, ' ')) AS is_exact
  FROM (SELECT * FROM toks WHERE len(parts) > 0) q JOIN texts t
    ON len(list_filter(q.parts, lambda p: NOT contains(t.lt, p))) = 0
),
ranked AS (
  SELECT query_id, row_idx, is_exact,
    row_number() OVER (PARTITION BY query_id ORDER BY is_exact DESC, row_idx) AS rank
  FROM hits
)"""


def segment_hits(asked: str) -> str:
    return f"""
toks AS (
  SELECT query_id, list_filter(string_split_regex(term, '\\s+'), lambda p: p <> '') AS parts
  FROM ({asked})
),
hits AS (
  SELECT q.query_id, t.doc_id AS row_idx,
    len(q.parts) > 1 AND contains(t.text, array_to_string(q.parts, '')) AS is_exact
  FROM (SELECT * FROM toks WHERE len(parts) > 0) q JOIN documents t
    ON len(list_filter(q.parts, lambda p: NOT contains(t.text, p))) = 0
)
SELECT query_id, row_idx, is_exact,
  row_number() OVER (PARTITION BY query_id ORDER BY is_exact DESC, row_idx) AS rank
FROM hits"""


DOC_HITS = english_hits("documents", "doc_id")
RANKED = "SELECT query_id, rank, row_idx, is_exact FROM ranked"

# Books, addresses and requests

REGION_BOOKS = """
books AS (
  SELECT r_regionkey + 1 AS idx, r_name AS en, lower(substr(r_name, 1, 3)) AS alias,
    list_transform(range(1, 13), lambda i: 10 + (i * 7 + r_regionkey + 1) % 30) AS chapters
  FROM region
)"""

CONV = """
conv AS (
  SELECT conv_id * 100 + turn AS row_idx, CAST(conv_id // 20 + 1 AS INTEGER) AS book_idx,
    CAST(conv_id % 20 + 1 AS INTEGER) AS chapter, CAST(turn AS INTEGER) AS verse,
    text AS text_en, CASE WHEN turn % 3 <> 2 THEN upper(role) END AS text_cn
  FROM conversations
)"""

CONV_BOOKS = f"""{CONV},
turns AS (
  SELECT book_idx, chapter, CAST(count(*) - 2 AS INTEGER) AS n FROM conv GROUP BY ALL
),
books AS (
  SELECT book_idx AS idx, any_value(r_name) || '-' || book_idx || 'x' AS en,
    CASE WHEN book_idx % 2 = 0 THEN 'R' || book_idx END AS cn,
    lower(substr(any_value(r_name), 1, 3)) || book_idx || 'x' AS alias,
    list(n ORDER BY chapter) AS chapters
  FROM turns JOIN region ON (book_idx - 1) % 5 = r_regionkey GROUP BY book_idx
)"""

ASKED_CONV = "user_id % (SELECT max(conv_id) + 21 FROM conversations)"

REQUESTS = f"""
requests AS (
  SELECT event_id AS query_id, CAST({ASKED_CONV} // 20 + 1 AS INTEGER) AS book_idx,
    CAST({ASKED_CONV} % 20 + 1 AS INTEGER) AS chapter, CAST(event_id % 9 AS INTEGER) AS verse,
    CAST(event_id % 9 + 2 AS INTEGER) AS verse_end
  FROM events
)"""

# Citations

CITATIONS = """
cites AS (
  SELECT DISTINCT r_name || ' ' || l_linenumber * 3 || ':' || CAST(l_quantity AS INTEGER)
    || CASE WHEN l_linenumber % 2 = 0 THEN '-' || (CAST(l_quantity AS INTEGER) + 2) ELSE '' END AS raw
  FROM lineitem JOIN region ON l_orderkey % 5 = r_regionkey
),
queries AS (SELECT raw AS query_id, raw FROM cites)"""

RAW_QUERIES = """
people AS (
  SELECT event_id, user_id, event_type, r_name, user_id % 6 + 1 AS book
  FROM events JOIN region ON (user_id % 6) % 5 = r_regionkey
),
turn_words AS (SELECT conv_id * 100 + turn AS row, string_split(text, ' ') AS w FROM conversations),
turn_places AS (SELECT row, w, unnest(range(1, len(w) + 1)) AS pos FROM turn_words),
queries AS (
  SELECT event_id AS query_id, CASE event_id % 6
    WHEN 0 THEN r_name || '-' || book || 'x ' || (user_id % 23 + 1) || ':' || (event_id % 7)
    WHEN 1 THEN lower(substr(r_name, 1, 3)) || book || 'X ' || (user_id % 9 + 1)
    WHEN 2 THEN lower(substr(r_name, 1, 3)) || book || 'X' || user_id
    WHEN 3 THEN 'Zed ' || user_id || ':1'
    WHEN 4 THEN event_type
    ELSE substr(event_type, event_id // 6 % length(event_type) + 1, 1) END AS raw
  FROM people
  UNION ALL
  SELECT -(row * 1000000 + pos), array_to_string(w[pos:pos + 1], ' ') FROM turn_places
)"""

GRAMMAR = "'^(.*?)([0-9]+(?::[0-9]+(?:\\s*-\\s*[0-9]+)?)?)$'"
ADDRESS = "'^([0-9]+)(?::([0-9]+)(?:\\s*-\\s*([0-9]+))?)?$'"

TRIMMED = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"

NAMES = f"""
split_q AS (
  SELECT query_id, {TRIMMED} AS term,
    regexp_replace(lower(regexp_extract({TRIMMED}, {GRAMMAR}, 1)), '[.\\s]', '', 'g') AS name,
    regexp_extract({TRIMMED}, {GRAMMAR}, 2) AS num
  FROM queries
),
aliases AS (
  SELECT alias AS name, max(idx) AS idx FROM (
    SELECT alias, idx FROM books
    UNION ALL SELECT regexp_replace(lower(en), '[.\\s]', '', 'g'), idx FROM books
  ) GROUP BY alias
)"""

PARTS = f"""TRY_CAST(regexp_extract(num, {ADDRESS}, 1) AS INTEGER) AS chapter,
    TRY_CAST(regexp_extract(num, {ADDRESS}, 2) AS INTEGER) AS verse,
    TRY_CAST(regexp_extract(num, {ADDRESS}, 3) AS INTEGER) AS verse_end"""


def digit_readings(source: str) -> str:
    """CTEs for the readings of ``num`` in a table with query_id, book_idx, num, chapters."""
    return f"""
digits AS (SELECT * FROM {source} WHERE regexp_full_match(num, '[0-9]+')),
cuts AS (
  SELECT query_id, book_idx, num, chapters, unnest(range(1, length(num))) AS i FROM digits
),
readings AS (
  SELECT query_id, book_idx, num, CAST(num AS INTEGER) AS chapter, CAST(NULL AS INTEGER) AS verse
  FROM digits WHERE CAST(num AS INTEGER) BETWEEN 1 AND len(chapters)
  UNION
  SELECT query_id, book_idx, num, CAST(substr(num, 1, i) AS INTEGER),
    CAST(substr(num, i + 1) AS INTEGER)
  FROM cuts
  WHERE CAST(substr(num, 1, i) AS INTEGER) BETWEEN 1 AND len(chapters)
    AND (length(num) - i = 1 OR substr(num, i + 1, 1) <> '0')
    AND CAST(substr(num, i + 1) AS INTEGER)
      BETWEEN 1 AND chapters[CAST(substr(num, 1, i) AS INTEGER)]
),
candidates AS (
  SELECT query_id, book_idx, num, chapter, verse,
    row_number() OVER (PARTITION BY query_id ORDER BY verse IS NOT NULL, chapter, verse) AS cand_rank,
    count(*) OVER (PARTITION BY query_id) AS n_cand
  FROM readings
)"""


KNOWN = """
known AS (
  SELECT q.query_id, q.num, b.idx AS book_idx, b.chapters
  FROM split_q q JOIN aliases a ON q.name = a.name AND q.name <> '' JOIN books b ON a.idx = b.idx
)"""


def classified(known: str, lang: str) -> str:
    """CTEs up to classified; known: the CTE of queries with their book, lang: of a term."""
    return f"""{NAMES},
{known},
exact AS (
  SELECT query_id, book_idx, chapters, {PARTS} FROM known WHERE contains(num, ':')
),
{digit_readings("known")},
resolved AS (
  SELECT query_id, book_idx, chapter, verse, verse_end, 1 AS cand_rank, 1 AS n_cand
  FROM exact WHERE chapter BETWEEN 1 AND len(chapters)
  UNION ALL
  SELECT query_id, book_idx, chapter, verse, NULL, cand_rank, n_cand FROM candidates
),
classified AS (
  SELECT q.query_id, CASE
      WHEN r.n_cand > 1 THEN 'fuzzy' WHEN r.n_cand = 1 THEN 'ref' WHEN q.term = '' THEN 'empty'
      WHEN {lang} = 'en' AND length(regexp_replace(q.term, '\\s+', '', 'g')) < 2 THEN 'too_short'
      ELSE 'word' END AS kind,
    r.book_idx, r.chapter, r.verse, r.verse_end,
    CASE WHEN r.query_id IS NOT NULL THEN r.verse IS NOT NULL END AS has_verse,
    CAST(r.cand_rank AS INTEGER) AS cand_rank, q.term, {lang} AS lang
  FROM split_q q LEFT JOIN resolved r ON q.query_id = r.query_id
)"""


CLASSIFY = classified(KNOWN, "'en'")

# DuckDB's url_encode leaves . _ ~ - bare; the URI component form leaves ! ' ( ) * bare too.
LINK = """'q=' || replace(replace(replace(replace(replace(url_encode({0}), '%21', '!'),
  '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"""

CITED = """
found AS (
  SELECT c.query_id, c.kind, c.lang, c.term, c.cand_rank, c.has_verse, a.verse, a.row_idx
  FROM classified c JOIN books b ON c.book_idx = b.idx JOIN conv a
    ON a.book_idx = c.book_idx AND a.chapter = c.chapter AND a.verse BETWEEN
      coalesce(c.verse, CASE WHEN c.kind = 'fuzzy' THEN 1 ELSE 0 END)
      AND coalesce(c.verse_end, c.verse, CASE WHEN c.kind = 'fuzzy' THEN 1
        ELSE coalesce(b.chapters[c.chapter], 0) END)
)"""

def omni(queries: str) -> str:
    return f"""WITH {CONV_BOOKS}, {queries}, {CLASSIFY}, {CITED},
asked AS (SELECT DISTINCT term FROM classified WHERE kind = 'word'),
toks AS (SELECT term, {TOKENS.format("term")} AS parts FROM asked),
hits AS (
  SELECT q.term, t.row_idx, len(q.parts) > 1 AND contains(t.lt, array_to_string(q.parts, ' ')) AS is_exact
  FROM (SELECT * FROM toks WHERE len(parts) > 0) q
  JOIN (SELECT row_idx, lower(text_en) AS lt FROM conv) t
    ON len(list_filter(q.parts, lambda p: NOT contains(t.lt, p))) = 0
)"""


OMNI = omni(RAW_QUERIES)

SIBLINGS = """
chap AS (
  SELECT idx AS book_idx, unnest(range(1, len(chapters) + 1)) AS chapter, unnest(chapters) AS n
  FROM books
),
ordered AS (
  SELECT book_idx, chapter, lag(book_idx) OVER w AS pb, lag(chapter) OVER w AS pc,
    lead(book_idx) OVER w AS nb, lead(chapter) OVER w AS nc
  FROM chap WINDOW w AS (ORDER BY book_idx, chapter)
),
firsts AS (
  SELECT c.book_idx, c.chapter, arg_min(v.row_idx, v.verse) AS row_idx
  FROM chap c JOIN conv v ON v.book_idx = c.book_idx AND v.chapter = c.chapter
    AND v.verse BETWEEN 0 AND c.n
  GROUP BY ALL
),
nav AS (
  SELECT o.book_idx, o.chapter, p.row_idx AS prev_row, n.row_idx AS next_row
  FROM ordered o LEFT JOIN firsts p ON p.book_idx = pb AND p.chapter = pc
  LEFT JOIN firsts n ON n.book_idx = nb AND n.chapter = nc
)"""


def html(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def marked(text: str, pattern: str) -> str:
    """Bracket matches with noncharacters, escape, then put the tags in."""
    found = f"regexp_replace({text}, {pattern}, chr(64976) || '\\0' || chr(64977), 'gi')"
    return f"replace(replace({html(found)}, chr(64976), '<mark>'), chr(64977), '</mark>')"


def pattern_of(term: str) -> str:
    """Pattern of a term and its whitespace-separated parts, longest first."""
    parts = f"list_filter(string_split_regex({term}, '\\s+'), lambda p: p <> '')"
    every = f"list_concat([trim({term})], {parts})"
    ordered = f"list_reverse(list_sort(list_transform({every}, lambda p: (length(p), p))))"
    return f"array_to_string(list_transform({ordered}, lambda s: regexp_escape(s[2])), '|')"


def _label(lang: str, row: str = "c") -> str:
    name = "coalesce(b.cn, b.en)" if lang == "cn" else "b.en"
    return f"{name} || ' ' || {row}.chapter || ':' || {row}.verse"


ANSWERS = f"""
        SELECT query_id, kind, lang, row_number() OVER (PARTITION BY query_id ORDER BY verse) AS rank,
          row_idx, false AS is_exact, NULL AS cand_kind, {LINK.format("term")} AS link
        FROM found WHERE kind = 'ref'
        UNION ALL
        SELECT query_id, kind, lang, cand_rank, row_idx, false,
          CASE WHEN has_verse THEN 'verse' ELSE 'chapter' END, {LINK.format("term")}
        FROM found WHERE kind = 'fuzzy'
        UNION ALL
        SELECT c.query_id, kind, lang, h.rank, row_idx, is_exact, NULL, {LINK.format("c.term")}
        FROM classified c JOIN (
          SELECT *, row_number() OVER (PARTITION BY term ORDER BY is_exact DESC, row_idx) AS rank
          FROM hits
        ) h ON c.term = h.term WHERE kind = 'word'"""

TOTALS = f"""
        counted AS (
          SELECT query_id, count(*) AS total FROM found GROUP BY query_id
          UNION ALL
          SELECT c.query_id, count(*) FROM classified c JOIN hits h ON c.term = h.term
          WHERE kind = 'word' GROUP BY c.query_id
        )
        SELECT c.query_id, kind, lang, coalesce(total, 0) AS total,
          CASE WHEN kind <> 'empty' THEN {LINK.format("c.term")} END AS link
        FROM classified c LEFT JOIN counted n ON c.query_id = n.query_id
        WHERE coalesce(cand_rank, 1) = 1"""

# Queries of links: the pages' and the events'

LINKED = (
    RAW_QUERIES.replace("queries AS (", "raw_queries AS (")
    + """,
links AS (
  SELECT raw AS q FROM raw_queries WHERE query_id >= 0
  UNION ALL
  SELECT regexp_extract(url, '/([a-z]+)/', 1) || ' ' || page_id % 50 || ':1 2' FROM pages WHERE page_id % 4 <> 0
),
queries AS (SELECT q AS query_id, q AS raw, count(*) AS n FROM links WHERE q <> '' GROUP BY q)"""
)

# Chinese


def in_characters(text: str) -> str:
    return f"translate(lower({text}), '{LETTERS}', '{CHARACTERS}')"


def lang_of(text: str) -> str:
    return f"CASE WHEN regexp_matches({text}, '[\\x{{3400}}-\\x{{9FFF}}\\x{{F900}}-\\x{{FAFF}}]') THEN 'cn' ELSE 'en' END"


CONV_CJK = f"""{CONV.replace("conv AS (", "conv_en AS (")},
conv AS (
  SELECT * REPLACE (CASE WHEN verse % 3 <> 2 THEN {in_characters("text_en")} END AS text_cn) FROM conv_en
)"""
CONV_BOOKS_CJK = f"""{CONV_BOOKS.replace(CONV, CONV_CJK).replace("books AS (", "books_en AS (")},
books AS (
  SELECT * REPLACE ({in_characters("en")} AS cn), {in_characters("alias")} AS cn_alias FROM books_en
)"""
RAW_QUERIES_CJK = f"""{RAW_QUERIES.replace("queries AS (", "queries_en AS (")},
queries AS (SELECT query_id, {in_characters("raw")} AS raw FROM queries_en)"""

# of the names that a query begins with the longest
KNOWN_CJK = f"""
names_cjk AS (SELECT cn AS alias, idx FROM books UNION ALL SELECT cn_alias, idx FROM books),
begun AS (
  SELECT query_id, arg_max(idx, length(alias)) AS idx, trim(substr(any_value(term), max(length(alias)) + 1)) AS num
  FROM split_q JOIN names_cjk ON starts_with(term, alias) WHERE {lang_of("term")} = 'cn' GROUP BY query_id
),
known AS (
  SELECT q.query_id, q.num, b.idx AS book_idx, b.chapters
  FROM split_q q JOIN aliases a ON q.name = a.name AND q.name <> '' JOIN books b ON a.idx = b.idx
  WHERE {lang_of("q.term")} = 'en'
  UNION ALL
  SELECT query_id, num, b.idx, b.chapters FROM begun q JOIN books b ON q.idx = b.idx
)"""
CLASSIFY_CJK = classified(KNOWN_CJK, lang_of("q.term"))

OMNI_CJK = f"""WITH {CONV_BOOKS_CJK}, {RAW_QUERIES_CJK}, {CLASSIFY_CJK}, {CITED},
asked AS (SELECT DISTINCT term, lang FROM classified WHERE kind = 'word'),
toks AS (
  SELECT term, lang, CASE WHEN lang = 'en' THEN {TOKENS.format("term")}
    ELSE list_filter(string_split_regex(term, '\\s+'), lambda p: p <> '') END AS parts FROM asked
),
texts AS (
  SELECT 'en' AS lang, row_idx, lower(text_en) AS lt FROM conv
  UNION ALL
  SELECT 'cn', row_idx, text_cn FROM conv WHERE text_cn IS NOT NULL
),
hits AS (
  SELECT q.term, t.row_idx, len(q.parts) > 1 AND contains(t.lt,
    CASE WHEN q.lang = 'en' THEN array_to_string(q.parts, ' ') ELSE array_to_string(q.parts, '') END) AS is_exact
  FROM (SELECT * FROM toks WHERE len(parts) > 0) q
  JOIN texts t ON q.lang = t.lang AND len(list_filter(q.parts, lambda p: NOT contains(t.lt, p))) = 0
)"""

ORACLE: dict[str, str] = {
    "token_postings": f"WITH {DOC_TOKENS} SELECT tok, row_idx FROM doc_tokens",
    "vocabulary": f"WITH {DOC_TOKENS} SELECT tok, count(*) AS df FROM doc_tokens GROUP BY tok",
    "bigram_postings": """
        SELECT DISTINCT substr(text, i, 2) AS tok, doc_id AS row_idx
        FROM (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents)""",
    "expand_vocab": f"""
        WITH {DOC_TOKENS},
        vocab AS (SELECT tok, count(*) AS df FROM doc_tokens GROUP BY tok),
        q AS (SELECT DISTINCT unnest({TOKENS.format("text")}) AS qtok FROM benchmark)
        SELECT qtok, tok, df FROM q JOIN vocab ON contains(tok, qtok)""",
    "search_single": f"WITH {ONE_WORD}, {DOC_HITS} {RANKED}",
    "search_and": f"WITH {TWO_WORDS}, {DOC_HITS} {RANKED}",
    "search_segments": f"""WITH {TWO_WORDS},
        {segment_hits("SELECT query_id, term FROM asked")}""",
    "search_one_char": f"""WITH {ONE_CHARACTER},
        {segment_hits("SELECT query_id, term FROM asked")}""",
    "search_totals": f"""WITH {TWO_WORDS}, {DOC_HITS}
        SELECT a.query_id, count(h.query_id) AS total
        FROM asked a LEFT JOIN hits h ON a.query_id = h.query_id GROUP BY ALL""",
    "search_topn": f"WITH {TWO_WORDS}, {DOC_HITS} {RANKED} WHERE rank <= 5",
    "search_page": f"""WITH {TWO_WORDS}, {DOC_HITS},
        totals AS (SELECT query_id, count(*) AS total FROM hits GROUP BY ALL)
        SELECT r.query_id, rank, row_idx, is_exact, 2 AS page, least(total, 40) AS shown,
          greatest(total - 40, 0) AS remaining, total
        FROM ranked r JOIN totals t ON r.query_id = t.query_id WHERE ceil(rank / 20) = 2""",
    "detect_language": """
        SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]')
          THEN 'cn' ELSE 'en' END AS code
        FROM documents""",
    "alias_dim": """
        WITH listed AS (
          SELECT p_partkey, 'en' AS kind, unnest([0, 1, 2]) AS pos,
            unnest([p_brand, p_type, p_name]) AS name FROM part
          UNION ALL
          SELECT p_partkey, 'cn', unnest([0, 1]), unnest([p_type || ' ' || p_size, upper(p_name)])
          FROM part
        ), keyed AS (
          SELECT p_partkey, kind, pos, CASE WHEN kind = 'en'
            THEN regexp_replace(lower(name), '[.\\s]', '', 'g') ELSE name END AS alias FROM listed
        )
        SELECT alias, kind, CAST(arg_max(p_partkey, (p_partkey, pos)) AS INTEGER) AS book_idx
        FROM keyed GROUP BY alias, kind""",
    "match_alias_exact": f"""WITH {REGION_BOOKS}, {CITATIONS}, {NAMES}
        SELECT query_id, idx AS book_idx, num FROM split_q q LEFT JOIN aliases a ON q.name = a.name""",
    "match_alias_prefix": """
        WITH asked AS (
          SELECT c_custkey AS query_id, n_name || ' 3:' || c_custkey AS q
          FROM customer JOIN nation ON c_nationkey = n_nationkey
        )
        SELECT query_id, q, arg_max(n_nationkey, length(n_name)) AS book_idx,
          trim(substr(q, max(length(n_name)) + 1)) AS num
        FROM asked JOIN nation ON starts_with(q, n_name) GROUP BY query_id, q""",
    "parse_address": f"""WITH {REGION_BOOKS}, {CITATIONS}, {NAMES}
        SELECT query_id, name, num, {PARTS}, regexp_extract(num, {ADDRESS}, 2) <> '' AS has_verse
        FROM split_q""",
    "validate_address": f"""WITH {REGION_BOOKS}, {CITATIONS}, {NAMES},
        placed AS (
          SELECT query_id, b.idx AS book_idx, len(b.chapters) AS n, {PARTS}
          FROM split_q q JOIN aliases a ON q.name = a.name JOIN books b ON a.idx = b.idx
        )
        SELECT query_id, book_idx, chapter, verse, verse_end FROM placed
        WHERE chapter BETWEEN 1 AND n""",
    "expand_fuzzy": f"""WITH {REGION_BOOKS},
        nums AS (
          SELECT o_orderkey AS query_id, CAST(o_orderkey % 5 + 1 AS INTEGER) AS book_idx,
            CAST(o_orderkey AS VARCHAR) AS num, chapters
          FROM orders JOIN books ON o_orderkey % 5 + 1 = idx
        ), {digit_readings("nums")}
        SELECT query_id, book_idx, num, chapter, verse, CAST(cand_rank AS INTEGER) AS cand_rank,
          CAST(n_cand AS INTEGER) AS n_cand FROM candidates""",
    "resolve_citations": f"""WITH {REGION_BOOKS}, {CITATIONS}, {CLASSIFY}
        SELECT * FROM classified WHERE kind IN ('ref', 'fuzzy')""",
    "classify_queries": f"""WITH {CONV_BOOKS}, {RAW_QUERIES}, {CLASSIFY}
        SELECT * FROM classified""",
    "candidate_counts": f"""WITH {CONV_BOOKS}, {RAW_QUERIES}, {CLASSIFY}
        SELECT query_id, count(*) AS n_cand FROM classified WHERE kind = 'fuzzy' GROUP BY query_id""",
    "address_dim": """
        SELECT l_orderkey AS book_idx, l_linenumber AS chapter, 1 AS verse,
          max(l_partkey * 1000000 + l_suppkey) AS row_idx
        FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "corpus_shape": f"""WITH {CONV_BOOKS},
        declared AS (
          SELECT idx AS book_idx, unnest(range(1, len(chapters) + 1)) AS chapter,
            unnest(chapters) AS n FROM books
        ), found AS (
          SELECT book_idx, chapter, count(*) AS n FROM conv WHERE verse >= 1 GROUP BY ALL
        )
        SELECT coalesce(d.book_idx, f.book_idx) AS book_idx,
          CAST(coalesce(d.chapter, f.chapter) AS INTEGER) AS chapter,
          coalesce(d.n, 0) AS declared, coalesce(f.n, 0) AS found
        FROM declared d FULL JOIN found f ON d.book_idx = f.book_idx AND d.chapter = f.chapter""",
    "lookup_point": f"""WITH {CONV}, {REQUESTS}
        SELECT r.query_id, r.book_idx, r.chapter, r.verse, c.row_idx FROM requests r JOIN conv c
          ON r.book_idx = c.book_idx AND r.chapter = c.chapter AND r.verse = c.verse""",
    "lookup_range": f"""WITH {CONV}, {REQUESTS}
        SELECT r.query_id, r.book_idx, r.chapter, c.verse, c.row_idx FROM requests r JOIN conv c
          ON r.book_idx = c.book_idx AND r.chapter = c.chapter
          AND c.verse BETWEEN r.verse AND r.verse_end""",
    "lookup_chapter": f"""WITH {CONV_BOOKS}, {REQUESTS}
        SELECT r.query_id, r.book_idx, r.chapter, c.verse, c.row_idx FROM requests r
        JOIN books b ON r.book_idx = b.idx
        JOIN conv c ON r.book_idx = c.book_idx AND r.chapter = c.chapter
          AND c.verse BETWEEN 0 AND b.chapters[r.chapter]""",
    "resolve_candidates": f"""WITH {CONV_BOOKS}, {RAW_QUERIES}, {CLASSIFY}
        SELECT f.query_id, f.cand_rank,
          CASE WHEN f.verse IS NULL THEN 'chapter' ELSE 'verse' END AS cand_kind, c.row_idx
        FROM classified f JOIN conv c ON f.book_idx = c.book_idx AND f.chapter = c.chapter
          AND coalesce(f.verse, 1) = c.verse
        WHERE f.kind = 'fuzzy'""",
    "chapter_context": f"""WITH {CONV_BOOKS},
        hits AS (SELECT event_id AS query_id, {ASKED_CONV} * 100 + event_id % 9 AS hit_row FROM events)
        SELECT h.query_id, h.hit_row, c.book_idx, c.chapter, c.verse, c.row_idx FROM hits h
        JOIN conv o ON h.hit_row = o.row_idx JOIN books b ON o.book_idx = b.idx
        JOIN conv c ON o.book_idx = c.book_idx AND o.chapter = c.chapter
          AND c.verse BETWEEN 0 AND b.chapters[o.chapter]""",
    "sibling_chapter": f"""WITH {CONV_BOOKS}, {SIBLINGS}
        SELECT c.row_idx, prev_row, next_row FROM conv c
        LEFT JOIN nav n ON c.book_idx = n.book_idx AND c.chapter = n.chapter""",
    "label_rows": f"""WITH {CONV_BOOKS}
        SELECT c.row_idx, {_label("en")} AS label_en, {_label("cn")} AS label_cn
        FROM conv c JOIN books b ON c.book_idx = b.idx""",
    "chapter_title": f"""WITH {CONV_BOOKS}
        SELECT t.book_idx, t.chapter, coalesce(b.cn, b.en) || ' ' || t.chapter AS title
        FROM turns t JOIN books b ON t.book_idx = b.idx""",
    "pick_text": f"WITH {CONV} SELECT row_idx, coalesce(text_cn, text_en) AS text FROM conv",
    "missing_translation": f"WITH {CONV} SELECT row_idx, text_cn IS NULL AS cn_missing FROM conv",
    "highlight": f"""WITH {CONV},
        words AS (SELECT row_idx, text_en, string_split(text_en, ' ') AS w FROM conv),
        places AS (SELECT row_idx, text_en, w, unnest(range(len(w))) AS pos FROM words),
        terms AS (SELECT row_idx, text_en, CAST(pos AS INTEGER) AS pos, array_to_string(w[pos + 1:pos + 2], ' ') AS term FROM places)
        SELECT row_idx, pos, term, {marked("text_en", pattern_of("term"))} AS html FROM terms""",
    "interlinear": f"""WITH {CONV}
        SELECT row_idx, 1 AS line_no, 'en' AS line_lang, text_en AS line FROM conv
        UNION ALL
        SELECT row_idx, 2, 'cn', coalesce(text_cn, text_en || ' (EN)') FROM conv""",
    "export_lines": f"""WITH {CONV_BOOKS}
        SELECT c.row_idx, {_label("cn")} || '  ' || coalesce(text_cn, text_en) AS line_cn,
          {_label("en")} || '  ' || text_en || chr(10) || {_label("cn")} || '  '
            || coalesce(text_cn, text_en) AS line
        FROM conv c JOIN books b ON c.book_idx = b.idx""",
    "select_rows": f"""WITH {CONV}
        SELECT row_idx, text_en FROM conv
        WHERE row_idx IN (SELECT {ASKED_CONV} * 100 + event_id % 9 FROM events)""",
    "chapter_view": f"""WITH {CONV_BOOKS}, {REQUESTS}, {SIBLINGS}
        SELECT r.query_id, coalesce(b.cn, b.en) || ' ' || r.chapter AS title, c.verse, c.row_idx,
          coalesce(c.text_cn, c.text_en) AS text, prev_row, next_row
        FROM requests r JOIN books b ON r.book_idx = b.idx
        JOIN conv c ON r.book_idx = c.book_idx AND r.chapter = c.chapter
          AND c.verse BETWEEN 0 AND b.chapters[r.chapter]
        LEFT JOIN nav n ON r.book_idx = n.book_idx AND r.chapter = n.chapter""",
    "fuzzy_view": f"""WITH {CONV_BOOKS}, {RAW_QUERIES}, {CLASSIFY}
        SELECT f.query_id, f.cand_rank,
          CASE WHEN f.verse IS NULL THEN 'chapter' ELSE 'verse' END AS cand_kind, c.row_idx,
          CASE WHEN f.verse IS NULL THEN b.en || ' ' || c.chapter ELSE {_label("en")} END AS label,
          CASE WHEN f.verse IS NOT NULL THEN c.text_en END AS text
        FROM classified f JOIN books b ON f.book_idx = b.idx
        JOIN conv c ON f.book_idx = c.book_idx AND f.chapter = c.chapter
          AND coalesce(f.verse, 1) = c.verse
        WHERE f.kind = 'fuzzy'""",
    "hit_view": f"""WITH {CONV_BOOKS}, {TWO_WORDS},
        passages AS (SELECT row_idx, text_en AS text FROM conv),
        {english_hits("passages", "row_idx")}
        SELECT r.query_id, a.term, r.rank, r.row_idx, r.is_exact, {_label("en")} AS label,
          {marked("c.text_en", pattern_of("a.term"))} AS html, false AS cn_missing
        FROM ranked r JOIN asked a ON r.query_id = a.query_id
        JOIN conv c ON r.row_idx = c.row_idx JOIN books b ON c.book_idx = b.idx
        WHERE rank <= 3""",
    "queries_from_links": """
        WITH links AS (
          SELECT page_id, regexp_extract(url, '/([a-z]+)/', 1) || '%20' || page_id % 50 || '%3A1+2' AS e
          FROM pages
        )
        SELECT replace(replace(e, '%20', ' '), '%3A', ':') AS q, count(*) AS n FROM links
        WHERE page_id % 4 <> 0 GROUP BY q""",
    "query_links": f"""
        SELECT item_id, {LINK.format("text")} AS link, text AS back FROM benchmark""",
    "omni_search_rows": f"{OMNI} {ANSWERS}",
    "omni_search_totals": f"{OMNI}, {TOTALS}",
    "answer_pages": f"""{OMNI}, answers AS ({ANSWERS}),
        totals AS (SELECT query_id, count(*) AS total FROM answers WHERE kind = 'word' GROUP BY query_id)
        SELECT a.*, 2 AS page, least(total, 40) AS shown, greatest(total - 40, 0) AS remaining, total
        FROM answers a JOIN totals t ON a.query_id = t.query_id
        WHERE kind = 'word' AND rank BETWEEN 21 AND 40""",
    "answer_status": f"{OMNI}, {TOTALS}",
    "answer_links": f"""{omni(LINKED)}, answers AS ({ANSWERS})
        SELECT a.query_id AS q, n, kind, lang, rank, row_idx, is_exact, cand_kind, link
        FROM answers a JOIN queries q ON a.query_id = q.query_id""",
    "detect_language_cjk": f"""WITH {CONV_CJK}
        SELECT row_idx, {lang_of("text_en")} AS lang_en, {lang_of("text_cn")} AS lang_cn
        FROM conv WHERE text_cn IS NOT NULL""",
    "classify_queries_cjk": f"""WITH {CONV_BOOKS_CJK}, {RAW_QUERIES_CJK}, {CLASSIFY_CJK}
        SELECT * FROM classified""",
    "omni_search_rows_cjk": f"{OMNI_CJK} {ANSWERS}",
    "omni_search_totals_cjk": f"{OMNI_CJK}, {TOTALS}",
}
