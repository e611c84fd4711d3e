"""SQL of further registered queries, whose rows follow from what is planted."""

from __future__ import annotations

import re

from ..functions.rewrites import SMALL_WORDS
from ..operators import layout
from . import structure
from .registry import _FOUND as FOUND
from .registry import ASCII, ENTRIES, FOLDED, IS_REF, SURNAME, WORKS_SQL, YEAR, ZONES

CAPTION = r"(?i)^\s*(fig|figure|table|scheme|eq|equation)\.?\s*[:\-–]?\s*(\d+)"


def _captions(column: str) -> str:
    kind = f"CASE lower(regexp_extract({column}, '{CAPTION}', 1)) WHEN 'fig' THEN 'figure' WHEN 'eq' THEN 'equation' ELSE lower(regexp_extract({column}, '{CAPTION}', 1)) END"
    return f"SELECT doc_id, {kind} AS kind, regexp_extract({column}, '{CAPTION}', 2) AS number, count(*) AS n FROM r WHERE regexp_matches({column}, '{CAPTION}') GROUP BY ALL"


BODY = r"regexp_replace(text, '^\s*\[?\d{1,3}[\].)]{0,2}\s*', '')"
JOURNAL = r"((?:19|20)\d{2})\s*;\s*(\d{1,4})\s*(?:\(([^)]*)\))?\s*:\s*(\w+\s*[-–]?\s*\w*)"
AGC = f"regexp_matches({ASCII}, '\\bAGC\\b')"

SQL = {
    "ms12_links": r"""SELECT doc_id, idx, 'url' AS kind, regexp_extract(text, 'https://example\.org/a\d+') AS href, regexp_extract(text, 'https://example\.org/a\d+') AS written FROM p WHERE contains(text, 'https://example.org/a')
      UNION ALL SELECT doc_id, idx, 'doi', concat('https://doi.org/', regexp_extract(text, '10\.1000/x\d+')), regexp_extract(text, 'doi:10\.1000/x\d+') FROM p WHERE contains(text, 'doi:10.1000/x')
      UNION ALL SELECT doc_id, idx, 'doi', 'https://doi.org/10.1000/moss', 'https://doi.org/10.1000/moss' FROM p WHERE contains(text, '10.1000/moss')
      UNION ALL SELECT doc_id, idx, 'email', concat('mailto:', m), m FROM (SELECT doc_id, idx, unnest(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.-]+\w')) AS m FROM p) e""",
    "census_diff": f"WITH a AS ({_captions('original')}), b AS ({_captions('edited')}), g AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.kind, b.kind) AS kind, coalesce(a.number, b.number) AS number, coalesce(a.n, 0) - coalesce(b.n, 0) AS gap FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.kind = b.kind AND a.number = b.number) SELECT doc_id, kind, number, CASE WHEN gap > 0 THEN 'lost' ELSE 'surplus' END AS change, abs(gap) AS times FROM g WHERE gap <> 0",
    "ref_parse": f"""WITH {ZONES}, {ENTRIES}, b AS (SELECT doc_id, ref_no, {BODY} AS body FROM e)
      SELECT doc_id, ref_no, CASE WHEN regexp_matches(body, '{JOURNAL}') THEN 'journal' ELSE 'other' END AS kind, string_split_regex(body, '\\.\\s+')[1] AS authors,
      coalesce(nullif(regexp_extract(body, '{JOURNAL}', 1), ''), nullif(regexp_extract(body, '\\b((?:19|20)\\d{{2}})\\b', 1), '')) AS year, nullif(regexp_extract(body, '{JOURNAL}', 2), '') AS volume, nullif(regexp_extract(body, '{JOURNAL}', 3), '') AS issue, nullif(regexp_extract(body, '{JOURNAL}', 4), '') AS pages FROM b""",
    "journal_style": "SELECT doc_id, CAST(2 AS INTEGER) AS ref_no, 'International Journal of the Heat' AS journal FROM documents WHERE text IS NOT NULL",
    "complete_refs": "SELECT doc_id, CAST(k AS INTEGER) AS ref_no, '10.5555/w0' AS doi, CAST(1 AS DOUBLE) AS score, 'Brown QX. Short of pages number 0 and more words here. J Gaps. 2018;7(1):1-9. https://doi.org/10.5555/w0' AS entry FROM documents, (SELECT unnest([4, 5]) AS k) n WHERE text IS NOT NULL AND (k = 4 OR doc_id % 5 = 0)",
    "fill_dois": f"""WITH {ZONES}, {ENTRIES}, k AS (SELECT DISTINCT doc_id % 9 AS k FROM documents WHERE text IS NOT NULL), {WORKS_SQL},
      x AS (SELECT doc_id, ref_no, text, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS sq, list_distinct(regexp_extract_all(lower(text), '[a-z]{{4,}}')) AS tw FROM e WHERE NOT regexp_matches(text, '10\\.\\d{{4,9}}/')),
      t AS (SELECT *, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS sq, list_distinct(regexp_extract_all(lower(title), '[a-z]{{4,}}')) AS tw FROM works), s AS (SELECT doc_id, ref_no, x.sq, x.text, doi, t.sq AS tsq, t.type, round(100 * len(list_intersect(t.tw, x.tw)) / len(t.tw), 6) AS score FROM x, t),
      b AS (SELECT * FROM s WHERE score > 55 AND (contains(sq, tsq) OR score >= 85) AND NOT (contains(type, 'review') AND NOT contains(lower(text), 'review')) QUALIFY row_number() OVER (PARTITION BY doc_id, ref_no ORDER BY score DESC, doi) = 1),
      o AS (SELECT doc_id, ref_no, min(doi) AS doi FROM x, (SELECT doi, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS tsq FROM second) y WHERE length(tsq) >= 12 AND (contains(x.sq, substr(tsq, 1, 30)) OR contains(tsq, substr(x.sq, 1, 30))) AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.ref_no = x.ref_no) GROUP BY ALL)
      SELECT doc_id, ref_no, doi, score, 'works' AS source FROM b UNION ALL SELECT doc_id, ref_no, doi, NULL, 'secondary' FROM o""",
    "number_citations": "SELECT doc_id, idx, CAST(2 AS INTEGER) AS ref_no FROM p WHERE contains(text, 'Jones (2020)') UNION ALL SELECT doc_id, idx, 4 FROM p WHERE contains(text, '(Brown, 2018)') AND doc_id % 5 <> 0",
    "acronyms": f"""WITH d AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY doc_id) AS t FROM p WHERE contains(text, 'Gain Control (AGC) was')), f AS (SELECT doc_id, idx AS fd, t FROM d WHERE k = 1),
      u AS (SELECT p.doc_id, idx, fd, t FROM p JOIN f ON p.doc_id = f.doc_id WHERE {AGC} AND NOT {IS_REF}), x AS (SELECT doc_id, fd, t, count(*) FILTER (idx >= fd) AS later, min(idx) AS first FROM u GROUP BY ALL)
      SELECT doc_id, first AS idx, 'acronym.used_before_definition' AS rule, 'AGC' AS acronym FROM x WHERE first < fd UNION ALL SELECT doc_id, idx, 'acronym.defined_twice', 'AGC' FROM d WHERE k = 2 UNION ALL SELECT doc_id, fd, 'acronym.defined_but_unused', 'AGC' FROM x WHERE t = 1 AND later <= 1""",
    "cross_references": f"""WITH m AS (SELECT DISTINCT doc_id, n FROM p, (SELECT unnest([3, 2, 4, 5]) AS n, unnest(['as Figure 3 shows', '[Figure 2] gives', 'Fig. 4 and Figure', 'and Figure 5 agree']) AS w) x WHERE contains(text, w) AND NOT {IS_REF}), c AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 3 ELSE 9 END AS n FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, 'Figure' AS kind, CAST(n AS INTEGER) AS n, 'reference.no_caption' AS rule FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = m.doc_id AND c.n = m.n) UNION ALL SELECT doc_id, 'Figure', n, 'caption.not_cited' FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE c.doc_id = m.doc_id AND c.n = m.n)""",
    "table_captions": f"WITH t AS ({structure.duck(structure.TABLES)}) SELECT doc_id, table_no, 'table.caption' AS rule FROM t WHERE after_idx % 2 = 1",
    "table_cells": f"WITH c AS ({structure.duck(structure.CELLS)}) SELECT doc_id, table_no, array_to_string(list_transform(list_sort(list(DISTINCT CAST(size AS DOUBLE))), lambda x: CAST(x AS VARCHAR)), ',') AS sizes, avg(CAST(bold AS INTEGER)) AS bold_share FROM c GROUP BY doc_id, table_no HAVING count(DISTINCT size) > 1",
    "front_matter": "SELECT doc_id, 'front.title-size' AS rule FROM documents WHERE text IS NOT NULL",
    "collapse_repeats": f"WITH h AS (SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM p WHERE contains(text, '12kg') AND NOT {IS_REF}) SELECT doc_id, 'unit.spacing' AS rule, idx, CAST(1 AS BIGINT) AS n FROM h WHERE k <= 3 UNION ALL SELECT doc_id, 'unit.spacing', min(idx), count(*) FROM h WHERE k > 3 GROUP BY doc_id",
    "guard_compounds": "SELECT doc_id, idx, 'keep_closed_compounds' AS guard, 'Introduction' AS snippet, 'Introduction' AS restored FROM p WHERE text = 'Introduction'",
    "fil_formulas": "SELECT f AS match, count(*) AS n FROM p, (SELECT unnest(['FeCl3', 'H2O']) AS f) x WHERE contains(text, concat(' ', f, ' ')) GROUP BY f",
    "rw8_all_formulas": "SELECT doc_id, idx, replace(replace(text, 'FeCl3', 'FeCl₃'), 'H2O', 'H₂O') AS new_text FROM p WHERE contains(text, 'with FeCl3 and H2O added')",
    # the manuscripts' front matter is known; their lists' entries are numbered
    "article_tables": f"""WITH {ZONES}, h AS (SELECT *, {FOLDED} AS folded, text IN ('Abstract', 'Introduction') OR (zone = 'references' AND regexp_matches({FOLDED}, '^(list of )?references?$|^bibliography$')) AS head FROM z
      ), s AS (SELECT *, CAST(count(*) FILTER (head) OVER w AS INTEGER) AS section, last_value(CASE WHEN head THEN trim(text) END IGNORE NULLS) OVER w AS heading, count(*) FILTER (zone = 'references' AND NOT head AND trim(text) <> '') OVER (PARTITION BY doc_id) AS n_entries FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY idx)
      ), k AS (SELECT *, CASE WHEN idx = 0 THEN 'title' WHEN idx = 1 THEN 'byline' WHEN idx = 4 THEN 'keywords' WHEN head THEN 'heading' WHEN zone = 'references' THEN 'reference' WHEN section = min(CASE WHEN head AND folded = 'abstract' THEN section END) OVER (PARTITION BY doc_id) AND trim(text) <> '' THEN 'abstract' WHEN regexp_matches(text, '^Figure [39]\\. What was') THEN 'caption' ELSE 'text' END AS kind FROM s)
      SELECT doc_id, idx, kind, section, heading, CASE kind WHEN 'caption' THEN left(text, 8) END AS label, CASE kind WHEN 'heading' THEN 1 END AS depth, CASE kind WHEN 'caption' THEN substr(text, 11) WHEN 'keywords' THEN substr(text, 11) ELSE trim(text) END AS content,
        CASE kind WHEN 'byline' THEN 'Ann Able|Bob Baker|Cy Cole' WHEN 'keywords' THEN replace(replace(substr(text, 11), '; ', '|'), ', ', '|') END AS items,
        CASE WHEN kind IN ('text', 'caption') THEN array_to_string(list_filter(regexp_extract_all(array_to_string(regexp_extract_all(text, '\\[\\d+(?:\\s*[,–-]\\s*\\d+)*\\]'), ' '), '\\d+'), lambda x: try_cast(x AS BIGINT) BETWEEN 1 AND n_entries), ',') END AS xrefs FROM k""",
    "abbreviations": "SELECT doc_id, 'WHO' AS acronym, 'World Health Organization' AS phrase FROM documents WHERE text IS NOT NULL UNION ALL SELECT DISTINCT doc_id, 'AGC', 'Automatic Gain Control' FROM p WHERE contains(text, 'Gain Control (AGC) was')",
    "guard_protected": r"""SELECT doc_id, idx, 'restore_protected_text' AS guard, substr(original, 1, 80) AS snippet, original AS restored FROM (SELECT *, list_transform(regexp_extract_all(original, '(?i)\b(?:fig(?:ure)?|tab(?:le)?)\s*[.:\-–—]?\s*\d+'), lambda x: concat(lower(substr(x, 1, 3)), regexp_extract(x, '\d+$'))) AS was,
      list_transform(regexp_extract_all(edited, '(?i)\b(?:fig(?:ure)?|tab(?:le)?)\s*[.:\-–—]?\s*\d+'), lambda x: concat(lower(substr(x, 1, 3)), regexp_extract(x, '\d+$'))) AS now FROM r WHERE original <> edited AND original <> '' AND edited <> '') x WHERE len(list_filter(was, lambda x: NOT list_contains(now, x))) > 0""",
    "guard_entry_numbers": f"""WITH {ZONES}, w AS (SELECT r.doc_id, r.idx, original, CASE WHEN r.doc_id % 2 = 0 THEN regexp_replace(edited, '^\\[\\d\\]\\. ', '') ELSE edited END AS e FROM r JOIN z ON z.doc_id = r.doc_id AND z.idx = r.idx WHERE zone = 'references'),
      x AS (SELECT *, regexp_extract(original, '^\\s*(?:\\[\\d{{1,3}}\\]\\.?|\\d{{1,3}}[.)])\\s*') AS number, list_distinct(list_filter(regexp_extract_all(lower(original), '[a-z]{{3,}}'), lambda x: x NOT IN ('and', 'the', 'of', 'in'))) AS a, list_distinct(list_filter(regexp_extract_all(lower(e), '[a-z]{{3,}}'), lambda x: x NOT IN ('and', 'the', 'of', 'in'))) AS b FROM w WHERE original <> e AND original <> '' AND e <> '')
      SELECT doc_id, idx, 'restore_reference_numbering' AS guard, substr(original, 1, 80) AS snippet, CASE WHEN len(list_intersect(a, b)) / greatest(len(a), 1) >= 0.4 THEN concat(number, ltrim(e)) END AS restored FROM x WHERE number <> '' AND NOT regexp_matches(e, '^\\s*(?:\\[\\d{{1,3}}\\]\\.?|\\d{{1,3}}[.)])')""",
}
SQL["author_gaps"] = f"SELECT doc_id, CAST(0 AS INTEGER) AS place, rule, count(*) AS n FROM ({SQL['acronyms']}) a WHERE rule = 'acronym.used_before_definition' GROUP BY ALL"
#: All rules of the proofreading job, from the parts' own SQL.
SQL["proofread_scan"] = f"""{FOUND}, k AS (SELECT rule, n FROM f WHERE n > 0 UNION ALL SELECT rule, 1 FROM ({SQL['acronyms']}) a UNION ALL SELECT rule, 1 FROM ({SQL['cross_references']}) c UNION ALL SELECT 'abstract.abbreviation', 1 FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT DISTINCT ON (doc_id, w) 'format.formula-subscript', 1 FROM p, (SELECT unnest(['FeCl3', 'H2O']) AS w) x WHERE contains(text, concat(' ', w, ' ')) UNION ALL SELECT 'keywords.count', 1 FROM p WHERE starts_with(text, 'Keywords:')
  UNION ALL SELECT DISTINCT ON (doc_id) 'equation.no_number', 1 FROM p WHERE contains(text, 'Eq. (4)') UNION ALL SELECT 'label.clash', 1 FROM (SELECT doc_id FROM p GROUP BY doc_id HAVING sum(len(regexp_extract_all({ASCII}, '\\bFig\\.\\s*\\d'))) > 0 AND sum(len(regexp_extract_all({ASCII}, '\\bFigure\\s*\\d'))) > 0) l)
  SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY rule"""
LOOKS = f"""u AS ({structure.duck(structure.RUNS)}), looks AS (SELECT a.doc_id, a.idx, a.font_name AS font, b.font_size_pt AS size
  FROM (SELECT doc_id, idx, font_name, row_number() OVER (PARTITION BY doc_id, idx ORDER BY sum(length(text)) DESC, font_name) AS k FROM u GROUP BY doc_id, idx, font_name) a
  JOIN (SELECT doc_id, idx, font_size_pt, row_number() OVER (PARTITION BY doc_id, idx ORDER BY sum(length(text)) DESC, font_size_pt) AS k FROM u GROUP BY doc_id, idx, font_size_pt) b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.k = 1 AND b.k = 1)"""
LETTERS = r"regexp_replace({t}, '[^\p{{L}}]', '', 'g')"
CAPPED = r"regexp_matches(w, '^[^\p{L}]*\p{Lu}')"
SMALL = ", ".join(f"'{w}'" for w in SMALL_WORDS)
SPEC = ", ".join(f"({n}, '{c}', {b}, {'NULL' if i is None else i}, {'NULL' if a is None else repr(a)})" for n, (c, b, i, a) in layout.HEADINGS.items())
SQL["heading_scan"] = f"""WITH x AS ({structure.duck(structure.FORMATS)}), u AS ({structure.duck(structure.RUNS)}), v AS (SELECT doc_id, idx, CASE WHEN count(bold) > 0 THEN bool_and(coalesce(bold, false)) END AS bold, CASE WHEN count(italic) > 0 THEN bool_and(coalesce(italic, false)) END AS italic FROM u WHERE trim(text) <> '' GROUP BY ALL),
  spec(level, want_case, want_bold, want_italic, want_align) AS (VALUES {SPEC}), c AS (SELECT *, outline_level + 1 AS level, {LETTERS.format(t='text')} AS letters, list_filter(regexp_split_to_array(trim(text), '[\\s/–—-]+'), lambda w: regexp_matches(w, '\\p{{L}}')) AS words FROM x WHERE outline_level IS NOT NULL),
  l AS (SELECT *, words[2:] AS rest, list_filter(words[2:], lambda w: NOT {CAPPED}) AS small FROM c),
  k AS (SELECT *, CASE WHEN letters = '' THEN 'unknown' WHEN letters = upper(letters) THEN 'upper' WHEN len(list_filter(words[:1], lambda w: {CAPPED})) = 0 THEN 'mixed' WHEN len(rest) = len(small) THEN 'sentence' WHEN len(list_filter(small, lambda w: lower({LETTERS.format(t='w')}) NOT IN ({SMALL}))) = 0 THEN 'title' ELSE 'mixed' END AS cased FROM l),
  h AS (SELECT k.doc_id, k.idx, k.cased, k.alignment, v.bold, v.italic, spec.* FROM k JOIN spec ON spec.level = k.level LEFT JOIN v ON v.doc_id = k.doc_id AND v.idx = k.idx)
  SELECT doc_id, idx, 'heading.case' AS rule FROM h WHERE cased <> 'unknown' AND cased <> want_case UNION ALL SELECT doc_id, idx, 'heading.bold' FROM h WHERE bold <> want_bold UNION ALL SELECT doc_id, idx, 'heading.italic' FROM h WHERE italic <> want_italic UNION ALL SELECT doc_id, idx, 'heading.alignment' FROM h WHERE alignment <> want_align"""
SQL["body_text"] = f"""WITH {ZONES}, x AS ({structure.duck(structure.FORMATS)}), {LOOKS}, b AS (SELECT z.doc_id, z.idx, x.alignment, x.first_line_in, l.font, l.size FROM z JOIN x ON x.doc_id = z.doc_id AND x.idx = z.idx LEFT JOIN looks l ON l.doc_id = z.doc_id AND l.idx = z.idx WHERE zone = 'body' AND length(trim(z.text)) >= 120 AND outline_level IS NULL AND num_id IS NULL),
  f AS (SELECT doc_id, idx, 'body.font' AS rule, coalesce(font <> 'Times New Roman', false) AS bad FROM b UNION ALL SELECT doc_id, idx, 'body.size', coalesce(abs(size - 11) > 0.01, false) FROM b UNION ALL SELECT doc_id, idx, 'body.alignment', coalesce(alignment <> 'justify', false) FROM b UNION ALL SELECT doc_id, idx, 'body.first-line-indent', first_line_in IS NULL OR abs(first_line_in - 0.15) > 0.01 FROM b)
  SELECT doc_id, rule, count(*) FILTER (bad) AS bad, count(*) AS total, min(idx) FILTER (bad) AS first FROM f GROUP BY doc_id, rule HAVING count(*) FILTER (bad) / count(*) >= 0.3"""
SQL["reference_layout"] = f"""WITH {ZONES}, {ENTRIES}, x AS ({structure.duck(structure.FORMATS)}), {LOOKS}, rr AS (SELECT e.doc_id, avg(regexp_matches(e.text, '^\\s*\\[?\\d{{1,3}}[\\].)]')::INT) AS numbered, avg(coalesce(x.first_line_in < 0, false)::INT) AS hanging, avg(coalesce(abs(l.size - 11) > 0.01, false)::INT) AS sized
  FROM e LEFT JOIN x ON x.doc_id = e.doc_id AND x.idx = e.idx LEFT JOIN looks l ON l.doc_id = e.doc_id AND l.idx = e.idx GROUP BY e.doc_id)
  SELECT doc_id, 'references.numbering' AS rule FROM rr WHERE numbered < 0.5 UNION ALL SELECT doc_id, 'references.hanging' FROM rr WHERE hanging < 0.5 UNION ALL SELECT doc_id, 'references.size' FROM rr WHERE sized >= 0.3"""
NORM = "trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g'))"
SQL["cell_edits"] = f"""WITH c AS (SELECT *, {NORM.format(t='original')} AS a, {NORM.format(t='edited')} AS b, regexp_split_to_array(original, '\\s+') AS wa, regexp_split_to_array(edited, '\\s+') AS wb FROM ({structure.duck(structure.EDITED_CELLS)}) q),
  m AS (SELECT DISTINCT x.doc_id, x.table_no, x.row, x.col FROM c x JOIN c y ON y.doc_id = x.doc_id AND y.table_no = x.table_no AND y.a = x.b AND y.a <> '' AND (y.row <> x.row OR y.col <> x.col) WHERE x.original <> x.edited),
  k AS (SELECT c.*, m.row IS NOT NULL AS moved, list_distinct(list_filter(string_split(a, ' '), lambda w: w <> '')) AS da, list_distinct(list_filter(string_split(b, ' '), lambda w: w <> '')) AS db FROM c LEFT JOIN m ON m.doc_id = c.doc_id AND m.table_no = c.table_no AND m.row = c.row AND m.col = c.col WHERE original <> edited),
  j AS (SELECT doc_id, table_no, row, col, CASE WHEN moved THEN 'another cell''s text' WHEN len(list_intersect(da, db)) / greatest(len(da), 1) < 0.5 THEN 'too few own words' WHEN len(wa) = len(wb) AND len(list_filter(range(1, len(wa) + 1), lambda i: wa[i] <> wb[i] AND lower(wa[i]) = lower(wb[i]) AND regexp_matches(wa[i], '^[a-z]') AND regexp_matches(wb[i], '^[A-Z]'))) >= 2 THEN 'title casing' END AS reason FROM k)
  SELECT * FROM j WHERE reason IS NOT NULL"""
#: The layout job's findings by rule, from the parts' own SQL.
SQL["layout_scan"] = f"""WITH i AS ({structure.duck(structure.IMAGES)}), s AS ({structure.duck(structure.SECTIONS)}), x AS ({structure.duck(structure.FORMATS)}), n AS (SELECT outline_level AS level, lag(outline_level) OVER (PARTITION BY doc_id ORDER BY idx) AS before FROM x WHERE outline_level IS NOT NULL), f AS (
    SELECT rule FROM ({SQL['heading_scan']}) a UNION ALL SELECT 'heading.skipped-level' FROM n WHERE level > before + 1 UNION ALL SELECT 'page.geometry' FROM s, (SELECT unnest(['w', 'l', 'b']) AS side) q WHERE (side = 'w' AND abs(width_in - 8.27) > 0.02) OR (side = 'l' AND abs(left_in - 1.0) > 0.02) OR (side = 'b' AND abs(bottom_in - 0.5) > 0.02)
    UNION ALL SELECT 'artwork.size' FROM i WHERE in_w > 9.01 OR in_h > 6.01 UNION ALL SELECT 'image.resolution' FROM i WHERE in_w > 0.5 AND in_h > 0.5 AND round_even(least(px_w / in_w, px_h / in_h), 0) < 300 UNION ALL SELECT 'table.caption' FROM ({structure.duck(structure.TABLES)}) t
    UNION ALL SELECT rule FROM ({SQL['body_text']}) b UNION ALL SELECT rule FROM ({SQL['reference_layout']}) l UNION ALL SELECT rule FROM ({SQL['front_matter']}) m)
  SELECT rule, count(*) AS n FROM f GROUP BY rule"""
_LEARNED = """w AS (SELECT doc_id, list_distinct(regexp_extract_all(original, '[A-Za-z]{4,}')) AS a, list_distinct(regexp_extract_all(edited, '[A-Za-z]{4,}')) AS b FROM r WHERE original <> edited AND original <> '' AND edited <> ''),
  v AS (SELECT doc_id, list_filter(a, lambda x: NOT list_contains(b, x)) AS o, list_filter(b, lambda x: NOT list_contains(a, x)) AS n FROM w), l AS (SELECT doc_id, o[1] AS o, min(n[1]) AS n FROM v WHERE len(o) = 1 AND len(n) = 1 AND (lower(o[1]) = lower(n[1]) OR levenshtein(o[1], n[1]) <= 2) GROUP BY doc_id, o[1] HAVING count(DISTINCT n[1]) = 1),
  t AS (SELECT doc_id, map_from_entries(list(row(o, n))) AS m FROM l GROUP BY doc_id)"""
_APPLIED = "array_to_string(list_transform(regexp_extract_all(edited, '[A-Za-z]+|[^A-Za-z]+'), lambda x: coalesce(m[x], x)), '')"
SQL["propagate_changes"] = f"WITH {_LEARNED}, e AS (SELECT r.doc_id, idx, edited AS text, edited, m FROM r JOIN t ON t.doc_id = r.doc_id), k AS (SELECT doc_id, idx, {_APPLIED} AS fixed, edited FROM e WHERE NOT {IS_REF}) SELECT doc_id, idx, fixed AS text FROM k WHERE fixed <> edited"
SQL["propagate_cells"] = f"WITH {_LEARNED}, k AS (SELECT c.doc_id, table_no, row, col, {_APPLIED} AS text, edited FROM ({structure.duck(structure.EDITED_CELLS)}) c JOIN t ON t.doc_id = c.doc_id) SELECT doc_id, table_no, row, col, text FROM k WHERE text <> edited"
SQL["first_use"] = "WITH k AS (SELECT doc_id, idx, edited, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM r WHERE contains(lower(edited), 'automatic gain control (agc)')) SELECT doc_id, idx, replace(edited, 'Automatic Gain Control (AGC)', 'AGC') AS text FROM k WHERE k > 1"


def _on(sql: str, column: str) -> str:
    """An expression over `text`, over another column."""
    return re.sub(r"\btext\b", column, sql)


_WHO = f"CASE WHEN {SURNAME} <> '' AND {YEAR} <> '' THEN concat({SURNAME}, ' ', {YEAR}) END"
_MARKERS = r"regexp_extract_all({c}, '\[\d+(?:\s*[,–-]\s*\d+)*\]')"
SQL["moved_numbers"] = f"""WITH s AS (SELECT doc_id FROM r WHERE {_on(IS_REF, 'original')} GROUP BY doc_id HAVING bool_and(({_on(_WHO, 'original')}) IS NOT DISTINCT FROM ({_on(_WHO, 'edited')}))),
  b AS (SELECT r.doc_id, idx, {_MARKERS.format(c='original')} AS was, {_MARKERS.format(c='edited')} AS now FROM r JOIN s ON s.doc_id = r.doc_id WHERE original <> edited AND original <> '' AND edited <> '' AND NOT {_on(IS_REF, 'original')})
  SELECT doc_id, idx, array_to_string(was, ' ') AS was, array_to_string(now, ' ') AS now FROM b WHERE len(was) = len(now) AND was <> now"""
