"""Manuscripts derived from the documents table.

The documents hold invented prose without headings, citations or faults, so each
becomes a manuscript: a front matter, its own lines with material planted by
(doc_id * 31 + line) % 28, and a bibliography.  The same text pieces make the
Spark table and the SQL view, so both engines read the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.corpus import spread

KINDS = 28
# What is planted behind a line, by kind.  {d} is the document's id, {i} the line's number.
PLANTS = {
    0: "' two  spaces stand here'",
    1: "' a word , then more'",
    2: "' it ended.next word'",
    3: "' a) first and an open (bracket here'",
    4: "' “quoted words'",
    5: "' pages 55-65 were read, call +91-8816867362'",
    6: "' a mass of 12kg and 5 mm in the 1970s'",
    7: "' most of the the result'",
    8: "concat(' see https://example.org/a', {d}, ' and doi:10.1000/x', {i}, '.')",
    9: "' as shown in [1, 3–5] and [2]'",
    10: "' as (Quill et al., 2019) and Jones (2020) say'",
    11: "' as Figure 3 shows'",
    12: "' the colour and behavior of a fibre'",
    13: "' the Automatic Gain Control (AGC) was set'",
    14: "' the AGC held'",
    15: "' so Eq. (4) holds'",
    16: "' as [Figure 2] gives'",
    17: "' at 550 °C and 80 °C'",
    18: "' with FeCl3 and H2O added'",
    19: "' the effect was not found'",
    20: "' Fig. 4 and Figure 5 agree'",
    21: "' R^2 of 0.98 at 12 mL'",
    22: "' it grew (Brown, 2018) [7] fast'",
    23: "' at 5 KJ and 3 MHZ'",
    24: "' it was reached. [17]'",
    25: "' from a well-known co-author'",
    26: "' iD 0000-0002-1825-0097 and 0000-0002-1825-0098'",
    27: "''",
}

HEAD = [
    "concat('Study number ', {d})",
    "'Ann Able, Bob Baker and Cy Cole'",
    "'Abstract'",
    "'The World Health Organization (WHO) did not report it; the WHO waits.'",
    "CASE WHEN {n} % 3 = 0 THEN 'Keywords: zeta; alpha, Beta' ELSE 'Keywords: gamma, delta' END",
    "'Introduction'",
]

TAIL = [
    "CASE WHEN {n} % 4 = 0 THEN 'Figure 3. What was seen' ELSE 'Figure 9. What was left' END",
    "'References'",
    "concat('[1]. Smith AB, Jones CD. Growth of things in water number ', {n} % 50, '. J Test Sci. 2019;12(3):45-67.')",
    "concat('[2]. Jones CD. Measures of heat. International Journal of the Heat. July 2020;7(1):', {n} % 40 + 1, '-', {n} % 40 + 60, '.')",
    "'[3] Able AA, Baker BB, Cole CC, Dunn DD, Ells EE, Ford FF, Gray GG. Many hands at work. Ann Work. 2018;3(2):11-19.'",
    "concat('[4]. Brown QX. Short of pages number ', {n} % 9, ' and more words here. J Gaps. 2018.')",
    "CASE WHEN {n} % 5 = 0 THEN '[5]. Brown QX. Short of pages number 1 and more words here. J Gaps. 2018.' ELSE '[5]. Moss TT. Of mosses and stones in the north. Moss Lett. 2001;4(4):5-9. https://doi.org/10.1000/moss' END",
]


def _filled(piece: str) -> str:
    return piece.format(d="CAST(doc_id AS STRING)", n="doc_id", i="CAST(i AS STRING)")


def _plants(line: str, number: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {v.format(d='CAST(doc_id AS STRING)', i=f'CAST({number} AS STRING)')}" for k, v in PLANTS.items())
    return f"concat({line}, CASE (doc_id * 31 + {number}) % {KINDS} {cases} ELSE '' END)"


def manuscripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, text) of all documents' manuscripts."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    head, tail = (", ".join(_filled(x) for x in part) for part in (HEAD, TAIL))
    body = f"transform(split(text, '\\n'), (line, i) -> {_plants('line', 'i')})"
    return docs.select("doc_id", F.posexplode(F.expr(f"concat(array({head}), {body}, array({tail}))")).alias("idx", "text"))


def manuscripts_sql() -> str:
    """The same rows as a query for DuckDB."""
    head, tail = (", ".join(_filled(x) for x in part) for part in (HEAD, TAIL))
    body = f"list_transform(string_split(text, chr(10)), lambda line, i: {_plants('line', '(i - 1)')})"
    return (
        f"SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS idx, unnest(l) AS text "
        f"FROM (SELECT doc_id, list_concat(list_concat([{head}], {body}), [{tail}]) AS l FROM documents WHERE text IS NOT NULL)"
    )


# What an edit does to a paragraph, by (doc_id * 17 + idx) % 13; {t} is the paragraph.
EDITS = {
    0: "''",
    1: "substr({t}, 1, CAST(length({t}) AS INTEGER) - CAST(length({t}) AS INTEGER) % 2 - CAST(floor(length({t}) / 2) AS INTEGER))",
    2: "replace({t}, 'not ', '')",
    3: "replace({t}, 'R^2', 'R2')",
    4: "replace({t}, 'https://', '')",
    5: "replace({t}, '12kg', '12 kg')",
    6: "replace({t}, 'Figure', 'Fig.')",
    7: "replace({t}, 'co-author', 'coauthor')",
    8: "replace({t}, 'H2O', 'water')",
    9: "replace(replace({t}, 'and [2]', 'and [8]'), 'Smith AB, ', '')",
    10: "replace({t}, 'Bob Baker', 'B. Baker')",
    11: "replace({t}, 'fibre', 'fiber')",
}


def edited(t: str = "text") -> str:
    cases = " ".join(f"WHEN {k} THEN {v.format(t=t)}" for k, v in EDITS.items())
    return f"CASE (doc_id * 17 + idx) % 13 {cases} ELSE {t} END"


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, idx, original, edited): the manuscripts with edits that lose content in known ways."""
    return manuscripts(spark, sf_dir).selectExpr("doc_id", "idx", "text AS original", f"{edited()} AS edited")


def revisions_sql() -> str:
    return f"SELECT doc_id, idx, text AS original, {edited()} AS edited FROM ({manuscripts_sql()})"


def with_views(sql: str) -> str:
    """sql with the views p (manuscripts) and r (revisions) where it reads them."""
    views = []
    if re.search(r"\bFROM r\b|\bJOIN r\b", sql):
        views.append(f"r AS ({revisions_sql()})")
    views.append(f"p AS ({manuscripts_sql()})")
    body = sql.strip()
    return f"WITH {', '.join(views)}" + (f", {body[5:]}" if body.upper().startswith("WITH ") else f" {body}")
