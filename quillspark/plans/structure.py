"""Structure tables derived from the manuscripts: runs, formats, tables, sections, images, cells, revisions of cells.

The documents carry no formatting, so each paragraph's is fixed by arithmetic on
its document and place; every row comes from a row of the documents table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import planting

# The same expressions serve both engines.
RUNS = """SELECT doc_id, idx, k AS run_no, CASE k WHEN 0 THEN substr(text, 1, 40) ELSE substr(text, 41) END AS text,
  CASE WHEN (doc_id + idx + k) % 4 = 0 THEN NULL ELSE (doc_id + idx) % 3 = 0 END AS bold, CASE WHEN (doc_id + idx) % 5 = 0 THEN NULL ELSE (doc_id + idx + k) % 2 = 0 END AS italic,
  CASE WHEN (doc_id + k) % 6 = 0 THEN 'Cambria' ELSE 'Times New Roman' END AS font_name, CASE WHEN (doc_id * 3 + idx + k) % 4 = 0 THEN CAST(10.0 AS DOUBLE) ELSE CAST(11.0 AS DOUBLE) END AS font_size_pt FROM ({p}) q, ({two}) n"""
FORMATS = """SELECT doc_id, idx, text, CASE WHEN text IN ('Abstract', 'Introduction', 'References') THEN CAST((doc_id + idx) % 4 AS INT) WHEN length(text) < 25 THEN CAST((doc_id * 7 + idx) % 5 AS INT) END AS outline_level,
  CASE (doc_id + idx) % 4 WHEN 0 THEN 'left' WHEN 1 THEN 'justify' WHEN 2 THEN 'center' END AS alignment, CASE WHEN idx % 3 = 0 THEN CAST(0.15 AS DOUBLE) WHEN idx % 3 = 1 THEN CAST(-0.25 AS DOUBLE) END AS first_line_in,
  CASE WHEN (doc_id + idx) % 6 = 0 THEN concat('n', CAST(idx % 2 AS STRING)) END AS num_id, CASE WHEN doc_id % 2 = 0 THEN 'bullet' ELSE 'number' END AS kind,
  CASE WHEN doc_id % 3 = 0 THEN 'B1' WHEN doc_id % 3 = 1 THEN 'N1' END AS house_code, (doc_id + idx) % 4 = 0 AS dot_suffix FROM ({p}) q"""
IMAGES = """SELECT doc_id, idx AS image_no, CAST(length(text) * 8 + 100 AS INT) AS px_w, CAST(length(text) * 6 + 90 AS INT) AS px_h,
  CAST(1 + (doc_id + idx) % 10 AS DOUBLE) AS in_w, CAST(1 + (doc_id * 3 + idx) % 7 AS DOUBLE) AS in_h FROM ({p}) q WHERE idx % 3 = 0"""
SECTIONS = """SELECT doc_id, idx AS section_no, CASE WHEN doc_id % 3 = 0 THEN CAST(8.27 AS DOUBLE) ELSE CAST(8.5 AS DOUBLE) END AS width_in, CAST(11.69 AS DOUBLE) AS height_in, CASE WHEN (doc_id + idx) % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(1.25 AS DOUBLE) END AS left_in,
  CAST(1.0 AS DOUBLE) AS right_in, CAST(0.6 AS DOUBLE) AS top_in, CASE WHEN idx = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS bottom_in FROM ({p}) q WHERE idx < 2"""
TABLES = "SELECT doc_id, idx AS table_no, idx AS after_idx FROM ({p}) q WHERE (doc_id + idx) % 5 = 0"
CELLS = """SELECT doc_id, CAST(idx / 4 AS INT) AS table_no, idx % 4 AS row, k AS col, substr(text, k * 24 + 1, 24) AS text,
  CASE WHEN (doc_id + idx + k) % 3 = 0 THEN 9.0 ELSE 10.0 END AS size, (doc_id + idx) % 2 = 0 AS bold FROM ({pieces}) q"""
EDITED_CELLS = """SELECT doc_id, idx AS table_no, k AS row, 0 AS col, original, CASE (doc_id + idx) % 4 WHEN 0 THEN substr(text, 25, 24) WHEN 1 THEN concat('something else ', CAST(k AS STRING)) WHEN 2 THEN concat(original, '.') ELSE original END AS edited
  FROM (SELECT doc_id, idx, k, text, substr(text, k * 24 + 1, 24) AS original FROM ({pieces}) s WHERE length(text) > 50) q"""
# Each paragraph with the numbers k of its pieces of 24 characters, all of them.
PIECES = "SELECT *, {unnest} AS k FROM ({p}) o"


def table(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The derived table as a DataFrame."""
    frame = planting.manuscripts(spark, sf_dir)
    pieces = PIECES.format(unnest="explode(sequence(0, CAST(greatest(length(text) - 1, 0) div 24 AS INT)))", p="SELECT * FROM {frame}")
    return spark.sql(sql.format(p="SELECT * FROM {frame}", pieces=pieces, two="SELECT 0 AS k UNION ALL SELECT 1").replace("CAST(idx / 4 AS INT)", "CAST(idx div 4 AS INT)"), frame=frame)


def duck(sql: str) -> str:
    """The derived table as a DuckDB query."""
    pieces = PIECES.format(unnest="CAST(unnest(range(0, greatest(length(text) - 1, 0) // 24 + 1)) AS INTEGER)", p="SELECT * FROM p")
    return sql.format(p="SELECT * FROM p", pieces=pieces, two="SELECT 0 AS k UNION ALL SELECT 1").replace("CAST(idx / 4 AS INT)", "CAST(idx // 4 AS INT)")
