"""JN-29: tables against the house's table specification.

Measurements are rows (doc_id, table_no, scope, attribute, number, word); the
specification is rows too, an interval or a word for an attribute, within a scope
or in any.  They meet in a join by attribute, and of two rows for a measurement
the one of its own scope holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import written
from .layout import looks

ANY = "any"
# The house's table specification, as (scope, attribute, least, most, word, rule, severity); points and inches.
SPECIFICATION = (
    (ANY, "border_style", None, None, "single", "table.border", "warning"),
    (ANY, "border_size_pt", 0.49, 0.51, None, "table.border", "warning"),
    (ANY, "margin_top_in", 0.015, 0.025, None, "table.cell-margin", "info"),
    (ANY, "margin_bottom_in", 0.015, 0.025, None, "table.cell-margin", "info"),
    (ANY, "margin_left_in", 0.035, 0.045, None, "table.cell-margin", "info"),
    (ANY, "margin_right_in", 0.035, 0.045, None, "table.cell-margin", "info"),
    (ANY, "font", None, None, "Times New Roman", "table.font", "warning"),
    (ANY, "size", 8.99, 9.01, None, "table.size", "warning"),
    ("head", "bold", 1.0, 1.0, None, "table.column-head", "warning"),
    ("caption", "size", 10.99, 11.01, None, "table.caption-size", "warning"),
    ("caption", "font", None, None, "Times New Roman", "table.caption-font", "warning"),
    ("caption", "weights", 2.0, 2.0, None, "table.caption-weight", "info"),
    ("note", "size", 8.99, 9.01, None, "table.note-size", "info"),
)
# How captions and notes begin.
CAPTION = r"(?i)^\s*table\s*(?:\d+|[ivxlc]+\b)"
NOTES = ("note:", "note ", "abbreviation", "abbreviations", "source:")
#: Paragraphs below a table among which its notes are.
BELOW = 3


def _rows(df: DataFrame, scope: Column, **attributes: str) -> DataFrame:
    """Measurements of df's columns; attributes: number or word for each column."""
    each = [F.struct(F.lit(c).alias("attribute"), (F.col(c).cast("double") if kind == "number" else F.lit(None).cast("double")).alias("number"), (F.col(c) if kind == "word" else F.lit(None).cast("string")).alias("word")) for c, kind in attributes.items()]
    return df.select("doc_id", "table_no", scope.alias("scope"), F.explode(F.array(*each)).alias("m")).select("doc_id", "table_no", "scope", "m.*")


def measurements(tables: DataFrame, cell_runs: DataFrame, p: DataFrame, runs: DataFrame) -> DataFrame:
    """All that the specification is about: the tables' own lines and margins, their cells, captions and notes.

    tables: (doc_id, table_no, after_idx, border_style, border_size_pt, margins);
    cell_runs with (doc_id, table_no, row, col, para_no); p and runs: the body's.
    """
    margins = {f"margin_{side}_in": "number" for side in ("top", "bottom", "left", "right")}
    own = _rows(tables, F.lit(ANY), border_style="word", border_size_pt="number", **margins)
    place = ["doc_id", "table_no", "row", "col", "para_no"]
    cells = looks(cell_runs.filter("trim(text) <> ''"), place)
    in_cells = _rows(cells, F.when(F.col("row") == 0, "head").otherwise("cell"), font="word", size="number", bold="number")
    # a body paragraph's looks, for the few that stand around tables
    near = tables.select("doc_id", "table_no", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BELOW)), lambda k: F.struct((F.col("after_idx") + k).alias("idx"), k.alias("k")))).alias("at")).select("doc_id", "table_no", "at.*")
    around = near.join(p.select("doc_id", "idx", "text"), ["doc_id", "idx"])
    lower = F.lower(F.trim("text"))
    some = around.filter(((F.col("k") == 0) & F.col("text").rlike(CAPTION)) | ((F.col("k") > 0) & F.exists(F.array(*map(F.lit, NOTES)), lambda x: lower.startswith(x))))
    # a few paragraphs, which the runs meet and the looks meet again
    some = written(some.select("doc_id", "table_no", "idx", F.when(F.col("k") == 0, "caption").otherwise("note").alias("scope")), "captions", plain=True)
    theirs = runs.join(some.select("doc_id", "idx").distinct(), ["doc_id", "idx"], "left_semi").filter("trim(text) <> ''")
    looked = some.join(looks(theirs), ["doc_id", "idx"])
    return own.unionByName(in_cells).unionByName(_rows(looked, F.col("scope"), font="word", size="number", weights="number"))


def table_format(measured: DataFrame) -> DataFrame:
    """(doc_id, table_no, rule, attribute, severity, n, found): measurements off their specification, once for each table; lines that aren't stated are for information."""
    spec = measured.sparkSession.createDataFrame(SPECIFICATION, "scope string, attribute string, least double, most double, want string, rule string, severity string")
    fields = F.struct("least", "most", "want", "rule", "severity")
    narrow = F.broadcast(spec.filter(F.col("scope") != ANY).select("scope", "attribute", fields.alias("own")))  # a few rows, as `wide`
    wide = F.broadcast(spec.filter(F.col("scope") == ANY).select("attribute", fields.alias("general")))
    both = measured.join(narrow, ["scope", "attribute"], "left").join(wide, ["attribute"], "left").withColumn("spec", F.coalesce("own", "general"))
    silent = (F.col("attribute") == "border_style") & F.col("word").isNull()
    off = silent | (F.col("word") != F.col("spec.want")) | (F.col("number") < F.col("spec.least")) | (F.col("number") > F.col("spec.most"))
    value = F.coalesce(F.col("word"), F.when(F.col("number").isNotNull(), F.format_string("%.3f", "number")), F.lit("not stated"))
    bad = both.filter(F.col("spec").isNotNull() & F.coalesce(off, F.lit(False))).select("doc_id", "table_no", "spec.rule", "attribute", F.when(silent, "info").otherwise(F.col("spec.severity")).alias("severity"), value.alias("value"))
    return bad.groupBy("doc_id", "table_no", "rule", "attribute", "severity").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("value")), ", ").alias("found"))
