"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

A window is the shortest run of lines from a place on that has WORDS words, or
RUN lines.  Of each window the line of least hash is selected.  Equal windows
select the same line, so the selected lines are guaranteed fingerprints: their
positions are joined on the hash, and the windows around those that stand more
than once are compared with the first equal window (by document id, then place).
A match is extended line by line, both ways, up to REACH lines as long as the
lines are equal; longer runs consist of further windows.  The lines of later
repeats are deleted, the first run stays.

So a repeated run goes if it has WORDS words or RUN lines.  Lines are cut at \\n.
Lines without a word are kept and take no part, so a run reaches over them.

Edge cases: a null text stays null and has no lines; an empty one is one empty
line; rows equal in id and text are one document with one result; null ids come
first; an empty table gives an empty table; extra columns of any name stay as
they are.  A very long text is one row with its lines' hashes: time and memory
grow with its lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import fresh, kept, materialise, scratch

#: Words of a window, and lines of one that has fewer.
WORDS, RUN = 5, 3
#: Lines that a match is extended by; a run that goes on has a window of its own there.
REACH = RUN - 1


def worded_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc, mark, ls): of each document the lines with a word, as (i: place, h and g: hashes, n: words)."""
    line = lambda x, i: F.struct(i.alias("i"), F.xxhash64(x).alias("h"), F.xxhash64(x, F.lit(1)).alias("g"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("n"))
    found = F.filter(F.transform(F.split(F.col(text), "\n"), line), lambda x: x["n"] > 0)
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"), found.alias("ls"))


def windows(ls: Column, words: int = WORDS, run: int = RUN) -> Column:
    """Each line's window, null where the text ends before: its lines' number k, its selected line's place and hash (at, h), its content's hash, and the lines around.

    around: the REACH lines before the start, and those from it to REACH behind
    the longest window; null where there are none.  Lines are got by their place
    and the array is bound once, so that a text costs what its lines do.
    """

    def window(ls: Column, start: Column) -> Column:
        line = lambda j: F.get(ls, start + j)
        n = lambda j: F.coalesce(line(j)["n"], F.lit(0))
        k = reduce(lambda w, j: w.when(sum((n(i) for i in range(1, j)), n(0)) >= words, j), range(2, run), F.when(n(0) >= words, 1)).when(line(run - 1).isNotNull(), run)
        return F.struct(start.alias("start"), F.when(line(k - 1).isNotNull(), k).alias("k"))

    def filled(ls: Column, w: Column) -> Column:
        start, k = w["start"], w["k"]
        line = lambda j: F.get(ls, start + j)
        own = [F.when(k > j, F.struct(line(j)["h"].alias("h"), (start + j).alias("at"))) for j in range(run)]
        least = F.least(*own) if run > 1 else own[0]
        content = F.xxhash64(k, *[F.when(k > j, line(j)["g"]) for j in range(run)])
        around = F.array(*[F.struct(line(j)["i"].alias("i"), line(j)["h"].alias("h")) for j in range(-REACH, run + REACH)])
        return F.struct(start.alias("start"), k.alias("k"), least["at"].alias("at"), least["h"].alias("h"), content.alias("window"), around.alias("around"))

    places = lambda ls: F.when(F.size(ls) > 0, F.sequence(F.lit(0), F.size(ls) - 1)).otherwise(F.array().cast("array<int>"))
    whole = lambda ls: F.transform(F.filter(F.transform(places(ls), lambda j: window(ls, j)), lambda w: w["k"].isNotNull()), lambda w: filled(ls, w))
    return F.get(F.transform(F.array(ls), whole), F.lit(0))


def repeated_lines(docs: DataFrame, text: str = "text", words: int = WORDS, run: int = RUN) -> DataFrame:
    """(doc, mark, gone): for each document with any, the places of the lines that later repeats cover."""
    lines = materialise(worded_lines(docs, text), "lines")
    # a place has one hash, so the distinct places that a text's windows select are its fingerprints
    chosen = F.transform(F.array("ls"), lambda ls: F.transform(F.array_distinct(F.transform(windows(ls, words, run), lambda w: w["at"])), lambda at: F.get(ls, at)["h"]))
    again = lines.select(F.explode(F.get(chosen, F.lit(0))).alias("h")).groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    each = lines.select("doc", "mark", F.explode(windows(F.col("ls"), words, run)).alias("w")).select("doc", "mark", "w.start", "w.k", "w.h", "w.window", "w.around")
    found = materialise(each.join(again, "h"), "line-windows")
    first = found.groupBy("h", "window").agg(F.min(F.struct("doc", "mark", "start", "around")).alias("first"), F.count("*").alias("m")).filter("m > 1").drop("m")
    later = found.join(first, ["h", "window"]).filter(~F.struct("doc", "mark", "start").eqNullSafe(F.struct("first.doc", "first.mark", "first.start")))

    def equal(place: Column) -> Column:
        return F.coalesce(F.get("around", place)["h"] == F.get("first.around", place)["h"], F.lit(False))

    def length(sides: list[Column]) -> Column:
        """How many of the neighbours, nearest first, are equal without a gap."""
        return sum((reduce(lambda a, b: a & b, sides[: j + 1]).cast("int") for j in range(len(sides))), F.lit(0))

    left = length([equal(F.lit(REACH - j)) for j in range(1, REACH + 1)])
    right = length([equal(REACH + F.col("k") + j) for j in range(REACH)])
    extended = F.slice("around", REACH - F.col("left") + 1, F.col("left") + F.col("k") + F.col("right"))
    ranges = later.withColumns({"left": left, "right": right}).select("doc", "mark", F.explode(F.transform(extended, lambda x: x["i"])).alias("line"))
    return ranges.groupBy("doc", "mark").agg(F.collect_set("line").alias("gone"))


def drop_repeated_lines(docs: DataFrame, name: str = "lines", text: str = "text", words: int = WORDS, run: int = RUN) -> DataFrame:
    """docs with a struct column: `text` without the later repeats, `n_lines` and `n_removed`; a column of that name is replaced."""
    with scratch(docs.sparkSession):
        gone = kept(repeated_lines(docs, text, words, run), "gone-lines")
    own = F.struct(F.col("doc_id").alias("doc"), F.xxhash64(text).alias("mark"))
    # documents and places meet as one column each, of names that no column has
    d, o, p, g = fresh(docs.columns, "d", "o", "p", "g")
    left = docs.drop(name).select(F.struct("*").alias(d), own.alias(o))
    right = gone.select(F.struct("doc", "mark").alias(p), F.col("gone").alias(g))
    # one plan at every size: broadcasting what few lines a small corpus loses would hide what a large one costs
    both = left.join(right.hint("merge"), F.col(o)["doc"].eqNullSafe(F.col(p)["doc"]) & (F.col(o)["mark"] == F.col(p)["mark"]), "left")
    whole = F.col(d)[text]
    lines = F.split(whole, "\n")

    def stay(lines: Column) -> Column:  # the array is bound once, not split for each line
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(g))
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    left_text = F.when(F.col(g).isNull(), whole).otherwise(F.get(F.transform(F.array(lines), stay), F.lit(0)))
    n = F.when(whole.isNull(), 0).otherwise(F.size(lines)).cast("bigint")
    removed = F.when(F.col(g).isNull(), 0).otherwise(F.size(g)).cast("bigint")
    made = F.struct(left_text.alias("text"), n.alias("n_lines"), removed.alias("n_removed"))
    return both.select(*[F.col(d)[c].alias(c) for c in docs.drop(name).columns], made.alias(name))


def digest(docs: DataFrame) -> DataFrame:
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "lines.n_lines", "lines.n_removed", F.md5(F.coalesce("lines.text", F.lit(""))).alias("kept_md5"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: later repeats of runs of lines go; n_chars follows the text."""
    (lines,) = fresh(docs.columns, "lines")
    done = drop_repeated_lines(docs, lines)
    made = {"text": F.col(lines)["text"], "n_chars": F.length(F.col(lines)["text"])}
    return done.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents
), worded AS (
  SELECT doc_id, line, i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), near AS (
  SELECT doc_id, seq, n, lag(line, 2) OVER w AS b2, lag(line, 1) OVER w AS b1, line AS l0, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3, lead(line, 4) OVER w AS l4, lead(n, 1) OVER w AS n1
  FROM worded WINDOW w AS (PARTITION BY doc_id ORDER BY seq)
), windows AS (
  SELECT *, CASE WHEN n >= 5 THEN 1 WHEN l1 IS NOT NULL AND n + n1 >= 5 THEN 2 WHEN l2 IS NOT NULL THEN 3 END AS k FROM near
), placed AS (
  SELECT doc_id, seq, k, b2, b1, CASE k WHEN 1 THEN l1 WHEN 2 THEN l2 ELSE l3 END AS a1, CASE k WHEN 1 THEN l2 WHEN 2 THEN l3 ELSE l4 END AS a2,
    [l0, CASE WHEN k > 1 THEN l1 END, CASE WHEN k > 2 THEN l2 END] AS body
  FROM windows WHERE k IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER w AS r, first(b2) OVER w AS fb2, first(b1) OVER w AS fb1, first(a1) OVER w AS fa1, first(a2) OVER w AS fa2
  FROM placed WINDOW w AS (PARTITION BY body ORDER BY doc_id, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), cut AS (
  SELECT doc_id, seq - CASE WHEN b1 = fb1 AND b2 = fb2 THEN 2 WHEN b1 = fb1 THEN 1 ELSE 0 END AS a, seq + k - 1 + CASE WHEN a1 = fa1 AND a2 = fa2 THEN 2 WHEN a1 = fa1 THEN 1 ELSE 0 END AS b
  FROM ranked WHERE r > 1
), gone AS (
  SELECT DISTINCT w.doc_id, w.i FROM (SELECT doc_id, unnest(range(a, b + 1)) AS seq FROM cut) c JOIN worded w ON w.doc_id = c.doc_id AND w.seq = c.seq
), kept AS (
  SELECT lines.doc_id, string_agg(line, chr(10) ORDER BY lines.i) FILTER (WHERE gone.i IS NULL) AS text, count(*) AS n_lines, count(gone.i) AS n_removed
  FROM lines LEFT JOIN gone ON lines.doc_id = gone.doc_id AND lines.i = gone.i GROUP BY lines.doc_id
)
SELECT doc_id, n_lines, n_removed, md5(coalesce(text, '')) AS kept_md5 FROM kept
"""
