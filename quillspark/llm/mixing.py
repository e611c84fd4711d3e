"""Mixing sources to target weights over a time-varying curriculum.

Each source's weight is a piecewise linear function of training progress.  Its
integral is the source's cumulative token demand; inverting it assigns each
document copy the training position at which that much of its source has been
consumed.  Documents are then range-sorted by position.

A source's documents are taken in a fixed pseudo-random order, as often as its
target needs: whole passes over the source, then a last pass that stops at the
target.  Running totals within a source are sums over hash buckets first, so one
hot source is spread over many tasks.

Edge cases: a null text has no words and takes none; the null source comes last;
rows with equal ids and sizes share their places among themselves; an empty
table, or one without words, gives targets of zero; extra columns of any name
are kept and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import fresh, kept, materialise, scratch

WEIGHTS = (5, 2, 1)
REPEATS = 3
#: Knots (progress, factor) of each weight class's schedule; each has the mean factor 1.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: Hexadecimal digits of a document's hash that name its bucket: 16**3 buckets a source.
DIGITS = 3


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row for each source: source_size, weight class, target.

    Targets share the total by weight; what exceeds `repeats` times a source's
    size is reshared by weight.  With sources in ascending order of cap over
    weight the capped ones are a prefix, so one pass of running sums finds them.
    The windows run over one row for each source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("class", (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights))
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), (F.col("class") + 1).cast("int"))
    ratio = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * repeats)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ratio.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("cap") * F.col("weights") < F.col("left") * F.col("weight"))
    )
    least = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), "left", "weights"))).over(whole)
    share = level.withColumn("at", least)
    return share.select(
        "source",
        "source_size",
        "class",
        F.when(F.col("full") | F.col("at").isNull(), F.col("cap").cast("double"))
        .otherwise(F.col("at.left").cast("double") * F.col("weight") / F.col("at.weights"))
        .alias("target"),
    )


def position(class_: Column, share: Column, schedules=SCHEDULES) -> Column:
    """The training progress at which a source of the class has consumed the share of its demand.

    On a segment the demand is w0*x + (w1-w0)/(2*h)*x**2; its root is written so
    that equal weights at both knots need no case of their own.
    """
    picked = None
    for c, knots in enumerate(schedules):
        total = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(knots, knots[1:], strict=False))
        done, branch = 0.0, F.lit(float(knots[-1][0]))
        parts = []
        for (a, u), (b, v) in zip(knots, knots[1:], strict=False):
            area = (b - a) * (u + v) / 2 / total
            rest = (share - done) * total
            root = rest * 2 / (u + F.sqrt(F.greatest(F.lit(0.0), u * u + 2 * (v - u) / (b - a) * rest)))
            parts.append((done + area, a + root))
            done += area
        for limit, value in reversed(parts):
            branch = F.when(share <= limit, value).otherwise(branch)
        picked = F.when(class_ == c, branch) if picked is None else picked.when(class_ == c, branch)
    return picked


def mix_sources(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """(doc_id, mark, source, size, source_size, target, taken, position, copies) for each row of docs.

    copies: for each copy that the source's demand reaches, its training position
    and the words of it that are taken (the copy at which the demand ends is cut
    there).  taken: their sum, repeats counted; a source's sum is its target
    rounded down.  position: the first copy's, null without any.  mark: a hash of
    text and source.
    """
    # texts are read and counted once; what follows reads a few numbers for each row
    sizes = materialise(docs.select("doc_id", F.xxhash64("text", "source").alias("mark"), "source", word_count().alias("size")), "sizes")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = sizes.withColumn("key", key).withColumn("bucket", F.substring("key", 1, DIGITS))
    goal = targets(sizes, weights, repeats)
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    run = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.withColumn("base", F.coalesce(F.sum("in_bucket").over(run), F.lit(0))).select("source", "bucket", "base")
    place = base.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    both = laid.join(place.withColumnsRenamed({"source": "s", "bucket": "b"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))

    def copy(i: Column) -> Column:
        offset = F.col("base") + F.col("ahead") + i * F.col("source_size")  # the words of the source before this copy
        share = F.least(offset / F.greatest(F.col("target"), F.lit(1.0)), F.lit(1.0))
        words = F.least(F.greatest(F.floor("target").cast("bigint") - offset, F.lit(0)), F.col("size"))
        return F.struct(F.when(words > 0, position(F.col("class"), share, schedules)).alias("position"), words.cast("bigint").alias("words"))

    reached = F.filter(F.transform(F.sequence(F.lit(0), F.lit(repeats)), copy), lambda c: c["position"].isNotNull())
    taken = F.aggregate("copies", F.lit(0).cast("bigint"), lambda a, c: a + c["words"])
    return both.withColumn("copies", reached).select("doc_id", "mark", "source", "size", "source_size", "target", taken.alias("taken"), F.get("copies", 0)["position"].alias("position"), "copies")


def training_order(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, schedules=SCHEDULES) -> DataFrame:
    """docs as the mix reads them: a row for each copy, range-sorted by training position; documents of which nothing is taken go.

    A copy that is cut counts if at least half of its words are taken.  Rows equal
    in id, text and source have the places of the first of them.
    """
    ident = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit(""))
    d, who, mark, at = fresh(docs.columns, "d", "who", "m", "at")
    with scratch(docs.sparkSession):
        plan = kept(mix_sources(docs, weights, repeats, schedules).filter("size > 0").select("doc_id", "mark", "size", "position", "copies"), "mix")
    one = plan.groupBy(ident.alias(who), F.col("mark").alias(mark)).agg(F.min_by(F.struct("copies", "size"), F.coalesce("position", F.lit(2.0))).alias("p"))
    chosen = one.select(who, mark, F.explode(F.filter("p.copies", lambda c: c["words"] * 2 >= F.col("p.size"))["position"]).alias(at))
    own = docs.select(F.struct("*").alias(d), ident.alias(who), F.xxhash64("text", "source").alias(mark))
    placed = own.join(chosen, [who, mark]).repartitionByRange(at, who).sortWithinPartitions(at, who)
    return placed.select(*[F.col(d)[c].alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """The mix in training order; documents of which nothing is taken come first."""
    mixed = mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "position")
    return mixed.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents repeat or go as their source's target says, in training order: the next stage reads it off the files."""
    return training_order(docs)


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM per
), caps AS (
  SELECT *, source_size * 3 AS cap FROM ranked
), lev AS (
  SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER w, 0)::BIGINT AS rest, (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER w, 0)::BIGINT AS weights
  FROM caps WINDOW w AS (ORDER BY cap::DOUBLE / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), full_ AS (
  SELECT *, cap * weights < rest * weight AS is_full FROM lev
), cut AS (
  SELECT arg_min(rest, cap::DOUBLE / weight) AS r, arg_min(weights, cap::DOUBLE / weight) AS ws FROM full_ WHERE NOT is_full
), goal AS (
  SELECT source, source_size, weight, CASE WHEN is_full OR r IS NULL THEN cap::DOUBLE ELSE r::DOUBLE * weight / ws END AS target FROM full_, cut
), laid AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM sizes
), took AS (
  SELECT doc_id, size, source_size, weight, target, start, floor(target)::BIGINT // greatest(source_size, 1) * size
    + least(greatest(floor(target)::BIGINT - floor(target)::BIGINT // greatest(source_size, 1) * source_size - start, 0), size) AS taken,
    least(start / greatest(target, 1.0), 1.0) AS share
  FROM laid JOIN goal ON laid.source IS NOT DISTINCT FROM goal.source
)
SELECT doc_id, size, source_size, target, taken::BIGINT AS taken,
  CASE WHEN taken > 0 THEN CASE weight WHEN 5 THEN share * 2 / (1.5 + sqrt(greatest(0.0, 2.25 - 2.0 * share))) WHEN 2 THEN share ELSE share * 2 / (0.5 + sqrt(greatest(0.0, 0.25 + 2.0 * share))) END END AS position
FROM took
"""
