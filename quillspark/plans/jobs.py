"""Jobs: each composes the operators of one task over a whole corpus.

A job takes and returns DataFrames and runs nothing; its caller writes the
results.  Tables that several stages read are cached by the caller if need be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rewrites
from ..operators import changes, consistency, findings, guards, layout, recommend, references, scans, usage
from ..sources import catalogue, corpus, packages, sinks
from ..streaming import streams


def corpus_ingest(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Files of a folder as structure tables, tracked revisions, and a triage of what can't be read."""
    files = packages.files(spark, path)
    return packages.ingest_packages(spark, path) | {"revisions": packages.revisions_from_tracked(files), "triage": packages.triage_files(files)}


def as_findings(rows: DataFrame, family: str) -> DataFrame:
    """Rows of any scan in the findings schema; a document-level finding has no place."""
    have = set(rows.columns)
    pick = lambda c, kind: (F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)).alias(c)
    return rows.select("doc_id", pick("idx", "int"), F.lit(family).alias("family"), "rule", pick("severity", "string"), pick("fragment", "string"), pick("suggestion", "string"))


def proofread_scan(p: DataFrame, extra_captions: DataFrame | None = None) -> DataFrame:
    """All paragraph and consistency rules over p, one table of findings."""
    named = lambda df, rule, fragment: df.withColumn("rule", F.lit(rule)).withColumn("fragment", F.col(fragment).cast("string"))
    families = [
        scans.mechanical(p), scans.script_markers(p), scans.formula_digits(p), scans.length_checks(p),
        consistency.acronyms(p).withColumn("fragment", F.col("acronym")),
        named(consistency.abstract_abbreviations(corpus.zones(p)), "abstract.abbreviation", "acronym"),
        consistency.cross_references(p, extra_captions).withColumn("fragment", F.concat_ws(" ", "kind", F.col("n").cast("string"))),
        named(consistency.equation_numbers(p), "equation.no_number", "n"),
        named(consistency.spelling_clash(p), "spelling.clash", "uk"), named(consistency.label_clash(p), "label.clash", "fig"),
    ]
    return findings.all_findings(*[as_findings(f, "proofreading") for f in families])


def layout_scan(p: DataFrame, formats: DataFrame, runs: DataFrame, tables: DataFrame, sections: DataFrame, images: DataFrame) -> DataFrame:
    """All layout rules over structure tables, one table of findings."""
    looks = layout.dominant(runs)
    refs = references.group_entries(references.reference_lines(p))
    families = [
        layout.headings(formats, layout.weight(runs)), layout.skipped_levels(formats).withColumn("rule", F.lit("heading.skipped-level")), layout.page_geometry(sections).withColumn("rule", F.lit("page.geometry")).withColumn("fragment", F.col("side")),
        layout.artwork(images), scans.image_resolution(images), layout.table_captions(tables, p), layout.body_text(p, formats, looks), layout.reference_layout(refs, formats, looks), layout.front_matter(p, looks),
    ]
    return findings.all_findings(*[as_findings(f, "layout") for f in families])


def house_rewrite(p: DataFrame, groups: set[str] | None = None) -> DataFrame:
    """Paragraphs that the enabled rewrites change: (doc_id, idx, text, new_text)."""
    done = rewrites.house_rewrite(p, groups).withColumnRenamed("text", "new_text")
    return p.join(done, ["doc_id", "idx"]).filter("text <> new_text")


def revision_audit(r: DataFrame) -> dict[str, DataFrame]:
    """Guard rows, put-right revisions, losses, and a loss report of an edit."""
    found = guards.run_guards(r)
    return {"guards": found, "restored": guards.restored(r, found), "losses": guards.losses(r), "tokens": guards.missing_tokens(r), "report": guards.loss_report(r), "moved": guards.moved_numbers(r)}


def bibliography(p: DataFrame, works: DataFrame | None = None, books: DataFrame | None = None) -> dict[str, DataFrame]:
    """Entries, their parts and gaps, duplicates, citation counts, new numbers; completions where catalogues are given."""
    refs = references.group_entries(references.reference_lines(p))
    made = {"refs": refs, "parsed": references.parse_refs(refs), "gaps": references.incomplete_refs(refs), "duplicates": references.duplicate_refs(refs), "style": references.journal_style(refs), "cited": references.citation_counts(p, refs), "numbers": references.renumber(p, refs), "issues": references.validate_article(p, refs)}
    if works is not None:
        made |= {"completed": references.complete_references(refs, works), "dois": references.fill_dois(refs, works)}
    if books is not None:
        made["places"] = references.book_places(refs, books)
    return made


def change_mining(r: DataFrame) -> dict[str, DataFrame]:
    return {"patterns": changes.recurring_changes(r), "chunks": changes.chunk_edits(r), "volume": changes.change_counts(r)}


def model_output_check(p: DataFrame, output: DataFrame, raw_findings: DataFrame) -> dict[str, DataFrame]:
    revised, skipped = changes.realign_chunks(p, output)
    return {"revisions": revised, "skipped": skipped, "findings": changes.verify_model_findings(raw_findings, p)}


def recommendations(docs: DataFrame, journals: DataFrame, picks: DataFrame | None = None, k: int = 3) -> dict[str, DataFrame]:
    """docs: (doc_id, vector, text)."""
    pool = recommend.candidate_pool(docs, journals)
    none = pool.select("doc_id", "cid", "name", F.lit(0.0).alias("fit")).filter("false")
    chosen = recommend.recommend(recommend.gate_picks(picks, pool) if picks is not None else none, pool, k)
    scored = chosen.join(pool.select("doc_id", "cid", "score"), ["doc_id", "cid"]).join(F.broadcast(journals.select("cid", "impact_factor")), "cid")
    return {"recommended": chosen, "reasons": recommend.explain_ranks(scored), "domains": recommend.detect_domain(chosen, journals)}


def originality(p: DataFrame, comparison: DataFrame) -> dict[str, DataFrame]:
    flags = recommend.originality(p, comparison)
    return {"flags": flags, "scores": recommend.originality_score(p, flags)}


def catalogue_refresh(listing: DataFrame, details: DataFrame, previous: DataFrame) -> dict[str, DataFrame]:
    journals, audit = catalogue.refresh_catalogue(listing, details, previous)
    return {"journals": journals, "audit": audit, "profile": catalogue.catalogue_stats(journals)}


def live_ops(attempts: DataFrame, heartbeats: DataFrame, events: DataFrame, answers: DataFrame, calls: DataFrame, progress: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """The streams of running jobs, each with its output mode: lock-outs, stalls, feeds, decisions, meters, throttled progress."""
    return {
        "lockouts": (streams.lockouts(attempts), "update"), "stalled": (streams.stalled(heartbeats), "append"), "feed": (streams.live_feed(events), "update"),
        "decisions": (streams.reviews(answers), "append"), "meters": (streams.usage_meter(calls), "update"), "progress": (streams.throttle(progress), "append"),
    }


#: The key and the order by which a live table keeps its latest rows.
LIVE_KEYS = {"feed": ("job_id", "events"), "meters": ("job_id", "calls")}


def start_live_ops(found: dict[str, tuple[DataFrame, str]], folder: str, **trigger) -> list:
    """Starts live_ops(): tables with a key are upserted, the others get each batch as a folder of its own."""
    started = []
    for name, (stream, mode) in found.items():
        path = f"{folder}/{name}"
        key = LIVE_KEYS.get(name)
        write = sinks.upsert_stream(path, *key) if key else sinks.batch_folders(path)
        started.append(stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/progress-{name}").outputMode(mode).trigger(**trigger).start())
    return started


def corpus_reports(found: DataFrame, documents: DataFrame) -> dict[str, DataFrame]:
    rates = findings.prevalence(found, documents)
    return {"prevalence": rates, "summary": findings.summarise(found), "rows": findings.report_rows(found), "gaps": findings.author_gaps(found), "collapsed": findings.collapse_repeats(found), "marked": findings.split_routine(found, rates)}


def ops_reports(users: DataFrame, logs: DataFrame, jobs: DataFrame, calls: DataFrame, month: str) -> dict[str, DataFrame]:
    used = usage.month_usage(jobs)
    return {"days": usage.daily_stats(logs), "activity": usage.user_activity(users, logs), "usage": used, "quota": usage.quota(users, used, month), "meter": usage.usage_rollup(calls), "record": usage.daily_findings(jobs), "queue": usage.queue_stats(jobs)}
