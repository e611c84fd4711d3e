"""What keeps queries in step with their input: work that isn't done twice, or once a group or key."""

import io
import random
import re
import zipfile

from pyspark.sql import functions as F

from quillspark.operators import guards, layout, recommend, references, tables
from quillspark.sources import packages


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entries_match_without_a_group_each(spark):
    rng = random.Random(5)
    words = ["heat", "water", "stone", "moss", "north", "growth"]
    entry = lambda: " ".join(rng.sample(words, 4))
    rows = [[(d, n, entry()) for d in range(40) for n in range(1, 7)] for _ in range(2)]
    before, after = (spark.createDataFrame(x, "doc_id bigint, ref_no int, text string") for x in rows)
    found = guards.matched_entries(before, after)
    assert "InPandas" not in plan(found)
    want = set()
    for d in range(40):
        a, b = ([(n, set(t.split())) for e, n, t in x if e == d] for x in rows)
        close = sorted((-len(s & t) / 4, i, j) for i, s in a for j, t in b if len(s & t) >= 2)
        left, right = set(), set()
        for _, i, j in close:
            if i not in left and j not in right:
                left.add(i)
                right.add(j)
                want.add((d, i, j))
    assert {tuple(x) for x in found.collect()} == want


def test_picks_meet_candidates_once(spark):
    rng = random.Random(7)
    word = lambda: rng.choice(["Journal", "Letters", "Annals", "heat", "water", "the", "&"])
    name = lambda: " ".join(word() for _ in range(rng.randint(0, 4)))
    picks = [(d, k, rng.choice([None, *range(6)]), name(), 90.0 - k) for d in range(30) for k in range(1, 5)]
    pool = [(d, c, name(), rng.random(), 100 * rng.random(), c + 1) for d in range(30) for c in range(6)]
    left = spark.createDataFrame(picks, "doc_id bigint, pick_no int, journal_id bigint, journal_name string, fit double")
    right = spark.createDataFrame(pool, "doc_id bigint, cid bigint, name string, score double, prescreen double, place int")
    gated = recommend.gate_picks(left, right)
    assert len(re.findall(r"Join|CartesianProduct", gated._jdf.queryExecution().optimizedPlan().toString())) == 1
    names = spark.createDataFrame([(a, b) for a in {x[3] for x in picks} for b in {x[2] for x in pool}], "a string, b string")
    match = {(r.a, r.b) for r in names.filter(recommend.names_match(F.col("a"), F.col("b"))).collect()}
    want, taken = set(), set()
    for d, _, j, n, _ in picks:
        if fit := sorted((c != j, place, c, m) for e, c, m, _, _, place in pool if e == d and (n, m) in match):
            _, _, c, m = fit[0]
            if (d, c) not in taken:
                taken.add((d, c))
                want.add((d, c, m))
    assert {tuple(x)[:3] for x in gated.collect()} == want


def test_locants_are_compared_once(spark):
    rows = [(1, 0, "DTDA and 1,3-BPDA", "4,4′-DTDA and 1,3-BPDA"), (1, 1, "of DTDA", "of 2-DTDA and\x02 3-DTDA"), (1, 2, "1,3-BPDA", "2-BPDA, 1,3-BPDA"), (1, 3, "of XYZ", "of 2-ABC")]
    found = guards.invented_locants(spark.createDataFrame(rows, "doc_id bigint, idx int, original string, edited string"))
    assert len(re.findall(r"EvalPython", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert {r.idx: r.restored for r in found.collect()} == {0: "DTDA and 1,3-BPDA", 1: "of DTDA and  DTDA", 2: "BPDA, 1,3-BPDA"}


def test_dois_read_entries_once(spark):
    refs = spark.createDataFrame([(1, 1, "Smith AB. Growth of things in water. J Test. 2019."), (1, 2, "Jones CD. Growth of things, a review of water. 2020."), (1, 3, "Moss. Growth of things in water. 10.1000/x")], "doc_id bigint, ref_no int, text string")
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    works = spark.createDataFrame([("a", "Growth of things in water", ""), ("0b", "Growth of things, a review of water", "Review-Article")], "doi string, title string, type string")
    second = spark.createDataFrame([("c", "Growth of things in water")], "doi string, title string")
    found = references.fill_dois(refs.mapInPandas(seen, refs.schema), works, second).collect()
    assert {(r.ref_no, r.doi, r.source) for r in found} == {(1, "a", "works"), (2, "0b", "works")}
    assert read.value == 3


def test_equal_cells_make_no_pairs(spark):
    cells = [(1, 1, k, 0, "same text", "same text here") for k in range(50)] + [(1, 1, 50, 0, "another", "same text"), (1, 2, 0, 0, "alone here", "Alone here."), (1, 2, 1, 0, "two words", "TWO WORDS!")]
    table = spark.createDataFrame(cells, "doc_id bigint, table_no int, row int, col int, original string, edited string")
    found = guards.cell_edits(table)
    assert len(re.findall(r"Join", found._jdf.queryExecution().optimizedPlan().toString())) == 1
    assert {(r.table_no, r.row, r.reason) for r in found.collect()} == {(1, 50, "another cell's text")}


def broadcast_scans(df):
    """How many tables of files the plan broadcasts, before it runs."""
    node = df._jdf.queryExecution().executedPlan()
    node = node.initialPlan() if node.nodeName() == "AdaptiveSparkPlan" else node

    def scans(x, inside):
        inside = inside or x.nodeName() == "BroadcastExchange"
        below = x.children()
        return (inside and x.nodeName().startswith("Scan parquet")) + sum(scans(below.apply(k), inside) for k in range(below.size()))

    return scans(node, False)


def test_repeating_entries_are_no_small_table(spark):
    title = "Growth of things in water and of stones in heat"
    refs = spark.range(4000).select((F.col("id") % 800).alias("doc_id"), (F.col("id") / 800).cast("int").alias("ref_no"), F.lit(f"Smith AB. {title}. J Test. 2019. {'and more ' * 20}").alias("text"))
    works = spark.createDataFrame([("a", title)], "doi string, title string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "16k")
    try:
        found = references.fill_dois(refs, works)
        assert broadcast_scans(found) == 0
        second = spark.createDataFrame([("b", "Moss of the north and what it grows on")], "doi string, title string")
        assert broadcast_scans(references.fill_dois(refs, works, second)) == 0
        assert found.count() == 4000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeating_lists_are_no_small_table(spark):
    text = lambda c, change: F.when(F.col("idx") == 0, "References").otherwise(F.concat(F.lit("["), F.col("idx").cast("string"), F.lit(f"]. Smith AB. Growth of things in water, {change} and more. J Test. 2019."))).alias(c)
    r = spark.range(8000).select((F.col("id") % 2000).alias("doc_id"), (F.col("id") / 2000).cast("int").alias("idx")).select("doc_id", "idx", text("original", "stones"), text("edited", "stones of heat"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        for found in (guards.entry_moves(r), guards.references_lost(r)):
            assert broadcast_scans(found) == 0
            assert found.count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def zipped(body):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document>{body}</w:document>")
    return data.getvalue()


def test_blocks_are_placed_without_a_shuffle(spark):
    content = zipped("<w:p><w:r><w:t>a</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p/></w:tc></w:tr></w:tbl><w:p/>")
    found = packages.blocks(packages.opened(spark.createDataFrame([(f"a{k}.docx", content) for k in range(9)], "path string, content binary")))
    assert not re.search("Exchange|Window|Sort", plan(found))
    got = [(r.kind, r.depth, r.table_no, r.row, r.col, r.para_no, r.n_body) for r in found.filter("path = 'a3.docx'").orderBy("pos").collect()]
    assert got == [("p", 0, None, None, None, 0, 1), ("tbl", 1, 0, -1, -1, -1, 1), ("p", 1, 0, 0, 0, 0, 1), ("p", 0, None, None, None, 1, 2)]


def test_places_by_definition(spark):
    rng = random.Random(11)
    parts = ["<p>", "</p>", "<p a='1'/>", "<tbl>", "</tbl>", "<tr>", "</tr>", "<tc w='2'>", "</tc>", "<tc/>", "x", "\n", "<pPr/>", "<r>a</r>", "<txbxContent><p>b</p></txbxContent>", "<tblPr>", "<tbl/>"]
    texts = ["", *["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(300)]]
    cut = spark.createDataFrame(enumerate(texts), "k int, document string").select("k", packages._pieces().alias("pieces")).orderBy("k").collect()
    for text, row in zip(texts, cut, strict=True):
        pieces = row.pieces[:-1] if row.pieces[-1] == "" else row.pieces
        opens = [m[1] if (m := re.match(r"<(tbl|tr|tc|p)[ >]", x)) else "" for x in pieces]
        assert list(packages._kinds(text)) == [(kind, x.endswith("</tbl>")) for kind, x in zip(opens, pieces, strict=True)]
        got = [tuple(x) for x in zip(*[iter(packages._places(text))] * len(packages.PLACE), strict=True)]
        seen = []  # of each piece: its kind, and the table, row and cell it stands in
        for k, kind in enumerate(opens):
            n_opened = opens[: k + 1].count("tbl")
            depth = n_opened - sum(x.endswith("</tbl>") for x in pieces[:k])
            now = {"kind": kind, "depth": depth, "opened": n_opened}
            seen.append(now)
            now["table"] = max((x["opened"] - 1 for x in seen if x["kind"] == "tbl" and x["depth"] == depth), default=None) if depth > 0 else None
            for what, tag, keys in (("row", "tr", ["table"]), ("col", "tc", ["table", "row"])):
                now[what] = sum(x["kind"] == tag and all(x[y] == now[y] for y in keys) for x in seen) - 1 if depth > 0 else None
            para = sum(x["kind"] == "p" and all(x[y] == now[y] for y in ("table", "row", "col")) for x in seen) - 1
            body = sum(x["kind"] == "p" and x["depth"] <= 0 for x in seen)
            if kind in ("p", "tbl"):
                want = ({"p": 1, "tbl": 2}[kind], n_opened, depth, now["table"], now["row"], now["col"], para, body)
                assert got[k] == want if depth > 0 else got[k][:3] + got[k][6:] == want[:3] + want[6:]
            else:
                assert got[k][0] == 0


def test_table_runs_are_read_once(spark):
    rng = random.Random(2)
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(len(b))
            yield b

    place = "doc_id bigint, table_no int, row int, col int, para_no int"
    look = "text string, bold boolean, font_name string, font_size_pt double"
    any_look = lambda: (rng.choice(["ab", "c", "longer", " "]), rng.choice([None, True, False]), rng.choice([None, "A", "B", "C"]), rng.choice([None, 9.0, 10.5]))
    runs = spark.createDataFrame([(k % 3, 0, k % 4, 0, k % 5, *any_look()) for k in range(300)] + [(9, 0, 0, 0, k, *any_look()) for k in range(60)], f"{place}, {look}")
    keys = ["doc_id", "table_no", "row", "col", "para_no"]
    filled = runs.filter("trim(text) <> ''")
    want = filled.select(*keys).distinct().join(layout.dominant(filled, keys), keys, "left").join(layout.weight(filled.withColumn("italic", F.lit(None).cast("boolean")), keys), keys, "left").drop("italic")
    weights = filled.groupBy(*keys).agg(F.count_distinct(F.coalesce("bold", F.lit(False))).alias("weights"))
    assert sorted(map(str, layout.looks(filled, keys).collect())) == sorted(map(str, want.join(weights, keys).select(*keys, "font", "size", "bold", "weights").collect()))
    body = spark.createDataFrame([(1, 0, "Table 1. Of heat")], "doc_id bigint, idx int, text string")
    own = spark.createDataFrame([(1, 0, 0, "single", 0.5, 0.02, 0.02, 0.04, 0.04)], "doc_id bigint, table_no int, after_idx int, border_style string, border_size_pt double, margin_top_in double, margin_bottom_in double, margin_left_in double, margin_right_in double")
    body_runs = body.select("doc_id", "idx", "text", F.lit(True).alias("bold"), F.lit("A").alias("font_name"), F.lit(11.0).alias("font_size_pt"), F.lit(None).cast("boolean").alias("italic"))
    measured = tables.measurements(own, runs.withColumn("italic", F.lit(None).cast("boolean")).mapInPandas(seen, f"{place}, {look}, italic boolean"), body, body_runs)
    measured.collect()
    assert read.value == 360
