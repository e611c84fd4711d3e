"""Journal recommendation, subject domains, originality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wordlists import NAME_STOPS

from .scans import sentences

# Words of a publisher's topics by subject domain.
DOMAINS = {
    "engineering": ("mechanical engineering", "electrical engineering", "civil", "construction", "electronics", "energy", "materials", "chemical engineering", "aerospace", "industrial", "mining", "textile", "robotics", "polymer", "nanotechnology"),
    "computer & IT": ("computer", "information technology", "software", "data science", "artificial intelligence", "networking", "cyber"),
    "chemistry": ("chemistry", "analytical chemistry", "organic chemistry", "physical chemistry", "inorganic chemistry"),
    "life sciences": ("life sciences", "biotechnology", "microbiology", "biology", "botany", "zoology", "genetics", "environmental"),
    "medical & health": ("medical", "medicine", "pharmacy", "pharmaceutical", "nursing", "dental", "health", "clinical"),
    "agriculture": ("agriculture", "agronomy", "horticulture", "food technology", "dairy", "veterinary", "forestry"),
    "management & commerce": ("management", "commerce", "business", "finance", "economics", "marketing", "accounting"),
    "law": ("law", "legal", "jurisprudence"),
    "education & social sciences": ("education", "social sciences", "psychology", "sociology", "humanities", "library"),
    "physics & maths": ("physics", "mathematics", "statistics", "astronomy"),
}
#: Journals that are broadcast: a publisher's catalogue; larger ones take the shuffled join.
CATALOGUE_ROWS = 20_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for a vector without length."""
    norm = length(a) * length(b)
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def journal_text(journals: DataFrame) -> DataFrame:
    """SRC-10: (cid, text) for embedding: name, areas, topics and the first 4,000 characters of the scope."""
    return journals.select("cid", F.concat_ws(" ", "name", F.array_join("subject_areas", " "), F.array_join("topics", " "), F.substring("scope", 1, 4000)).alias("text"))


def scored_pairs(docs: DataFrame, journals: DataFrame) -> DataFrame:
    """JN-21: every document with every journal: (doc_id, cid, name, score).  docs: (doc_id, vector); journals: (cid, name, embedding).

    A document without a vector scores 0.  A catalogue within CATALOGUE_ROWS is broadcast; its size is checked, and a
    larger one is dealt in blocks of journals against all documents.
    """
    small = journals.select("cid").limit(CATALOGUE_ROWS + 1).count() <= CATALOGUE_ROWS
    if small:
        both = docs.join(F.broadcast(journals.select("cid", "name", "embedding")))
    else:
        blocks = 64
        right = journals.select("cid", "name", "embedding").withColumn("block", F.pmod(F.xxhash64("cid"), F.lit(blocks)))
        both = docs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(right, "block")
    return both.select("doc_id", "cid", "name", F.coalesce(cosine(F.col("vector"), F.col("embedding")), F.lit(0.0)).alias("score"))


def top_journals(pairs: DataFrame, k: int = 3) -> DataFrame:
    """The k best journals of each document (a top-k report)."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("score"), "cid")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topic_hits(text: Column, terms: Column) -> Column:
    """JN-22: the terms of which the phrase, or a word of four letters or more, stands in the lower-cased text."""
    return F.filter(terms, lambda t: (F.trim(t) != "") & stands(text, F.trim(F.lower(t)), topic_words(t)))


def topic_words(term: Column) -> Column:
    return F.regexp_extract_all(F.lower(term), F.lit("[a-z]{4,}"), F.lit(0))


def stands(text: Column, phrase: Column, words: Column) -> Column:
    return F.contains(text, phrase) | F.exists(words, lambda w: F.contains(text, w))


def prescreen(score: Column, hits: Column) -> Column:
    """TK-1: 80 points of the cosine and 20 of the topic hits (8 hits are full), to one decimal, half to even."""
    return F.bround(F.least(F.lit(100.0), F.greatest(score, F.lit(0.0)) * 80 + F.least(F.lit(1.0), hits / 8.0) * 20), 1)


def candidate_pool(docs: DataFrame, journals: DataFrame, pool: int = 40) -> DataFrame:
    """TK-1: (doc_id, cid, name, score, prescreen, place): the `pool` best candidates of each document.  docs: (doc_id, vector, text).

    A document without a vector scores 0.  A catalogue within CATALOGUE_ROWS is broadcast as one array of journals, so a
    text stays where it is and its journals are scored, sorted and cut in place;
    a larger one is dealt in blocks, each of which keeps its best.  A document
    without a vector scores 0 with every journal.
    """
    terms = F.transform(F.filter(F.concat("subject_areas", "topics"), lambda t: F.trim(t) != ""), lambda t: F.struct(F.trim(F.lower(t)).alias("phrase"), topic_words(t).alias("words")))
    own = F.struct("cid", "name", "embedding", length(F.col("embedding")).alias("length"), terms.alias("terms"))
    small = journals.select("cid").limit(CATALOGUE_ROWS + 1).count() <= CATALOGUE_ROWS
    parts = 1 if small else 64
    blocks = journals.groupBy(F.pmod(F.xxhash64("cid"), F.lit(parts)).alias("block")).agg(F.collect_list(own).alias("js"))
    lowered = docs.select("doc_id", "vector", length(F.col("vector")).alias("length"), F.lower("text").alias("lowered"))
    dealt = lowered.withColumn("block", F.lit(0)) if small else lowered.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    met = dealt.join(F.broadcast(blocks) if small else blocks, "block")
    order = lambda rows: F.slice(F.array_sort(rows, lambda x, y: _by(x, y)), 1, pool)

    # each in a transform of its own, so that neither is worked out again where the other is used
    def measured(j: Column) -> Column:
        norm = F.col("length") * j["length"]
        score = F.coalesce(F.when(norm > 0, dot(F.col("vector"), j["embedding"]) / norm).otherwise(0.0), F.lit(0.0))
        hits = F.size(F.filter(j["terms"], lambda t: stands(F.col("lowered"), t["phrase"], t["words"]))).cast("double")
        return F.struct(j["cid"].alias("cid"), j["name"].alias("name"), score.alias("score"), hits.alias("hits"))

    judged = lambda m: F.struct(m["cid"].alias("cid"), m["name"].alias("name"), m["score"].alias("score"), prescreen(m["score"], m["hits"]).alias("prescreen"))
    best = met.select("doc_id", order(F.transform(F.transform("js", measured), judged)).alias("best"))
    if not small:
        best = best.groupBy("doc_id").agg(order(F.flatten(F.collect_list("best"))).alias("best"))
    return best.select("doc_id", F.posexplode("best").alias("place", "b")).select("doc_id", "b.cid", "b.name", "b.score", "b.prescreen", (F.col("place") + 1).alias("place"))


def _by(x: Column, y: Column) -> Column:
    """The order of candidates: prescreen and score from high to low, then the id."""
    key = lambda c, sign: F.when(x[c] < y[c], sign).when(x[c] > y[c], -sign)
    return F.coalesce(key("prescreen", 1), key("score", 1), key("cid", -1), F.lit(0))


def normal_name(name: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " ")), r"\s+")
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NAME_STOPS)), " ")


def names_match(a: Column, b: Column) -> Column:
    """Equal normalised names, containment over 0.92 of the length, or a Dice over 0.9 of two shared words or more."""
    return normal_match(*[x for n in (normal_name(a), normal_name(b)) for x in (n, name_words(n))])


def name_words(normal: Column) -> Column:
    return F.array_distinct(F.split(normal, " "))


def normal_match(na: Column, ta: Column, nb: Column, tb: Column) -> Column:
    """names_match() of two normalised names with their words."""
    shared = F.size(F.array_intersect(ta, tb))
    inside = (F.contains(na, nb) | F.contains(nb, na)) & (F.least(F.length(na), F.length(nb)) / F.greatest(F.length(na), F.length(nb)) > 0.92)
    dice = (shared >= 2) & (shared * 2.0 / (F.size(ta) + F.size(tb)) > 0.9)
    return (na != "") & (nb != "") & ((na == nb) | inside | dice)


def gate_picks(picks: DataFrame, candidates: DataFrame) -> DataFrame:
    """JN-23: (doc_id, cid, name, fit): external picks (doc_id, pick_no, journal_id, journal_name, fit) that name a candidate: by id and name, else by a strong name match; blended with the prescreen.

    A document's picks meet its candidates, which are a pool's; names are normalised before, once each.
    """
    normal = lambda df, c, n: df.withColumn(f"n{n}", normal_name(F.col(c))).withColumn(f"t{n}", name_words(F.col(f"n{n}")))
    left = normal(picks.select("doc_id", "pick_no", "journal_id", "journal_name", F.col("fit").alias("external")), "journal_name", "a")
    right = normal(candidates.select("doc_id", "cid", "name", "score", "prescreen", "place"), "name", "b")
    same = F.coalesce(F.col("journal_id") == F.col("cid"), F.lit(False))
    match = (same | F.arrays_overlap("ta", "tb")) & normal_match(F.col("na"), F.col("ta"), F.col("nb"), F.col("tb"))
    both = left.join(right, "doc_id").filter(match).withColumn("how", F.when(same, 0).otherwise(1))
    first = Window.partitionBy("doc_id", "pick_no").orderBy("how", "place")
    found = both.withColumn("k", F.row_number().over(first)).filter("k = 1")
    once = Window.partitionBy("doc_id", "cid").orderBy("pick_no")
    kept = found.withColumn("k", F.row_number().over(once)).filter("k = 1")
    fit = F.when((F.col("score") < 0.2) & (F.col("prescreen") < 40), F.col("external") * 0.8).otherwise(F.col("external") * 0.45 + F.col("prescreen") * 0.55)
    return kept.select("doc_id", "cid", "name", F.bround(fit, 1).alias("fit"))


def recommend(gated: DataFrame, candidates: DataFrame, k: int = 3) -> DataFrame:
    """TK-1: (doc_id, rank, cid, name): gated picks by fit, then the pool in its order, k in all."""
    rest = candidates.join(gated, ["doc_id", "cid"], "left_anti").select("doc_id", "cid", "name", F.lit(1).alias("how"), F.col("place").cast("double").alias("key"))
    every = gated.select("doc_id", "cid", "name", F.lit(0).alias("how"), (-F.col("fit")).alias("key")).union(rest)
    order = Window.partitionBy("doc_id").orderBy("how", "key", "cid")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("doc_id", "rank", "cid", "name")


def explain_ranks(top: DataFrame) -> DataFrame:
    """WN-9: top (doc_id, rank, cid, score, impact_factor) with tier, fit, gap to the next and impact labels."""
    s, after = F.col("score"), F.lead("score").over(Window.partitionBy("doc_id").orderBy("rank"))
    gap = s - after
    tier = F.when(s >= 0.75, "strong").when(s >= 0.5, "good").when(s >= 0.35, "moderate").when(s > 0, "loose").otherwise("fallback")
    fit = F.when(s >= 0.75, "Primary target").when(s >= 0.55, "Strong fit").when(s >= 0.4, "Reasonable fit").when(s > 0, "Worth considering").otherwise("Fallback candidate")
    lead = F.when(after.isNull() | (s <= 0) | (after <= 0), None).when(gap >= 0.1, "clearly ahead").when(gap >= 0.03, "edges out").otherwise("narrowly")
    v = F.col("impact_factor")
    impact = F.when(v.isNull() | (v == 0), None).when(v >= 3.5, "high").when(v >= 2, "mid").when(v >= 1, "modest").otherwise("low")
    return top.select("doc_id", "rank", "cid", tier.alias("tier"), fit.alias("fit"), lead.alias("lead"), impact.alias("impact"))


def topic_domain(topics: DataFrame) -> DataFrame:
    """JN-24: topics (topic) with their domain: of the domain words that a topic contains, the longest decides."""
    rows = [(d, w, len(w), i) for i, (d, ws) in enumerate(DOMAINS.items()) for w in ws]
    words = topics.sparkSession.createDataFrame(rows, "domain string, word string, size int, place int")
    both = topics.select("topic").distinct().join(F.broadcast(words), F.contains(F.lower("topic"), F.col("word")))  # a fixed list
    return both.groupBy("topic").agg(F.max_by("domain", F.struct("size", -F.col("place"))).alias("domain"))


def detect_domain(top: DataFrame, journals: DataFrame, consider: int = 3) -> DataFrame:
    """AG-24: (doc_id, domain, agreed, of, others): the vote of a document's first journals, each by its first topic that has a domain."""
    topics = journals.select("cid", F.posexplode("topics").alias("at", "topic"))
    named = topics.join(topic_domain(topics), "topic").groupBy("cid").agg(F.min_by("domain", "at").alias("domain"))
    votes = top.filter(F.col("rank") <= consider).join(named, "cid").groupBy("doc_id", "domain").agg(F.count("*").alias("n"), F.min("rank").alias("seen"))
    best = votes.groupBy("doc_id").agg(F.max_by("domain", F.struct("n", -F.col("seen"))).alias("domain"), F.max("n").alias("agreed"), F.sum("n").alias("of"), F.array_sort(F.collect_set("domain")).alias("all"))
    return best.select("doc_id", "domain", "agreed", "of", F.array_join(F.array_except("all", F.array("domain")), ",").alias("others"))


def originality(p: DataFrame, corpus: DataFrame, sources: int = 3) -> DataFrame:
    """JN-25: (doc_id, idx, place, sentence, n_sources, sources): sentences that stand word for word in a comparison corpus (source_id, text).

    Joined on a hash of the normalised sentence, then on the sentence itself; up
    to `sources` sources are named, the least ids, found by a map-side minimum.
    """
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    mine = sentences(p).withColumn("norm", norm(F.col("sentence"))).withColumn("h", F.xxhash64("norm"))
    theirs = corpus.select("source_id", F.explode(F.split("text", r"(?<=[.!?])\s+")).alias("s")).select("source_id", norm(F.col("s")).alias("known")).filter("known <> ''").distinct()
    ranked = theirs.withColumn("k", F.row_number().over(Window.partitionBy("known").orderBy("source_id")))
    few = ranked.groupBy("known").agg(F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.when(F.col("k") <= sources, F.col("source_id")))).alias("sources")).withColumn("h", F.xxhash64("known"))
    return mine.join(few, "h").filter("norm = known").select("doc_id", "idx", "place", "sentence", "n_sources", F.array_join(F.col("sources").cast("array<string>"), ",").alias("sources"))


def originality_score(p: DataFrame, flags: DataFrame) -> DataFrame:
    """AG-25: (doc_id, checked, flagged, score): 100 times the share of sentences that are nowhere else, half to even."""
    checked = sentences(p).groupBy("doc_id").agg(F.count("*").alias("checked"))
    hit = flags.groupBy("doc_id").agg(F.count("*").alias("flagged"))
    both = checked.join(hit, "doc_id", "left").withColumn("flagged", F.coalesce("flagged", F.lit(0)))
    return both.withColumn("score", F.bround(100 * (1 - F.col("flagged") / F.col("checked")), 0).cast("int"))


def sample_sentences(p: DataFrame, most: int = 25) -> DataFrame:
    """WN-13: an even sample of at most `most` sentences of each document (the feature is the sample)."""
    doc = Window.partitionBy("doc_id")
    numbered = sentences(p).withColumn("i", F.row_number().over(doc.orderBy("idx", "place")) - 1).withColumn("n", F.count("*").over(doc))
    step = F.col("n") / F.lit(float(most))
    slot = F.ceil(F.col("i") / step)
    return numbered.filter((F.col("n") <= most) | ((F.floor(slot * step) == F.col("i")) & (slot < most))).select("doc_id", "idx", "place", "sentence")


def public_recs(recs: DataFrame) -> DataFrame:
    """FIL-16: recommendations for readers: no vectors, scores as numbers."""
    return recs.select("doc_id", "rank", "name", F.round(F.col("score").cast("double"), 4).alias("score"))
