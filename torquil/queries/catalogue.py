"""Labels, families, documents and their coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquil import functions as X
from torquil.operators import catalogue as K, profile as P, rules as H, segment as S
from torquil.operators.search import sections_of_fields
from torquil.queries import query, readings, table
from torquil.queries.monitoring import EVENTS

FAMILIES = [
    {"name": "fault_click", "is_problem": True, "coverage": "full", "aliases": ["click", "clk"], "documents": ["src1", "src2"]},
    {"name": "fault_error", "is_problem": True, "coverage": "full", "aliases": ["error"], "documents": ["src2", "src3"]},
    {"name": "fault_purchase", "is_problem": True, "coverage": "partial", "aliases": ["purchase"], "documents": []},
    {"name": "normal", "is_problem": False, "coverage": "none", "aliases": ["signup", "never"], "documents": []},
]
CAT = """fam AS (SELECT * FROM (VALUES ('fault_click', true, 'full'), ('fault_error', true, 'full'), ('fault_purchase', true, 'partial'), ('normal', false, 'none')) t(family, is_problem, cov)),
ali AS (SELECT * FROM (VALUES ('fault_click','click'), ('fault_click','clk'), ('fault_error','error'), ('fault_purchase','purchase'), ('normal','signup'), ('normal','never')) t(family, label)),
doc AS (SELECT * FROM (VALUES ('fault_click','src1'), ('fault_click','src2'), ('fault_error','src2'), ('fault_error','src3')) t(family, document)), vol AS (SELECT family, count(*) AS n FROM events JOIN ali ON label = event_type GROUP BY family)"""
PATTERNS = [("^auto", "vehicle"), ("build|house", "home"), ("mach", "machine")]


def _catalogue(spark):
    return K.Catalogue.of(spark, FAMILIES)


@query("WITH " + CAT + " SELECT event_type, coalesce(family, '?') AS family, is_problem, count(*) AS n FROM events LEFT JOIN ali ON label = event_type LEFT JOIN fam USING (family) GROUP BY ALL")
def label_families(spark, d):
    """J-01, J-06: labels with their family, those without one too."""
    return _catalogue(spark).with_family(table(spark, d, "events"), "event_type").groupBy("event_type", F.coalesce("family", F.lit("?")).alias("family"), "is_problem").agg(F.count("*").alias("n"))


@query("WITH " + CAT + " SELECT family, count(*) AS n FROM events JOIN ali ON label = event_type JOIN fam USING (family) WHERE is_problem GROUP BY family")
def problem_readings(spark, d):
    """P-09, M-01, A-04: catalogued problems only."""
    return _catalogue(spark).with_family(table(spark, d, "events"), "event_type", "inner").where("is_problem").groupBy("family").agg(F.count("*").alias("n"))


@query("WITH " + CAT + ", x AS (SELECT CASE WHEN event_id%10=0 THEN 'fault_error' ELSE event_type END AS l FROM events) SELECT CASE WHEN a.family IS NULL THEN 'unknown' WHEN NOT is_problem THEN 'state' WHEN a.family NOT IN (SELECT family FROM doc) THEN 'no_document' ELSE 'ok' END AS situation, count(*) AS n FROM x LEFT JOIN (SELECT label, family FROM ali UNION SELECT family, family FROM fam) a ON a.label = l LEFT JOIN fam USING (family) GROUP BY 1")
def situations(spark, d):
    """H-03, H-04, J-02: unknown, state, no document, ok; a label may be a family's name."""
    df = table(spark, d, "events").withColumn("l", F.when(F.col("event_id") % 10 == 0, "fault_error").otherwise(F.col("event_type")))
    return _catalogue(spark).situation(df, "l").groupBy("situation").agg(F.count("*").alias("n"))


@query("WITH " + CAT + " SELECT f.family, is_problem, coalesce(string_agg(document, ',' ORDER BY document), '') AS documents, CASE WHEN count(document) > 0 THEN 'documented' WHEN any_value(cov) = 'partial' THEN 'partial' ELSE 'none' END AS coverage, is_problem AND count(document) > 0 AS released, coalesce(any_value(n), 0) AS n FROM fam f LEFT JOIN doc d ON d.family = f.family LEFT JOIN vol v ON v.family = f.family GROUP BY f.family, is_problem")
def family_coverage(spark, d):
    """R-04, G-A23, J-07."""
    c = _catalogue(spark)
    volumes = table(spark, d, "events").join(F.broadcast(c.aliases), F.col("event_type") == F.col("label")).groupBy("family").agg(F.count("*").alias("n"))
    return c.coverage(volumes)


@query("WITH " + CAT + " SELECT DISTINCT event_type AS label, 'data' AS side FROM events WHERE event_type NOT IN (SELECT label FROM ali) UNION ALL SELECT label, 'catalogue' FROM ali WHERE label NOT IN (SELECT event_type FROM events)")
def catalogue_completeness(spark, d):
    """H-10, J-10."""
    return _catalogue(spark).completeness(table(spark, d, "events"), "event_type")


@query("WITH " + CAT + ", g AS (SELECT document, list_sort(list(family)) AS f FROM doc GROUP BY document), n AS (SELECT document, CASE WHEN len(f) = 1 THEN f[1] ELSE concat('fault x', len(f)) END AS name, CASE WHEN len(f) = 1 THEN f[1] END AS family FROM g) SELECT source AS document, name, family, count(*) AS texts FROM documents JOIN n ON document = source GROUP BY ALL")
def document_names(spark, d):
    """P-11, with the number of texts."""
    texts = table(spark, d, "documents").groupBy(F.col("source").alias("document")).agg(F.count("*").alias("texts"))
    return texts.join(F.broadcast(_catalogue(spark).document_names()), "document")


@query("WITH t AS (SELECT DISTINCT lang, source, CAST(doc_id%7 AS VARCHAR) AS n FROM documents), c AS (SELECT lang, source, string_agg(n, ',' ORDER BY n) AS cell FROM t GROUP BY ALL), p AS (SELECT lang, count(DISTINCT source) AS n_documents FROM t GROUP BY lang), f AS (SELECT p.lang, p.n_documents, s.source, coalesce(cell, '') AS cell FROM p CROSS JOIN (SELECT DISTINCT source FROM t) s LEFT JOIN c ON c.lang = p.lang AND c.source = s.source) PIVOT f ON source USING any_value(cell) GROUP BY lang, n_documents")
def field_matrix(spark, d):
    """G-A25: a column for each document."""
    df = table(spark, d, "documents").select("lang", "source", (F.col("doc_id") % 7).cast("string").alias("n")).distinct()
    return K.field_matrix(df, "source", "lang", "n")


@query("WITH s AS (SELECT DISTINCT source, concat(lang, '-', CAST(CAST(floor(n_chars/2000) AS BIGINT) AS VARCHAR)) AS field FROM documents) SELECT a.source, b.field FROM (SELECT DISTINCT source FROM s) a, (SELECT DISTINCT field FROM s) b WHERE (a.source, b.field) NOT IN (SELECT (source, field) FROM s)")
def missing_fields(spark, d):
    """J-11: a field is a language and a class of length."""
    docs = table(spark, d, "documents").withColumn("field", F.concat("lang", F.lit("-"), F.floor(F.col("n_chars") / 2000).cast("string")))
    return K.missing_fields(docs, "source", "field")


@query("WITH s AS (SELECT c_mktsegment, CASE WHEN regexp_matches(lower(trim(c_mktsegment)), '^auto') THEN 'vehicle' WHEN regexp_matches(lower(trim(c_mktsegment)), 'build|house') THEN 'home' WHEN regexp_matches(lower(trim(c_mktsegment)), 'mach') THEN 'machine' ELSE '?' END AS family, regexp_matches(lower(trim(c_mktsegment)), '(ing|old)$') AS has_suffix, starts_with(lower(trim(c_mktsegment)), 'ma') AS has_prefix FROM customer) SELECT family, count(*) AS n, count(DISTINCT c_mktsegment) AS labels, count(*) FILTER (has_suffix) AS suffixed, count(*) FILTER (has_prefix) AS prefixed, family <> '?' AS is_problem FROM s GROUP BY family")
def suggested_families(spark, d):
    """P-06, G-A18, F-01: first pattern that matches, session suffix and prefix."""
    df = K.suggested_families(table(spark, d, "customer"), "c_mktsegment", PATTERNS, "(ing|old)$", "ma")
    return df.groupBy("family").agg(F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("labels"), F.count_if("has_suffix").alias("suffixed"), F.count_if("has_prefix").alias("prefixed")).withColumn("is_problem", F.col("family") != "?")


@query("SELECT doc_id, CASE WHEN regexp_matches(t, 'tion|ment') THEN 'aim' WHEN regexp_matches(t, 'ung|keit') THEN 'tools' WHEN regexp_matches(t, 'eau|que') THEN 'steps' ELSE 'other' END AS field FROM (SELECT doc_id, lower(translate(split_part(text, chr(10), 1), 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN')) AS t FROM documents)")
def canonical_fields(spark, d):
    """P-07, F-02: field of a title, accents folded."""
    title = F.lower(X.folded(F.split_part("text", F.lit("\n"), F.lit(1))))
    return table(spark, d, "documents").select("doc_id", X.first_match(title, [("tion|ment", "aim"), ("ung|keit", "tools"), ("eau|que", "steps")], "other").alias("field"))


@query("WITH p AS (SELECT doc_id, CASE WHEN doc_id%5=0 THEN NULL ELSE doc_id%9 END AS a, CASE WHEN doc_id%4=0 THEN NULL ELSE doc_id%9 + doc_id%2 END AS b FROM documents) SELECT doc_id, CASE WHEN a IS NULL THEN '' WHEN b IS NULL OR a = b THEN CAST(a AS VARCHAR) ELSE concat(a, '-', b) END AS pages FROM p")
def page_ranges(spark, d):
    """P-10."""
    a = F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") % 9)
    b = F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 9 + F.col("doc_id") % 2)
    return table(spark, d, "documents").select("doc_id", K.page_range(a, b).alias("pages"))


@query("WITH {r}, p AS (SELECT fault, count(*) AS n FROM r GROUP BY fault) SELECT * FROM p WHERE contains(lower(fault), 'l') AND fault <> 'L0'")
def label_search(spark, d):
    """P-08: labels by part of their name, problems only."""
    df = P.label_profile(readings(spark, d)).where(F.lower("fault").contains("l") & F.col("is_problem"))
    return df.select("fault", "n")


@query("SELECT doc_id, cast(len(text) as bigint) AS n FROM documents WHERE source IN (SELECT source FROM documents WHERE lang = 'es') AND lang IN ('en', 'fr')")
def authorised_sections(spark, d):
    """J-09, R-12: semi-filter by documents, and fields in a set."""
    docs = table(spark, d, "documents")
    allowed = docs.where("lang = 'es'").select("source").distinct()
    return sections_of_fields(docs, allowed, ("en", "fr"), "source", "lang").select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, turn, role, back FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations WHERE role <> 'system') WHERE back <= 4")
def last_turns(spark, d):
    """T-04: the last four turns that were not refused (top-k is the feature)."""
    return K.last_turns(table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", "role"), "conv_id", "turn", 4)


_HISTORY = """a AS (SELECT conv_id, turn, text, turn%5 = 4 AS refused, turn%7 = 3 AS classified, turn%4 <> 3 AS verified, conv_id%6 = 5 AS degraded FROM conversations WHERE role = 'assistant'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM a WHERE NOT refused),
s AS (SELECT k.conv_id, k.turn, string_agg(concat('[Doc', k.conv_id%3, ', section ', k.turn - c.turn, '] ', trim(c.text)), chr(10) || chr(10) ORDER BY c.turn DESC) AS source FROM k JOIN conversations c ON c.conv_id = k.conv_id AND c.turn IN (k.turn - 1, k.turn - 2) GROUP BY ALL)"""


@query("WITH " + _HISTORY + " SELECT conv_id, turn, back, CASE WHEN verified AND NOT degraded THEN 'assistant' ELSE 'system' END AS author, md5(CASE WHEN verified AND NOT degraded OR classified THEN concat(text, ' (Doc', conv_id%3, ', section ', turn%4, ')') ELSE coalesce(source, 'nothing found') END) AS content FROM k LEFT JOIN s USING (conv_id, turn) WHERE back <= 4")
def history(spark, d):
    """T-04: the last four turns that were not refused (top-k is the feature), unverified answers replaced by their sources."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    cited = F.concat("text", F.lit(" (Doc"), (F.col("conv_id") % 3).cast("string"), F.lit(", section "), (F.col("turn") % 4).cast("string"), F.lit(")"))
    turns = c.where("role = 'assistant'").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key"), cited.alias("answer"), (F.col("turn") % 5 == 4).alias("refused"), (F.col("turn") % 7 == 3).alias("classified"), (F.col("conv_id") % 6 == 5).alias("degraded"), F.lit("nothing found").alias("reason"))
    supplied = turns.select("key", F.concat(F.lit("Doc"), (F.col("conv_id") % 3).cast("string")).alias("document"), F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("section"))
    verdicts = H.citations(turns, "key", "answer", supplied).select("key", F.col("passed").alias("verified"))
    back = c.select("conv_id", F.col("turn").alias("at"), "text")
    excerpts = turns.select("conv_id", "turn").join(back, "conv_id").withColumn("rank", F.col("turn") - F.col("at")).where("rank in (1, 2)")
    excerpts = excerpts.withColumn("reference", F.concat(F.lit("Doc"), (F.col("conv_id") % 3).cast("string"), F.lit(", section "), F.col("rank").cast("string")))
    return K.history(turns.join(verdicts, "key"), excerpts, "conv_id", "turn", 4).withColumn("content", F.md5("content"))


@query("WITH {r}, " + EVENTS + ", " + CAT + " SELECT event, family, count(*) AS n FROM e1 JOIN ali ON label = event_type JOIN fam USING (family) WHERE is_problem GROUP BY ALL")
def prepared_events(spark, d):
    """M-01: readings numbered by event, of catalogued problems only."""
    return K.prepared(S.events(readings(spark, d)), _catalogue(spark), "event_type", True).groupBy("event", "family").agg(F.count("*").alias("n"))


@query("WITH {r}, x AS (SELECT CASE WHEN machine%5 = 0 THEN NULL ELSE machine END AS m, id, created_at FROM r) SELECT m, arg_min(id, (created_at, id)) AS id FROM x GROUP BY m")
def first_readings(spark, d):
    """U-04: the first reading of each machine, those without one as one."""
    df = readings(spark, d).select(F.when(F.col("machine") % 5 != 0, F.col("machine")).alias("m"), "id", "created_at")
    return K.first_of(df, ("m",), ("created_at", "id")).select("m", "id")
