"""Rules as audits over tables, and functions inside them."""

from __future__ import annotations

from pyspark.sql import functions as F

from torquil import functions as X
from torquil.operators import rules as H
from torquil.operators.catalogue import Catalogue, drawn_entity
from torquil.operators.model import ranked, top_family
from torquil.queries import query, table
from torquil.queries.catalogue import CAT, FAMILIES

RANGES = {"rpm": (0.0, 2000.0), "temp": (-40.0, 200.0)}


@query("SELECT event_id, CASE WHEN event_id%11=0 THEN 'missing:rpm' WHEN event_id%13=0 THEN 'not_numeric:temp' WHEN value > 2000 THEN 'out_of_range:rpm' END AS reason FROM (SELECT event_id, round(value*30, 2) AS value FROM events)")
def input_verdicts(spark, d):
    """H-01, F-08: JSON records; missing before not numeric before out of range."""
    rpm = F.when(F.col("event_id") % 11 != 0, F.round(F.col("value") * 30, 2).cast("string"))
    temp = F.when(F.col("event_id") % 13 == 0, "hot").otherwise("20")
    df = table(spark, d, "events").select("event_id", F.to_json(F.struct(rpm.alias("rpm"), temp.alias("temp"))).alias("j"))
    return H.input_verdicts(df, "j", ("rpm", "temp"), RANGES).select("event_id", "reason")


@query("SELECT event_id, coalesce(c >= 0.3, true) AS passed FROM (SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE (event_id%100)/100 END AS c FROM events)")
def confidence(spark, d):
    """H-02: an absent confidence passes."""
    c = F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 100) / 100)
    return table(spark, d, "events").select("event_id", H.confident(c).alias("passed"))


@query("WITH a AS (SELECT event_id, event_id%3 AS d, event_id%4 AS s, event_id%7=0 AS none FROM events) SELECT event_id, CASE WHEN none THEN 0 ELSE 1 END AS cited, CASE WHEN NOT none AND s = 3 THEN 1 ELSE 0 END AS unknown, NOT none AND s <> 3 AS passed FROM a")
def citations(spark, d):
    """H-07, S26, F-09: cited sections among those supplied."""
    e = table(spark, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "No source.").otherwise(F.concat(F.lit("As in (DOC"), (F.col("event_id") % 3).cast("string"), F.lit(", section "), (F.col("event_id") % 4).cast("string"), F.lit(")")))
    supplied = e.select("event_id", F.concat(F.lit("Doc"), (F.col("event_id") % 3).cast("string")).alias("document"), F.explode(F.array(F.lit("0"), F.lit("1"), F.lit("2"))).alias("section"))
    return H.citations(e.select("event_id", text.alias("t")), "event_id", "t", supplied)


_TEXTS = "CASE event_id%8 WHEN 0 THEN concat('at ', CAST(v AS {s})) WHEN 1 THEN concat(CAST(CAST(round(v*100) AS BIGINT) AS {s}), '% of it') WHEN 2 THEN concat('at ', replace(CAST(v AS {s}), '.', ',')) WHEN 3 THEN concat(CAST(event_id%50 AS {s}), 'mm/s') WHEN 4 THEN '1.234.567' WHEN 5 THEN concat('about ', CAST(round(v, 2) AS {s}), '00') WHEN 6 THEN concat(CAST(v*100 AS {s}), ' and ', CAST(event_id%7 AS {s})) ELSE NULL END"
_FACT = "CASE WHEN event_id%16 < 8 THEN event_id%1000/CAST(1000 AS DOUBLE) ELSE CAST(event_id%60 AS DOUBLE) END"


@query("WITH e AS (SELECT event_id, " + _FACT + " AS v FROM events), t AS (SELECT *, " + _TEXTS.format(s="VARCHAR") + r""" AS t FROM e),
w AS (SELECT event_id, v, list_distinct(list_transform(regexp_extract_all(coalesce(t, ''), '\d+(?:[.,]\d+)?'), lambda x: CASE WHEN contains(replace(x, ',', '.'), '.') THEN regexp_replace(replace(x, ',', '.'), '\.?0+$', '') ELSE x END)) AS w,
  list_transform([v, round(v, 1), round(v, 2), round(v, 3), CASE WHEN v BETWEEN 0 AND 1 THEN round(v*100, 1) END, CASE WHEN v BETWEEN 0 AND 1 THEN round(v*100) END], lambda y: regexp_replace(CAST(y AS VARCHAR), '\.?0+$', '')) AS f FROM t)
SELECT event_id, len(w) AS written, len(list_filter(w, lambda x: NOT coalesce(list_contains(f, x), false))) AS unknown, len(list_filter(w, lambda x: NOT coalesce(list_contains(f, x), false))) = 0 AS passed FROM w""")
def computed_numbers(spark, d):
    """H-08: numbers in a text are facts: whole, rounded, with a decimal comma, or as a percentage of a share; numbers beside letters or in groups count too."""
    e = table(spark, d, "events").selectExpr("event_id", _FACT + " AS v").selectExpr("*", _TEXTS.format(s="STRING") + " AS t")
    return H.numbers(e.select("event_id", "t"), "event_id", "t", e.select("event_id", F.col("v").alias("value")))


_RECORD = "event_id%11 <> 0 AND event_id%13 <> 0 AND value*30 <= 2000"


def _records(spark, d):
    rpm = F.when(F.col("event_id") % 11 != 0, (F.col("value") * 30).cast("string"))
    temp = F.when(F.col("event_id") % 13 == 0, "hot").otherwise("20")
    return table(spark, d, "events").select("event_id", "event_type", F.to_json(F.struct(rpm.alias("rpm"), temp.alias("temp"))).alias("j"))


@query("WITH " + CAT + ", pr AS (SELECT event_id, f.family, ((event_id*(i+3)*37)%101)/202e0 AS p FROM events, (VALUES ('fault_click', 0), ('fault_error', 1), ('fault_purchase', 2), ('normal', 3)) f(family, i) WHERE event_id%3 <> 0), top AS (SELECT event_id, family, p FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY p DESC, family) AS k FROM pr) WHERE k = 1),"
+ " x AS (SELECT e.event_id, coalesce(top.family, a.family) AS family, top.p AS c, coalesce(top.family <> a.family, false) AS diverges, " + _RECORD + " AS g0 FROM events e LEFT JOIN top USING (event_id) LEFT JOIN ali a ON label = event_type)"
+ " SELECT event_id, x.family, round(c, 6) AS confidence, CASE WHEN NOT g0 THEN 'G0' WHEN NOT coalesce(c >= 0.3, true) THEN 'G1' WHEN NOT coalesce(is_problem, false) THEN 'G2' WHEN x.family NOT IN (SELECT family FROM doc) THEN 'G3' END AS failed, diverges FROM x LEFT JOIN fam USING (family)")
def admission(spark, d):
    """H-09, H-11: the record, the model's confidence, its family (the operator's label where it has none), a problem, a document; over a table of probabilities that needs no forest."""
    names = F.explode(F.array(*[F.struct(F.lit(f["name"]).alias("class"), F.lit(i).alias("i")) for i, f in enumerate(FAMILIES)]))
    p = table(spark, d, "events").where("event_id % 3 <> 0").select("event_id", names.alias("f")).select("event_id", "f.class", ((F.col("event_id") * (F.col("f.i") + 3) * 37) % 101 / 202).alias("p"))
    out = H.admitted(_records(spark, d), "event_id", "j", "event_type", top_family(ranked(p, "event_id"), "event_id"), Catalogue.of(spark, FAMILIES), ("rpm", "temp"), RANGES)
    return out.select("event_id", "family", F.round("confidence", 6).alias("confidence"), "failed", "diverges")


@query("SELECT conv_id, turn, list_sort(list_distinct(list_filter(regexp_extract_all(lower(translate(text, 'áàâãäéèêëíìîïóòôõöúùûüçñÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑ', 'aaaaaeeeeiiiiooooouuuucnAAAAAEEEEIIIIOOOOOUUUUCN')), '[a-z0-9]+'), lambda x: length(x) >= 4))) AS words FROM conversations")
def content_words(spark, d):
    """F-03."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.sort_array(X.words(F.col("text"))).alias("words"))


@query()
def cleaned_symptoms(spark, d):
    """R-13: a conversation's symptoms held against its first text."""
    items = F.array_append(F.split("text", r"[.,;]"), F.lit("zzzz unrelated"))
    return H.cleaned_symptoms(table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("case"), "text", items.alias("items")), "case", "text", "items")


@query("SELECT conv_id, turn, CASE WHEN length(f) <= 60 THEN f ELSE concat(regexp_replace(substring(f, 1, 60), '\\s+\\S*$', ''), '…') END AS short FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS f FROM conversations)")
def shortened_texts(spark, d):
    """F-07."""
    return table(spark, d, "conversations").select("conv_id", "turn", X.shortened(F.col("text"), 60).alias("short"))


@query("WITH o AS (SELECT user_id, min(md5(concat('7:', user_id))) AS h FROM events GROUP BY user_id HAVING count(*) >= 3 ORDER BY h LIMIT 1) SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS i FROM events JOIN o USING (user_id)) WHERE i <= 3")
def random_event(spark, d):
    """T-05: the first rows of an entity drawn by a seed (a sampling operator)."""
    return drawn_entity(table(spark, d, "events"), "user_id", ("ts", "event_id"), 3, 3, 7).select("event_id")


@query("SELECT event_type, concat('Family ', event_type, ': ', count(*), ' readings, mean ', CAST(CAST(round(avg(value), 1) AS DECIMAL(18,1)) AS VARCHAR), '.') AS sentence FROM events GROUP BY event_type")
def block_sentences(spark, d):
    """R-17: facts of a block and the sentence made of them."""
    return H.sentences(table(spark, d, "events"), "event_type", "value")
