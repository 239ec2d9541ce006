"""Rules as batch audits: each takes records and adds a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil import functions as X
from torquil.config import DEFAULTS, FIELD_RANGES, REQUIRED_FIELDS
from torquil.operators.catalogue import Catalogue


def input_verdicts(records: DataFrame, json: str, required: tuple[str, ...], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """records with passed and reason (missing:x, not_numeric:x, out_of_range:x or null), in that order. Null JSON lacks all."""
    fields = tuple(dict.fromkeys((*required, *ranges)))
    raw = F.from_json(json, ", ".join(f"`{f}` string" for f in fields))
    out = records.withColumn("__r", raw)
    text = {f: F.col(f"__r.{f}") for f in fields}
    number = {f: text[f].try_cast("double") for f in ranges}
    missing = [F.when(text[f].isNull() | (F.trim(text[f]) == ""), F.lit(f"missing:{f}")) for f in required]
    wrong = [F.when(text[f].isNotNull() & (number[f].isNull() | F.isnan(number[f])), F.lit(f"not_numeric:{f}")) for f in ranges]
    beyond = [F.when((number[f] < lo) | (number[f] > hi), F.lit(f"out_of_range:{f}")) for f, (lo, hi) in ranges.items()]
    reason = F.coalesce(*missing, *wrong, *beyond)
    return out.withColumn("reason", reason).withColumn("passed", F.col("reason").isNull()).drop("__r")


def confident(p: Column, least: float = DEFAULTS.least_confidence) -> Column:
    """An absent confidence passes."""
    return F.coalesce(p >= least, F.lit(True))


def relevant(hits: DataFrame, query: str = "query", least: float = DEFAULTS.least_score) -> DataFrame:
    """(query, best, good, passed): one section of the score or more."""
    return hits.groupBy(query).agg(F.max("score").alias("best"), F.count_if(F.col("score") >= least).alias("good"), (F.count_if(F.col("score") >= least) >= 1).alias("passed"))


def citations(answers: DataFrame, id: str, text: str, supplied: DataFrame) -> DataFrame:
    """(id, cited, unknown, passed): citations "(Doc1, section 4)", documents in either case and sections exactly, all among supplied (id, document, section); one at least."""
    pattern = r"(?i)\(?\b(doc\d+)\s*[,;]?\s*(?:section|se[cç][aã]o|sec\.?)\s*(\d+(?:\.\d+)*)"
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("d"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("s"))
    cited = answers.select(id, F.explode(both).alias("c")).select(id, F.lower("c.d").alias("document"), F.col("c.s").alias("section")).distinct()
    unknown = cited.join(supplied.select(id, F.lower("document").alias("document"), "section"), [id, "document", "section"], "left_anti").groupBy(id).agg(F.count("*").alias("unknown"))
    n = cited.groupBy(id).agg(F.count("*").alias("cited"))
    out = answers.select(id).join(n, id, "left").join(unknown, id, "left").select(id, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cited", "unknown")])
    return out.withColumn("passed", (F.col("cited") > 0) & (F.col("unknown") == 0))


def _plain(number: Column) -> Column:
    """A decimal point, and no zeros at the end of decimals."""
    dotted = F.replace(number, F.lit(","), F.lit("."))
    return F.when(dotted.contains("."), F.regexp_replace(dotted, r"\.?0+$", "")).otherwise(dotted)


def _decimal(value: Column) -> Column:
    """A double's digits without an exponent."""
    size = F.abs(value)
    return F.when((size >= 1e-3) & (size < 1e7), value.cast("string")).when(size >= 1e7, F.format_string("%.6f", value)).otherwise(F.format_string("%.15f", value))


def numbers(answers: DataFrame, id: str, text: str, facts: DataFrame) -> DataFrame:
    """(id, written, unknown, passed): every run of digits in the text, with decimals or not and whatever stands beside it, is a fact (id, value): whole, rounded to one to three decimals, or as a percentage if the fact is from 0 to 1."""
    found = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), 0)
    written = answers.select(id, F.explode(found).alias("x")).select(id, _plain(F.col("x")).alias("x")).distinct()
    v = F.col("value").cast("double")
    share = [F.when(v.between(0, 1), F.round(v * 100, n)) for n in (1, 0)]
    forms = facts.select(id, F.explode(F.array(*[_decimal(x) for x in (v, F.round(v, 1), F.round(v, 2), F.round(v, 3), *share)])).alias("x")).select(id, _plain(F.col("x")).alias("x")).distinct()
    unknown = written.join(forms, [id, "x"], "left_anti").groupBy(id).agg(F.count("*").alias("unknown"))
    n = written.groupBy(id).agg(F.count("*").alias("written"))
    out = answers.select(id).join(n, id, "left").join(unknown, id, "left").select(id, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("written", "unknown")])
    return out.withColumn("passed", F.col("unknown") == 0)


def first_failure(rules: list[tuple[str, Column]]) -> Column:
    """The first rule that fails, in the order given; null if none does."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules])


def admitted(records: DataFrame, id: str, json: str, label: str, classified: DataFrame, catalogue: Catalogue, required: tuple[str, ...] = REQUIRED_FIELDS, ranges: dict[str, tuple[float, float]] = FIELD_RANGES) -> DataFrame:
    """records with family, confidence, failed (the first rule that fails, or null) and diverges.

    G0 holds the JSON record against required fields and ranges, G1 the confidence, G2 whether the family is a problem,
    G3 whether it has a document. The family is the model's, of classified (id, family, confidence); the operator's label
    counts only where there is none, and diverges says that it tells of another family.
    """
    checked = input_verdicts(records, json, required, ranges).withColumnsRenamed({"passed": "__g0", "reason": "__reason"})
    told = checked.join(classified.select(id, F.col("family").alias("__family"), "confidence"), id, "left")
    named = catalogue.situation(told, label).withColumnRenamed("family", "__labelled").drop("is_problem", "situation")
    out = catalogue.situation(named.withColumn("__asked", F.coalesce("__family", label)), "__asked")
    rules = [("G0", F.col("__g0")), ("G1", confident(F.col("confidence"))), ("G2", F.col("situation").isin("no_document", "ok")), ("G3", F.col("situation") == "ok")]
    out = out.withColumn("failed", first_failure(rules)).withColumn("diverges", F.coalesce(F.col("__family") != F.col("__labelled"), F.lit(False)))
    return out.select(*records.columns, F.coalesce("__family", "family").alias("family"), "confidence", "failed", "diverges")


def sentences(df: DataFrame, family: str, value: str) -> DataFrame:
    """(family, sentence): the facts of each block, its readings and their mean to one decimal, as a sentence."""
    facts = df.groupBy(family).agg(F.count("*").alias("n"), F.round(F.avg(value), 1).cast("decimal(18,1)").alias("mean"))
    return facts.select(family, F.concat_ws("", F.lit("Family "), family, F.lit(": "), F.col("n").cast("string"), F.lit(" readings, mean "), F.col("mean").cast("string"), F.lit(".")).alias("sentence"))


def cleaned_symptoms(cases: DataFrame, id: str, source: str, items: str, most: int = 6) -> DataFrame:
    """(id, symptoms): listed symptoms that share a content word with the source, each once whatever its case, the first `most`; the source if none is left."""
    listed = cases.select(id, source, F.posexplode_outer(items).alias("at", "item")).withColumn("item", F.trim("item"))
    ok = listed.where("item is not null and item <> ''").where(F.arrays_overlap(X.words(F.col("item")), X.words(F.col(source))))
    once = ok.withColumn("__d", F.row_number().over(Window.partitionBy(id, F.lower("item")).orderBy("at"))).where("__d = 1")
    first = once.withColumn("__n", F.row_number().over(Window.partitionBy(id).orderBy("at"))).where(F.col("__n") <= most)
    kept = first.groupBy(id).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]).alias("s"))
    return cases.select(id, source).join(kept, id, "left").select(id, F.coalesce("s", F.array(F.col(source))).alias("symptoms"))
