"""The curated catalogue between labels, families and documents: three flat tables, and what joins to them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from torquil.config import DEFAULTS
from torquil.functions import first_match
from torquil.sources import shared as T


@dataclass(frozen=True)
class Catalogue:
    """families (family, description, is_problem, coverage), aliases (family, label), documents (family, document)."""

    families: DataFrame
    aliases: DataFrame
    documents: DataFrame

    @classmethod
    def of(cls, spark: SparkSession, families: list[dict]) -> Catalogue:
        """From entries with name, description, is_problem, coverage, aliases and documents."""
        seen: dict[str, str] = {}
        for f in families:
            for a in f.get("aliases", ()):
                if seen.setdefault(a, f["name"]) != f["name"]:
                    raise ValueError(f"alias {a!r} is in {seen[a]!r} and {f['name']!r}")
        return cls(
            spark.createDataFrame([(f["name"], f.get("description", ""), f["is_problem"], f.get("coverage", "none")) for f in families], "family string, description string, is_problem boolean, coverage string"),
            spark.createDataFrame([(f["name"], a) for f in families for a in f.get("aliases", ())], "family string, label string"),
            spark.createDataFrame([(f["name"], x) for f in families for x in f.get("documents", ())], "family string, document string"),
        )

    @classmethod
    def from_json(cls, spark: SparkSession, path: str) -> Catalogue:
        """From a JSON-lines table of such entries; an alias in two families is an error."""
        raw = spark.read.schema("name string, description string, is_problem boolean, coverage string, aliases array<string>, documents array<string>").json(path)
        aliases = raw.select(F.col("name").alias("family"), F.explode("aliases").alias("label"))
        if aliases.groupBy("label").agg(F.count_distinct("family").alias("n")).where("n > 1").take(1):
            raise ValueError("an alias is in two families")
        return cls(raw.select(F.col("name").alias("family"), "description", "is_problem", F.coalesce("coverage", F.lit("none")).alias("coverage")), aliases, raw.select(F.col("name").alias("family"), F.explode("documents").alias("document")))

    def with_family(self, df: DataFrame, label: str, how: str = "left") -> DataFrame:
        """df with family and is_problem of its label; inner drops labels that are in no family. The catalogue is curated by hand and small."""
        return df.join(F.broadcast(self.aliases.join(self.families, "family").select(F.col("label").alias(label), "family", "is_problem")), label, how)

    def situation(self, df: DataFrame, label: str) -> DataFrame:
        """df with family and situation: unknown, state, no_document or ok. A label may be a family's name."""
        names = self.aliases.select("label", "family").union(self.families.select(F.col("family").alias("label"), "family")).dropDuplicates(["label"])
        covered = self.documents.groupBy("family").agg(F.count("*").alias("__docs"))
        about = names.join(self.families, "family").join(covered, "family", "left").select(F.col("label").alias("__l"), "family", "is_problem", F.coalesce("__docs", F.lit(0)).alias("__docs"))
        out = df.join(F.broadcast(about), F.col(label) == F.col("__l"), "left")
        return out.withColumn("situation", F.when(F.col("family").isNull(), "unknown").when(~F.col("is_problem"), "state").when(F.col("__docs") == 0, "no_document").otherwise("ok")).drop("__l", "__docs")

    def coverage(self, volumes: DataFrame | None = None) -> DataFrame:
        """(family, is_problem, documents, coverage, released): partial coverage without a linked document is none; with volumes (family, n), their rows, missing as 0."""
        docs = self.documents.groupBy("family").agg(F.sort_array(F.collect_set("document")).alias("d"))
        out = self.families.join(docs, "family", "left")
        status = F.when(F.col("d").isNotNull(), "documented").when(F.col("coverage") == "partial", "partial").otherwise("none")
        out = out.select("family", "is_problem", F.coalesce(F.array_join("d", ","), F.lit("")).alias("documents"), status.alias("coverage"), (F.col("is_problem") & F.col("d").isNotNull()).alias("released"))
        return out if volumes is None else out.join(volumes, "family", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    def completeness(self, labels: DataFrame, label: str) -> DataFrame:
        """(label, side): labels of the data that no family has (data), and aliases that the data lacks (catalogue)."""
        have = labels.select(F.col(label).alias("label")).where("label is not null").distinct()
        return have.join(F.broadcast(self.aliases), "label", "left_anti").withColumn("side", F.lit("data")).unionByName(self.aliases.select("label").join(have, "label", "left_anti").withColumn("side", F.lit("catalogue")))

    def document_names(self) -> DataFrame:
        """(document, name, family): families' names with a common beginning and their number, or the first and how many more; family only if it is the only one."""
        got = self.documents.groupBy("document").agg(F.sort_array(F.collect_set("family")).alias("f"))
        stem = F.split(F.col("f")[0], "_")[0]
        name = F.when(F.size("f") == 1, F.col("f")[0]).when(F.forall("f", lambda x: x.startswith(stem)), F.concat(stem, F.lit(" x"), F.size("f").cast("string"))).otherwise(F.concat(F.col("f")[0], F.lit(" +"), (F.size("f") - 1).cast("string")))
        return got.select("document", name.alias("name"), F.when(F.size("f") == 1, F.col("f")[0]).alias("family"))


def field_matrix(sections: DataFrame, document: str, field: str, number: str, documents: list[str] | None = None) -> DataFrame:
    """A row for each field, a column for each document, or for those given: its section numbers; and how many documents have the field. Each document is a column, so there must be few."""
    documents = documents or sorted(str(r[0]) for r in sections.select(document).where(F.col(document).isNotNull()).distinct().collect())
    cells = sections.groupBy(field).pivot(document, documents).agg(F.array_join(F.sort_array(F.collect_list(F.col(number).cast("string"))), ","))
    counted = sections.groupBy(field).agg(F.count_distinct(document).alias("n_documents"))
    return cells.na.fill("", documents).join(counted, field)


def missing_fields(sections: DataFrame, document: str, field: str) -> DataFrame:
    """(document, field) that no section is of."""
    return sections.select(document).distinct().crossJoin(T.if_small(sections.select(field).distinct())).join(sections.select(document, field), [document, field], "left_anti")


def page_range(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when(last.isNull() | (first == last), first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def suggested_families(labels: DataFrame, label: str, patterns: list[tuple[str, str]], suffixes: str, prefix: str) -> DataFrame:
    """label with the first pattern's family, and whether it has a session's suffix or prefix."""
    low = F.lower(F.trim(F.col(label)))
    return labels.select(label, first_match(low, patterns, "?").alias("family"), low.rlike(suffixes).alias("has_suffix"), low.startswith(prefix).alias("has_prefix"))


def last_turns(turns: DataFrame, conversation: str, turn: str, n: int) -> DataFrame:
    w = Window.partitionBy(conversation).orderBy(F.desc(turn))
    return turns.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


def history(turns: DataFrame, excerpts: DataFrame, conversation: str, turn: str, n: int = DEFAULTS.history) -> DataFrame:
    """The last n turns of each conversation that were not refused, with what a later turn may see of them: (conversation, turn, back, author, content).

    turns: (conversation, turn, answer, refused, classified, verified, degraded, reason). A verified answer stands as it
    is. One that was not verified, or degraded, gives way to the first two of its excerpts (conversation, turn, rank,
    reference, text), or without any to its reason; a classification's text stands, though the author is the system
    unless it was verified.
    """
    kept = last_turns(turns.where(~F.coalesce("refused", F.lit(False))), conversation, turn, n)
    source = excerpts.where(F.col("rank") <= 2).groupBy(conversation, turn).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.concat(F.lit("["), "reference", F.lit("] "), F.trim("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("__source"))
    good = F.coalesce(F.col("verified") & ~F.col("degraded"), F.lit(False))
    content = F.when(good | F.coalesce("classified", F.lit(False)), F.col("answer")).otherwise(F.coalesce("__source", "reason", F.lit("(nothing verified in this turn)")))
    return kept.join(source, [conversation, turn], "left").select(conversation, turn, "back", F.when(good, "assistant").otherwise("system").alias("author"), content.alias("content"))


def drawn_entity(df: DataFrame, entity: str, order: tuple[str, ...], least: int, first: int, seed: int = DEFAULTS.seed) -> DataFrame:
    """The first rows of one entity with `least` rows or more, drawn by the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(entity).cast("string")))
    one = df.groupBy(entity).agg(F.count("*").alias("__n")).where(F.col("__n") >= least).orderBy(digest).limit(1)
    return df.join(F.broadcast(one.select(entity)), entity).orderBy(*order).limit(first)  # one row


def first_of(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """One row for each value of `by`, null among them: the first in the order. Only that row of each task is shuffled."""
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("__row")
    return df.groupBy(*by).agg(whole).select("__row.*")


def prepared(events: DataFrame, catalogue: Catalogue, label: str = DEFAULTS.label, problems_only: bool = False) -> DataFrame:
    """Readings numbered by event with their family; labels that no family has go, and with problems_only those of states."""
    aliases = catalogue.aliases.select(F.col("label").alias(label), "family").join(F.broadcast(catalogue.families.select("family", "is_problem")), "family")
    out = events.join(F.broadcast(aliases), label)
    return (out.where("is_problem") if problems_only else out).drop("is_problem")
