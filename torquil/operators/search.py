"""Sections of documents: cutting, term weights, exact-filter-then-similarity search, votes and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from torquil import functions as X
from torquil.config import DEFAULTS, FIELD_PATTERNS
from torquil.sources import shared as T

#: Numbers of any size and depth with a title of any length; no group repeats, as Java's stack grows with those.
_HEADING = r"^(\d[\d.]*+)\s++(\S.*+)$"
_WORD = r"[\p{L}\p{N}_]{2,}"
#: Characters of texts for each piece of their terms, and words that a task counts at once.
SHARE, WORDS = 2_500_000, 1 << 19


def sections(docs: DataFrame, id: str, text: str, pages: str | None = None, fields: tuple[tuple[str, str], ...] = FIELD_PATTERNS) -> DataFrame:
    """(id, number, title, level, field, first_page, last_page, first_line, body): numbered sections of each text.

    field is the first whose pattern the title has, without accents. pages names a column with the page of each line:
    a section begins on its heading's page and ends on that of its last line that isn't blank and has one.

    A line with a number is a heading only if its title does not end a sentence and its number is the next top one
    or lies under the open top one; the fold over a document's lines is an aggregate over its candidates.
    """
    paged = F.col(pages).cast("array<int>") if pages else F.lit(None).cast("array<int>")
    lines = docs.select(id, paged.alias("__pages"), F.posexplode(F.split(text, "\n")).alias("line", "s"))
    lines = lines.select(id, "line", "s", F.get("__pages", F.col("line")).alias("page"))
    bare = F.btrim("s", F.lit(" \t\r\f\v"))
    cut = lines.select(id, "line", F.regexp_replace(F.regexp_extract(bare, _HEADING, 1), r"\.$", "").alias("number"), F.regexp_extract(bare, _HEADING, 2).alias("title"))
    candidate = (F.col("number") != "") & ~F.col("number").contains("..") & ~F.col("number").endswith(".") & ~F.col("title").rlike(r"[.;:]$")
    listed = cut.where(candidate).groupBy(id).agg(F.sort_array(F.collect_list(F.struct("line", "number", "title"))).alias("c"))
    top = lambda x: F.split_part(x["number"], F.lit("."), F.lit(1)).try_cast("long")
    start = F.struct(F.lit(0).cast("long").alias("open"), F.expr("cast(array() as array<struct<line:int,number:string,title:string>>)").alias("kept"))

    def step(state: Column, x: Column) -> Column:
        single = ~x["number"].contains(".")
        ok = F.when(single, top(x) == state["open"] + 1).otherwise((state["open"] > 0) & (top(x) == state["open"]))
        return F.struct(F.when(ok & single, top(x)).otherwise(state["open"]).alias("open"), F.when(ok, F.concat(state["kept"], F.array(x))).otherwise(state["kept"]).alias("kept"))

    heads = listed.select(id, F.explode(F.aggregate("c", start, step, lambda s: s["kept"])).alias("h")).select(id, "h.*")
    marked = lines.join(heads, [id, "line"], "left")
    w = Window.partitionBy(id).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    owned = marked.withColumn("head", F.last(F.when(F.col("number").isNotNull(), F.struct("line", "number", "title", "page")), ignorenulls=True).over(w)).where("head is not null")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("number").isNull(), F.struct("line", "s")))), lambda x: x["s"]), "\n")
    written = F.col("number").isNull() & (F.btrim("s", F.lit(" \t\r\f\v")) != "") & F.col("page").isNotNull()
    out = owned.groupBy(id, "head").agg(body.alias("body"), F.max_by("page", F.when(written, F.col("line"))).alias("last_page"))
    field = X.first_match(F.lower(X.folded(F.col("head.title"))), [(p, name) for name, p in fields]) if fields else F.lit(None).cast("string")
    level = F.size(F.split("head.number", r"\."))
    return out.select(id, "head.number", "head.title", level.alias("level"), field.alias("field"), F.col("head.page").alias("first_page"), F.coalesce("last_page", "head.page").alias("last_page"), F.col("head.line").alias("first_line"), reflowed(F.col("body")).alias("body"))


def sections_of_fields(sections: DataFrame, allowed: DataFrame, fields: tuple[str, ...], document: str = "document", field: str = "field") -> DataFrame:
    """Every section of the fields in the allowed documents (document): an exact filter without a score."""
    return sections.where(F.col(field).isin(*fields)).join(allowed.select(document).distinct(), document, "left_semi")


def reflowed(body: Column) -> Column:
    """Bullets as dashes, wrapped lines joined, runs of blank lines as one."""
    x = F.regexp_replace(body, r"(?m)^[ \t]*[•▪‣*–][ \t]+", "- ")
    x = F.regexp_replace(x, r"[ \t]+\n", "\n")
    x = F.regexp_replace(x, r"(?<=[^\n])\n(?=[^\n\-])", " ")
    return F.trim(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def terms(docs: DataFrame, id: str, text: str) -> DataFrame:
    """(id, term, n): lower-case words of two characters or more and their pairs."""
    w = F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0)
    ws = docs.select(id, w.alias("w"))
    both = F.concat("w", F.when(F.size("w") > 1, F.zip_with(F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>")))
    return ws.select(id, F.explode(both).alias("term")).groupBy(id, "term").agg(F.count("*").alias("n"))


def tfidf(docs: DataFrame, id: str, text: str, most: float = 0.9) -> DataFrame:
    """(id, term, weight): (1 + ln n) * (ln((1 + N) / (1 + df)) + 1), terms of more than `most` of the texts left out, rows of unit length."""
    n = docs.agg(F.count("*").alias("__all"))
    t = terms(docs, id, text)
    df = t.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") <= most * F.col("__all"))
    w = t.join(df, "term").withColumn("w", (1 + F.log("n")) * (F.log((1 + F.col("__all")) / (1 + F.col("df"))) + 1))
    norm = w.groupBy(id).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, id).select(id, "term", (F.col("w") / F.col("norm")).alias("weight"))


def term_totals(docs: DataFrame, id: str, text: str, most: float = 0.9) -> DataFrame:
    """(id, terms, heaviest, total): how many weights tfidf gives each text, their largest one and their sum.

    Terms are named by 64-bit hashes. What tasks count of some texts is dealt into pieces by term, in rows of arrays, so no
    term is a row of its own; a piece knows each of its terms' texts, and gives each text's part of the sums, which are added
    up by text. There are as many pieces as make one of SHARE characters. id is a whole number. Rows that share an
    id are one text; those without one count as a text in df, as in tfidf, and have no row here.
    """
    import numpy as np
    import pyarrow as pa

    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    known = docs.agg(F.count("*").alias("n"), F.sum(F.length(text).cast("long")).alias("chars")).first()
    n, pieces = known.n, 1 + (known.chars or 0) // SHARE
    hashed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(_WORD), 0), lambda x: F.xxhash64(x))
    words = docs.select(F.coalesce(F.col(id).cast("long"), F.lit(0)).alias("id"), F.col(id).isNull().alias("none"), F.coalesce(hashed, F.array().cast("array<long>")).alias("w"))

    def dealt(batches):
        for batch in batches:
            sizes = np.diff(batch.column("w").offsets.to_numpy())
            flat, ids, at = batch.column("w").flatten().to_numpy(), batch.column("id").to_numpy(), 0
            none = batch.column("none").to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            while at < len(ids):  # texts of WORDS words or so
                start = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, start + WORDS, side="right")))
                row, h = np.repeat(np.arange(at, to), sizes[at:to]), flat[start : ends[to - 1]].view(np.uint64)
                next_to = row[1:] == row[:-1]
                row, h = np.concatenate([row, row[1:][next_to]]), np.concatenate([h, _pair(h[:-1][next_to], h[1:][next_to])])
                at = to
                if not len(h):
                    continue
                by = np.lexsort((h, row, none[row], h % np.uint64(pieces)))
                row, h = row[by], h[by]
                first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])]))
                times = np.diff(np.append(first, len(h))).astype(np.int32)
                row, h = row[first], h[first]
                piece = (h % np.uint64(pieces)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate([[True], (piece[1:] != piece[:-1]) | (none[row[1:]] != none[row[:-1]])]))
                offsets = pa.array(np.append(cut, len(h)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(piece[cut]), pa.array(none[row[cut]]), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (h.view(np.int64), ids[row], times)]], ["piece", "none", "h", "id", "n"])

    def summed(x, by):
        order = np.argsort(x, kind="stable")
        x = x[order]
        first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]]))
        return x[first], [f.reduceat(y[order], first) for f, y in by]

    def weighed(table):
        h, ids, times = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("h", "id", "n"))
        none = np.repeat(table.column("none").to_numpy(), np.diff(table.column("h").combine_chunks().offsets.to_numpy()))
        by = np.lexsort((ids, none, h))
        h, ids, none, times = h[by], ids[by], none[by], times[by]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
        h, ids, none, times = h[first], ids[first], none[first], np.add.reduceat(times, first)
        term = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        df = np.diff(np.append(term, len(h)))
        df = np.repeat(df, df)
        kept = (df <= most * n) & ~none
        w = (1 + np.log(times[kept])) * (np.log((1 + n) / (1 + df[kept])) + 1)
        if not len(w):
            return pa.table({"bucket": pa.array([], pa.int64()), **{c: pa.array([], pa.list_(t)) for c, t in (("id", pa.int64()), ("k", pa.int64()), ("top", pa.float64()), ("s", pa.float64()), ("q", pa.float64()))}})
        ids, sums = summed(ids[kept], [(np.add, np.ones(len(w), np.int64)), (np.maximum, w), (np.add, w), (np.add, w * w)])
        bucket = ids % pieces
        order = np.argsort(bucket, kind="stable")
        names, cut = np.unique(bucket[order], return_index=True)
        offsets = pa.array(np.append(cut, len(ids)).astype(np.int32))
        return pa.table([pa.array(names), *[pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (ids, *sums)]], ["bucket", "id", "k", "top", "s", "q"])

    def added(table):
        ids, k, top, s, q = (table.column(c).combine_chunks().flatten().to_numpy() for c in ("id", "k", "top", "s", "q"))
        ids, (k, top, s, q) = summed(ids, [(np.add, k), (np.maximum, top), (np.add, s), (np.add, q)])
        return pa.table([pa.array(ids), pa.array(k), pa.array(top / np.sqrt(q)), pa.array(s / np.sqrt(q))], ["id", "terms", "heaviest", "total"])

    parts = words.mapInArrow(dealt, "piece long, none boolean, h array<long>, id array<long>, n array<int>")
    sums = parts.groupBy("piece").applyInArrow(weighed, "bucket long, id array<long>, k array<long>, top array<double>, s array<double>, q array<double>")
    out = sums.groupBy("bucket").applyInArrow(added, "id long, terms long, heaviest double, total double")
    return out.select(F.col("id").cast(dict(docs.dtypes)[id]).alias(id), "terms", "heaviest", "total")


def _pair(a, b):
    """64-bit hashes of two words in a row, from theirs."""
    import numpy as np

    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def top_k(scored: DataFrame, query: str, id: str, k: int, score: str = "score") -> DataFrame:
    """The k best of each query with rank; ties by id."""
    w = Window.partitionBy(query).orderBy(F.desc(score), id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def filtered_scores(queries: DataFrame, allowed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every allowed pair with its score: queries (query, family, field, model, qvec), allowed (family, document), chunks (chunk, document, field, model, vec).

    The exact join on documents comes first, so only allowed pairs are scored. A field that the allowed documents
    lack falls back to all of them; vectors of other models are not compared.
    """
    c = chunks.select("chunk", "document", F.col("field").alias("cfield"), F.col("model").alias("cmodel"), "vec")
    wanted = queries.join(allowed, "family")
    # which fields the allowed documents have is found out from a table of a row for each document, model and field
    fields = c.groupBy("document", "cmodel").agg(F.collect_set("cfield").alias("cfields"), F.bool_or(F.col("cfield").isNull()).alias("untyped"))
    typed = F.max(F.coalesce(F.array_contains("cfields", F.col("field")), F.lit(True)) | F.col("untyped"))
    any_typed = wanted.select("query", "document", "field", "model").join(fields, "document").where("model = cmodel").groupBy("query").agg(typed.alias("any_typed"))
    pairs = wanted.join(any_typed, "query").join(c, "document").where("model = cmodel")
    pairs = pairs.where(F.coalesce(F.col("field") == F.col("cfield"), F.lit(True)) | ~F.col("any_typed"))
    return pairs.withColumn("score", X.cosine("qvec", "vec")).drop("qvec", "vec")


def filtered_search(queries: DataFrame, allowed: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """The k best of each query among filtered_scores."""
    return top_k(filtered_scores(queries, allowed, chunks), "query", "chunk", k)


def best_of_documents(scored: DataFrame, query: str = "query") -> DataFrame:
    """(query, document, chunk, score): the best chunk of each document, the smaller one of equals."""
    best = F.max_by("chunk", F.struct("score", -F.col("chunk")))
    return scored.groupBy(query, "document").agg(best.alias("chunk"), F.max("score").alias("score"))


def empty_reasons(queries: DataFrame, allowed: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, reason): no_document, no_section, other_model or found."""
    docs = allowed.groupBy("family").agg(F.count("*").alias("docs"))
    per = allowed.join(chunks.groupBy("document", "model").agg(F.count("*").alias("n")), "document").groupBy("family", F.col("model").alias("cmodel")).agg(F.sum("n").alias("n"))
    out = queries.join(docs, "family", "left").join(per, "family", "left")
    return out.groupBy("query").agg(F.max("docs").alias("d"), F.max("n").alias("n"), F.max(F.col("cmodel") == F.col("model")).alias("m")).select("query", F.when(F.col("d").isNull(), "no_document").when(F.col("n").isNull(), "no_section").when(~F.coalesce("m", F.lit(False)), "other_model").otherwise("found").alias("reason"))


def _packed(df: DataFrame, columns: tuple[str, ...], vector: str, rows: int = 1000) -> DataFrame:
    """df as rows of many, written: arrays of the columns, and vectors of one length as one block. Rows whose vector is null or empty or holds a null or a number that isn't finite are left out."""
    import numpy as np
    import pandas as pd

    def pack(batches):
        for b in batches:
            sizes = np.array([0 if v is None else len(v) for v in b[vector]])
            for size in np.unique(sizes[sizes > 0]):
                some = b[sizes == size]
                block = np.stack([np.array(v, float) for v in some[vector]])
                good = np.isfinite(block).all(1)
                some, block = some[good], block[good]
                for at in range(0, len(some), rows):
                    part = some.iloc[at : at + rows]
                    yield pd.DataFrame({**{c: [part[c].to_numpy()] for c in columns}, vector: [block[at : at + rows].tobytes()]})

    kinds = dict(df.dtypes)
    return T.written(df.select(*columns, vector).mapInPandas(pack, ", ".join(f"{c} array<{kinds[c]}>" for c in columns) + f", {vector} binary"), "packed")


def _best(scores, x, y, ids, k: int):
    """Positions (row of x, row of y) and cosine of each row's k best by (cosine descending, id), exactly.

    scores, a matrix product, only rules out what can't be among them: its last digits depend on the place in the
    matrix. What is left is scored pair by pair, so that equal vectors have equal cosines wherever they stand.
    """
    import numpy as np

    scores = np.where(np.isnan(scores), np.inf, scores)
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    i, j = np.nonzero(scores >= least[:, None] - 1e-9)
    xx, yy = (x * x).sum(1), (y * y).sum(1)
    with np.errstate(invalid="ignore", divide="ignore"):
        exact = np.concatenate([(x[i[a : a + 20_000]] * y[j[a : a + 20_000]]).sum(1) for a in range(0, len(i), 20_000)]) / np.sqrt(xx[i] * yy[j])
    by = np.lexsort((np.unique(ids, return_inverse=True)[1][j], -np.where(np.isnan(exact), np.inf, exact), i))
    i, j, exact = i[by], j[by], exact[by]
    first = np.searchsorted(i, i)
    kept = np.arange(len(i)) - first < k
    return i[kept], j[kept], exact[kept]


def free_search(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """All queries against all chunks: both are packed into blocks once, and each pair of blocks is a matrix product of which only each query's k best go on.

    Queries and chunks without a vector of finite numbers have no hits and are none; vectors of different lengths are not compared.
    """
    import numpy as np
    import pandas as pd

    def block(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                x, y = np.frombuffer(r.qvec).reshape(len(r.query), -1), np.frombuffer(r.vec).reshape(len(r.chunk), -1)
                if x.shape[1] != y.shape[1]:
                    continue
                with np.errstate(invalid="ignore", divide="ignore"):
                    s = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
                i, j, score = _best(s, x, y, r.chunk, k)
                yield pd.DataFrame({"query": r.query[i], "chunk": r.chunk[j], "document": r.document[j], "score": score})

    kinds = dict(chunks.dtypes)
    pairs = _packed(queries, ("query",), "qvec").crossJoin(_packed(chunks, ("chunk", "document"), "vec"))
    scored = pairs.mapInPandas(block, f"query {dict(queries.dtypes)['query']}, chunk {kinds['chunk']}, document {kinds['document']}, score double")
    return top_k(scored, "query", "chunk", k)


def multi_query_search(queries: DataFrame, chunks: DataFrame, k: int, session: str = "session") -> DataFrame:
    """(session, chunk, document, score, rank) for queries (session, query, qvec): a chunk's best score among the session's queries.

    A chunk that is among a session's k best is among the k best of the query that gives it its score, so only each
    query's k best of each block are shuffled.
    """
    hits = free_search(queries, chunks, k).drop("rank").join(queries.select("query", session), "query")
    best = hits.groupBy(session, "chunk").agg(F.max("score").alias("score"), F.first("document").alias("document"))
    return top_k(best, session, "chunk", k)


def balanced(sections: DataFrame, by: str, field: str, id: str, k: int, fields: int) -> DataFrame:
    """k sections of each `by` with rank: k // fields (one at least) of each field, in the order of fields and ids."""
    some = sections.withColumn("__i", F.row_number().over(Window.partitionBy(by, field).orderBy(id))).where(F.col("__i") <= max(1, k // fields)).drop("__i")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(field, id))).where(F.col("rank") <= k)


def scope(hits: DataFrame, least: float = DEFAULTS.scope_score, query: str = "query") -> DataFrame:
    """(query, best, in_scope): whether a query's best score reaches the least one."""
    return hits.groupBy(query).agg(F.max("score").alias("best"), (F.max("score") >= least).alias("in_scope"))


def scope_of_document(queries: DataFrame, chunks: DataFrame, least: float = DEFAULTS.scope_score) -> DataFrame:
    """(query, document, best, in_scope) of queries (query, document, model, qvec), each held against all sections of its one document; without any to compare it is out of scope, with 0."""
    asked = queries.withColumnRenamed("document", "family").withColumn("field", F.lit(None).cast("string"))
    own = queries.select(F.col("document").alias("family"), "document").distinct()
    best = scope(filtered_scores(asked, own, chunks.withColumn("field", F.lit(None).cast("string"))), least)
    return queries.select("query", "document").join(best, "query", "left").select("query", "document", F.coalesce("best", F.lit(0.0)).alias("best"), F.coalesce("in_scope", F.lit(False)).alias("in_scope"))


def symptom_scores(symptoms: DataFrame, chunks: DataFrame, k: int, known: DataFrame | None = None, case: str = "case") -> DataFrame:
    """(case, chunk, document, score): best scores of the cases' symptoms (case, query, qvec), added to those known before.

    A section that is among a case's k best is among the k best of the symptom that gives it its score, so only those
    are kept, and a symptom added later is scored alone and comes in by the maximum.
    """
    new = free_search(symptoms, chunks, k).join(symptoms.select("query", case), "query").select(case, "chunk", "document", "score")
    both = new if known is None else known.select(case, "chunk", "document", "score").unionByName(new)
    return both.groupBy(case, "chunk").agg(F.first("document").alias("document"), F.max("score").alias("score"))


def triage(scores: DataFrame, k: int, least: float = DEFAULTS.least_score, case: str = "case") -> DataFrame:
    """(case, best, outcome, document) of symptom_scores: `no_procedure` without a section of the least score, `fixed` if one document decides, else `choose`."""
    hits = top_k(scores, case, "chunk", k)
    enough = hits.groupBy(case).agg(F.max("score").alias("best"), (F.max("score") >= least).alias("__passed"))
    votes = decided(document_votes(hits, case), case).select(case, "document", "decision")
    outcome = F.when(~F.col("__passed"), "no_procedure").otherwise(F.when(F.col("decision") == "fixed", "fixed").otherwise("choose"))
    out = enough.join(votes, case).withColumn("outcome", outcome)
    return out.select(case, "best", "outcome", F.when(F.col("outcome") == "fixed", F.col("document")).alias("document"))


def raw_answers(hits: DataFrame, sections: DataFrame, query: str = "query") -> DataFrame:
    """(query, raw) of hits (query, chunk, rank, score): the sections (chunk, document, number, title, pages, body) found, each under its address, in the order of their ranks."""
    page = F.when(F.col("pages") != "", F.concat(F.lit(", p. "), "pages")).otherwise("")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("document").cast("string"), F.lit(", section "), F.col("number").cast("string"), F.coalesce(page, F.lit("")), F.lit(" - "), F.coalesce("title", F.lit("")), F.lit("\n"), F.btrim(F.coalesce("body", F.lit(""))))
    found = hits.select(query, "chunk", "rank").join(sections.select("chunk", "document", "number", "title", "pages", "body"), "chunk")
    return joined_sections(found.withColumn("__text", head), "__text", query, "\n\n")


def joined_sections(hits: DataFrame, body: str, query: str = "query", between: str = " ") -> DataFrame:
    """(query, raw): the sections of a query's k hits in their order, as one text."""
    return hits.groupBy(query).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.col(body).cast("string").alias("body")))), lambda x: x["body"]), between).alias("raw"))


def document_votes(hits: DataFrame, query: str = "query") -> DataFrame:
    """(query, document, weight, rank): sums of scores above 0."""
    votes = hits.groupBy(query, "document").agg(F.sum(F.greatest("score", F.lit(0.0))).alias("weight"))
    return votes.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("weight"), "document")))


def decided(votes: DataFrame, query: str = "query", margin: float = DEFAULTS.margin, share: float = DEFAULTS.share) -> DataFrame:
    """(query, document, margin, share, decision): fixed if one document leads by the margin and has the share, or stands alone; choose; none without weight."""
    total = votes.groupBy(query).agg(F.max("weight").alias("p1"), F.max(F.when(F.col("rank") == 2, F.col("weight"))).alias("p2"), F.sum("weight").alias("all"), F.min_by("document", "rank").alias("document"))
    m, s = F.try_divide(F.col("p1") - F.col("p2"), F.col("p1")), F.try_divide(F.col("p1"), F.col("all"))
    decision = F.when(F.col("p1") <= 0, "none").when(F.col("p2").isNull() | ((m >= margin) & (s >= share)), "fixed").otherwise("choose")
    return total.select(query, "document", m.alias("margin"), s.alias("share"), decision.alias("decision"))
