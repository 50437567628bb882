"""Batch retrieval, retrieval evaluation, citations and appeal packets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from claimloom.functions import rules
from claimloom.functions.numbers import half_up
from claimloom.functions.text import chunk_documents, gram_hashes, slot_matrix, token_slots
from claimloom.storage import materialize, small_side

TOP_K = 5
# Queries of a block and vectors of a split, on average: each block meets each split in a group
# of its own, so these bound what a task holds. Vectors scored at a time.
QUERY_BLOCK, SPLIT_ROWS, SCORE_ROWS = 2048, 8192, 1024
# Characters of a keyword's grams; of long keywords only grams with one hash in so many are indexed.
GRAM_CHARS, GRAM_SAMPLE = 8, 8

# Title keyword that marks the expected policy document of a denial reason.
REASON_DOCUMENT_KEYWORDS = {
    "MISSING_AUTHORIZATION": "Prior Authorization",
    "TIMELY_FILING": "Timely Filing",
    "MISSING_DOCUMENTATION": "Documentation Standards",
    "CODING_MISMATCH": "Coding and Modifier",
    "ELIGIBILITY_ISSUE": "Eligibility Verification",
}


def with_slots(chunks: DataFrame, text: str = "chunk_text") -> DataFrame:
    return chunks.withColumn("slots", token_slots(F.col(text)))


def _best(scores: np.ndarray, first: np.ndarray, second: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores; ties go to the smaller (first, second) key."""
    if len(scores) > k:
        bound = np.partition(scores, len(scores) - k)[len(scores) - k]
        candidates = np.flatnonzero(scores >= bound)
    else:
        candidates = np.arange(len(scores))
    order = np.lexsort((second[candidates], first[candidates], -scores[candidates]))
    return candidates[order[:k]]


def _numbered(queries: DataFrame) -> DataFrame:
    """The queries with a number each, stored, so that repeated ids stay apart."""
    return materialize(queries.withColumn("_n", F.monotonically_increasing_id()), "queries")


def _comparable(values: pd.Series) -> np.ndarray:
    """Ids as an array that sorts and compares: whole numbers, else text."""
    return values.to_numpy("int64") if pd.api.types.is_integer_dtype(values.dtype) else values.astype(str).to_numpy("U")


def _matrix(column: pa.ChunkedArray, dense: bool) -> np.ndarray:
    rows = column.to_pylist()
    return np.array(rows, dtype="float64") if dense else slot_matrix(rows)


def _local_top(vectors: pa.Table, queries: pa.Table, payload: str, k: int) -> list[tuple]:
    """(number, document ids, chunk indexes, scores) of the best k vectors for each query of a group."""
    numbers, q = queries.column("_n").to_pylist(), _matrix(queries.column(payload), payload == "vector")
    qn = (q * q).sum(axis=1)
    scope = queries.column("payer_id").to_pandas() if "payer_id" in queries.column_names else None
    kept: list = [None] * len(numbers)
    bound = np.full(len(numbers), -np.inf)
    for at in range(0, vectors.num_rows, SCORE_ROWS):
        part = vectors.slice(at, SCORE_ROWS)
        m = _matrix(part.column(payload), payload == "vector")
        product = np.sqrt(np.outer(qn, (m * m).sum(axis=1)))
        product[product == 0] = 1.0
        cos = (q @ m.T) / product
        if scope is not None:
            # codes of payers, -1 for none: any type of id compares exactly
            payers = part.column("payer_id").to_pandas()
            codes = pd.factorize(pd.concat([scope.astype(object), payers.astype(object)], ignore_index=True))[0]
            wanted, payer = codes[: len(scope)], codes[len(scope) :]
            cos[(payer[None, :] >= 0) & (wanted[:, None] >= 0) & (payer[None, :] != wanted[:, None])] = -np.inf
        a, b = _comparable(part.column("document_id").to_pandas()), part.column("chunk_index").to_numpy()
        # Only queries that these vectors can improve (or tie) are looked at.
        for i in np.flatnonzero(cos.max(axis=1) >= bound):
            pick = np.flatnonzero((cos[i] >= bound[i]) & (cos[i] > -np.inf))
            found = (cos[i][pick], a[pick], b[pick])
            s, da, db = found if kept[i] is None else (np.concatenate(x) for x in zip(kept[i], found))
            best = _best(s, da, db, k)
            kept[i] = (s[best], da[best], db[best])
            if len(best) == k:
                bound[i] = kept[i][0][-1]
    return [(number, *found[1:], found[0]) for number, found in zip(numbers, kept) if found is not None and len(found[0])]


def _top(vectors: DataFrame, queries: DataFrame, payload: str, k: int) -> DataFrame:
    """_n, document_id, chunk_index, score, rank: the k best vectors of each query (_n, payload and, if any, payer_id).

    Blocks of queries meet splits of the vectors by a shuffle on (split, block); a group holds one of each and emits k rows
    per query at most, which are ranked after a partial limit. Two row counts reach the driver, no row does.
    """
    splits = max(1, -(-vectors.count() // SPLIT_ROWS))
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = vectors.withColumn("chunk_index", F.col("chunk_index").cast("bigint")).withColumn(
        "_split", F.pmod(F.xxhash64("document_id", "chunk_index"), F.lit(splits)).cast("int")
    ).withColumn("_block", spread(blocks))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)).cast("int")).withColumn("_split", spread(splits))
    names = ["_n", "document_id", "chunk_index", "score"]

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("_n", pa.int64()), ("document_id", rows.schema.field("document_id").type), ("chunk_index", pa.int64()), ("score", pa.float64())])
        found = _local_top(rows, asked, payload, k) if rows.num_rows and asked.num_rows else []
        if not found:
            return schema.empty_table()
        number = np.repeat([f[0] for f in found], [len(f[3]) for f in found])
        columns = [number, *(np.concatenate([f[c] for f in found]) for c in (1, 2, 3))]
        return pa.Table.from_arrays([pa.array(c).cast(kind) for c, kind in zip(columns, schema.types)], names=names)

    kind = vectors.schema["document_id"].dataType.simpleString()
    met = left.groupBy("_split", "_block").cogroup(right.groupBy("_split", "_block"))
    local = met.applyInArrow(score, f"_n bigint, document_id {kind}, chunk_index bigint, score double")
    order = Window.partitionBy("_n").orderBy(F.col("score").desc(), "document_id", "chunk_index")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def retrieve(chunks: DataFrame, queries: DataFrame, k: int = TOP_K, scoped: bool = True) -> DataFrame:
    """Top-k chunks per query by cosine of hashed word counts.

    `chunks` needs document_id, chunk_index, slots (null slots are skipped) and, when
    scoped, payer_id. `queries` needs query_id, text and, when scoped, payer_id: a query
    sees documents of its payer and global ones. Queries with the same text and payer are
    scored once. The dot products are of whole numbers, so equal texts tie exactly.
    """
    scope = ["payer_id"] if scoped else []
    vectors = chunks.filter(F.col("slots").isNotNull()).select("document_id", "chunk_index", "slots", *scope)
    asked = _numbered(queries.select("query_id", "text", *scope))
    once = asked.groupBy("text", *scope).agg(F.min("_n").alias("_n"))
    found = _top(vectors, once.select("_n", token_slots(F.col("text")).alias("slots"), *scope), "slots", k)
    same = reduce(lambda x, y: x & y, [F.col(f"o.{c}").eqNullSafe(F.col(f"a.{c}")) for c in ("text", *scope)])
    shared = asked.alias("a").join(once.alias("o"), same).select("a.query_id", "o._n")
    return shared.join(found, "_n").select("query_id", "document_id", "chunk_index", "score", "rank")


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top-k rows of a dense vector table per query vector; same plan as `retrieve`.

    `vectors`: id, vector. `queries`: query_id, vector.
    """
    keyed = vectors.select(F.col("id").alias("document_id"), F.lit(0).alias("chunk_index"), "vector")
    asked = _numbered(queries.select("query_id", "vector"))
    found = _top(keyed, asked.select("_n", "vector"), "vector", k)
    return asked.join(found, "_n").select("query_id", F.col("document_id").alias("id"), "score", "rank")


def group_centroids(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean vector per key, from an aggregate per (key, position)."""
    long = vectors.select(F.col(key).alias("query_id"), F.posexplode(vector))
    means = long.groupBy("query_id", "pos").agg(
        (F.sum(F.col("col").cast("decimal(20,10)")).cast("double") / F.count("col")).alias("m")
    )
    ordered = F.array_sort(F.collect_list(F.struct("pos", "m")))
    return means.groupBy("query_id").agg(F.transform(ordered, lambda s: s["m"]).alias("vector"))


def _gram_rows(rows: DataFrame, key: str, text: str, chars: int, sample: int) -> DataFrame:
    """(key, gram): hashes of the different runs of `chars` characters of each text, one in `sample`."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                grams = gram_hashes(batch.column(1)[at].as_py(), chars, sample)
                owner = batch.column(0).take(pa.array(np.zeros(len(grams), np.int64) + at))
                yield pa.RecordBatch.from_arrays([owner, pa.array(grams)], names=[key, "gram"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.filter(F.col(text).isNotNull()).select(key, text).mapInArrow(run, f"{key} {kind}, gram bigint")


def first_document_with(documents: DataFrame, keywords: DataFrame, text: str) -> DataFrame:
    """Per keyword: smallest document id whose `text` contains it, ignoring case.

    `keywords` has query_id and text. A keyword is looked up by its rarest gram of GRAM_CHARS characters (its whole length, if
    it is shorter) in an index of the documents' grams that any keyword has, and `contains` verifies what it meets. Keywords
    without a document are left out; an empty one is in every text.
    """
    asked = _numbered(keywords.select("query_id", F.lower("text").alias("word")).filter(F.col("word").isNotNull()))
    words = materialize(asked.groupBy("word").agg(F.min("_n").alias("_w")), "words").withColumn("chars", F.least(F.length("word"), F.lit(GRAM_CHARS)))
    bodies = documents.select("document_id", F.lower(F.col(text)).alias("body")).filter(F.col("body").isNotNull())
    met = [bodies.limit(0).select("document_id", F.lit(0).cast("bigint").alias("_w"))]
    if empty := words.filter("chars = 0").first():
        met.append(bodies.agg(F.min("document_id").alias("document_id")).withColumn("_w", F.lit(empty["_w"])))
    for chars in range(1, GRAM_CHARS + 1):
        some = words.filter(F.col("chars") == chars)
        if some.isEmpty():
            continue
        # a sample of the grams will do for words that have one in it
        few = _gram_rows(some, "_w", "word", chars, GRAM_SAMPLE)
        rest = some.join(few.select("_w").distinct(), "_w", "left_anti")
        for grams, sample in ((few, GRAM_SAMPLE), (_gram_rows(rest, "_w", "word", chars, 1), 1)):
            grams = materialize(grams, "grams")
            if not grams.isEmpty():
                held = _gram_rows(bodies, "document_id", "body", chars, sample).join(grams.select("gram").distinct(), "gram", "left_semi")
                held = materialize(held, "held")
                counts = held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
                rated = grams.join(counts, "gram", "left").groupBy("_w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("g"))
                rarest = rated.filter("g.n > 0").select("_w", "g.gram").join(words, "_w")
                pairs = held.join(rarest, "gram").select("document_id", "_w", "word")
                met.append(pairs.join(bodies, "document_id").filter(F.contains("body", "word")).select("document_id", "_w"))
    found = reduce(DataFrame.unionByName, met).groupBy("_w").agg(F.min("document_id").alias("expected_document_id"))
    named = asked.join(words.select("word", "_w"), "word").select("query_id", "_w")
    return named.join(found.filter(F.col("expected_document_id").isNotNull()), "_w").select("query_id", "expected_document_id")


def reason_documents(documents: DataFrame) -> DataFrame:
    """Expected policy document per denial reason (query_id is the reason), by title keyword."""
    rows = list(REASON_DOCUMENT_KEYWORDS.items())
    keywords = documents.sparkSession.createDataFrame(rows, "query_id string, text string")
    return first_document_with(documents, keywords, "title")


def reason_queries(reasons: DataFrame) -> DataFrame:
    """The retrieval query of each reason in `reasons` (query_id)."""
    return reasons.select("query_id", F.concat(F.col("query_id"), F.lit(" appeal policy")).alias("text"))


def hit_ranks(results: DataFrame, expected: DataFrame, k_values: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Rank of the expected document per query, and hit flags; queries without one are left out."""
    matched = expected.join(results, "query_id", "left")
    hit = F.col("document_id") == F.col("expected_document_id")
    ranked = matched.groupBy("query_id", "expected_document_id").agg(
        F.min(F.when(hit, F.col("rank"))).cast("bigint").alias("rank_of_correct_document")
    )
    rank = F.col("rank_of_correct_document")
    return ranked.select("*", *[F.coalesce(rank <= k, F.lit(False)).alias(f"hit_at_{k}") for k in k_values])


def recall_at_k(ranks: DataFrame, k_values: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return ranks.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[half_up(F.avg(F.col(f"hit_at_{k}").cast("int")), 4).alias(f"recall_at_{k}") for k in k_values],
    )


def policy_queries(denied: DataFrame) -> DataFrame:
    """Distinct (reason, payer) retrieval queries of a set of denied claims."""
    pairs = denied.select("denial_reason_code", "payer_id").distinct()
    return pairs.select(
        F.concat_ws("|", "denial_reason_code", F.col("payer_id").cast("string")).alias("query_id"),
        F.concat(F.col("denial_reason_code"), F.lit(" appeal policy")).alias("text"),
        "payer_id",
    )


def ingest_documents(documents: DataFrame, existing_titles: DataFrame) -> DataFrame:
    """Chunks (with slots) of documents whose title is not stored yet."""
    fresh = documents.join(existing_titles.select("title").distinct(), "title", "left_anti")
    return with_slots(chunk_documents(fresh))


# Number of characters quoted from a chunk.
EXCERPT_CHARS = 220
POLICY_LINE_CHARS = 200
# Bundles, of some quoted chunks each, up to which they are broadcast to the denied claims.
BUNDLE_ROWS = 10_000


def policy_bundles(results: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per query: `cited`, the retrieved chunks in rank order with title and excerpts (at most k entries)."""
    text = chunks.select("document_id", "chunk_index", "title", "chunk_text")
    joined = text.join(small_side(materialize(results, "results")), ["document_id", "chunk_index"])
    item = F.struct(
        "rank",
        "document_id",
        "chunk_index",
        "title",
        F.substring("chunk_text", 1, EXCERPT_CHARS).alias("excerpt"),
        F.substring("chunk_text", 1, POLICY_LINE_CHARS).alias("line"),
    )
    return joined.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("cited"))


def _letter(missing: Column) -> Column:
    """Text of an appeal draft from claim facts, cited policies and missing evidence."""
    lines = F.array_join(
        F.transform("cited", lambda c: F.concat(F.lit("- "), c["title"], F.lit(": "), c["line"], F.lit("..."))), "\n"
    )
    policies = F.when(F.size("cited") > 0, lines).otherwise("- none")
    reason = F.col("denial_reason_code")
    gaps = F.when(
        F.size(missing) > 0,
        F.concat(F.lit("Still to be supplied: "), F.array_join(missing, ", "), F.lit("\n")),
    ).otherwise("")
    parts = [
        F.lit("DRAFT APPEAL - synthetic data, not to be sent before a person has approved it\n\nClaim "),
        F.col("claim_number"),
        F.lit(", denied as "),
        reason,
        F.lit("\n\nOn record:\n* amount billed: "),
        rules.plain_number(F.col("claim_amount")),
        F.lit("\n* date of service: "),
        F.date_format("service_date", "yyyy-MM-dd HH:mm:ss"),
        F.lit("\n* documents complete, percent: "),
        rules.plain_number(F.col("documentation_completeness")),
        F.lit("\n* authorization: "),
        F.coalesce("authorization_status", F.lit("None")),
        F.lit("\n\nPolicies found:\n"),
        policies,
        F.lit("\n\nWe ask for a new decision on "),
        reason,
        F.lit(". The request rests on the record and the policies quoted above alone.\n"),
        gaps,
    ]
    return F.concat(*parts)


def appeal_packets(denied: DataFrame, has_lines: DataFrame, bundles: DataFrame) -> DataFrame:
    """Evidence gate and appeal draft per denied claim; blocked claims stay, without a draft.

    `bundles` has one row per (reason, payer), so its rows are shared by many claims.
    """
    query_id = F.concat_ws("|", "denial_reason_code", F.col("payer_id").cast("string"))
    keyed = (
        denied.withColumn("query_id", query_id)
        .join(has_lines.select("claim_id", F.lit(True).alias("_lines")).distinct(), "claim_id", "left")
        .join(small_side(materialize(bundles, "bundles"), BUNDLE_ROWS), "query_id", "left")
    )
    retrieved = F.coalesce(F.size("cited"), F.lit(0))
    gate = rules.evidence(F.lit(True), F.coalesce("_lines", F.lit(False)), retrieved)
    gated = keyed.withColumn("evidence", gate).withColumn("cited", F.coalesce("cited", F.array()))
    allowed = F.col("evidence.generation_allowed")
    return gated.select(
        "claim_id",
        "denial_reason_code",
        "payer_id",
        "evidence",
        (~allowed).alias("blocked"),
        F.when(allowed, _letter(F.col("evidence.missing_evidence"))).alias("draft_text"),
        F.when(allowed, F.col("cited")).alias("citations"),
        F.when(allowed, F.lit("PENDING_APPROVAL")).alias("status"),
    )


def explode_citations(packets: DataFrame) -> DataFrame:
    cited = packets.filter(~F.col("blocked")).select("claim_id", "payer_id", "denial_reason_code", F.explode("citations").alias("c"))
    return cited.select(
        "claim_id",
        "payer_id",
        "denial_reason_code",
        F.col("c.document_id").alias("document_id"),
        F.col("c.chunk_index").alias("chunk_index"),
        F.col("c.excerpt").alias("excerpt"),
    )


def check_citations(citations: DataFrame, chunks: DataFrame, retrieved: DataFrame | None = None) -> DataFrame:
    """Per citation: does the chunk exist, is the excerpt part of it, was it retrieved for this claim.

    `retrieved` has query_id (reason|payer), document_id and chunk_index.
    """
    # each different quotation meets its chunk once; claims that share it get the verdict
    text = chunks.select("document_id", "chunk_index", "chunk_text")
    quote = F.trim(F.regexp_replace("excerpt", r"\.+$", ""))
    exists = F.col("chunk_text").isNotNull()
    faithful = F.coalesce(exists & (quote != "") & F.col("chunk_text").contains(quote), F.lit(False))
    keys = ["document_id", "chunk_index", "excerpt"]
    verdicts = citations.select(*keys).distinct().join(text, keys[:2], "left").select(
        *[F.col(c).alias(f"_{c}") for c in keys], exists.alias("chunk_exists"), faithful.alias("faithful")
    )
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys])
    checked = citations.join(verdicts, same, "left").drop(*[f"_{c}" for c in keys])
    if retrieved is None:
        return checked
    known = retrieved.select(
        "query_id", "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.lit(True).alias("_r")
    )
    query_id = F.concat_ws("|", "denial_reason_code", F.col("payer_id").cast("string"))
    return (
        checked.withColumn("query_id", query_id)
        .join(known, ["query_id", "document_id", "chunk_index"], "left")
        .withColumn("was_retrieved", F.coalesce("_r", F.lit(False)))
        .drop("_r", "query_id")
    )


def citation_summary(checked: DataFrame) -> DataFrame:
    """Integrity and fidelity rates; null when there are no citations."""
    n = F.count(F.lit(1))
    names = {"chunk_exists": "referential_integrity_rate", "faithful": "excerpt_fidelity_rate"}
    if "was_retrieved" in checked.columns:
        names["was_retrieved"] = "retrieved_rate"
    rates = [half_up(F.when(n > 0, F.count_if(c) / n), 4).alias(out) for c, out in names.items()]
    unsupported = half_up(F.when(n > 0, 1.0 - F.count_if("chunk_exists") / n), 4).alias("unsupported_citation_rate")
    return checked.agg(n.alias("total_citations"), *rates, unsupported)
