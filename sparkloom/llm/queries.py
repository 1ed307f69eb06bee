"""Queries of the training-data operators over whole tables, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ensure_importable, materialize, shared_dir, table
from . import chat, decontaminate, html_extract, kernel, language, ngram_jaccard, packing, quality, ranked_search, rollups, runs, secret_scan, substring, toxicity

Query = Callable[[SparkSession, str], DataFrame]

#: Rows of an Arrow batch: texts are long, batches stay near 2 MB.
BATCH_ROWS = "1000"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def prepared(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ensure_importable(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.similar_classes(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality_rules(docs).drop("text")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, vocabulary()))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, ("assign", "access", "hex")), F.sha2(secret_scan.joined(F.col("secrets"), ("assign", "access", "hex")), 256).alias("base_sha256"), secret_scan.joined(F.col("secrets")).alias("spans"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.main_text(pages).withColumn("n_chars", F.char_length("text").cast("long"))


#: The two added turns, which hold the template's own strings.
HARD_CASE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    logs = logs.unionByName(spark.createDataFrame(HARD_CASE, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_turns(chat.as_events(logs)))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(toxicity.labelled_sample(docs, table(spark, sf_dir, "labels")))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches over all documents: every one is inserted; those whose
    text a smaller doc_id of the same source and language has are deleted;
    the others' BPE counts are revised to the tidied text. The second batch
    arrives twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = rollups.token_counts(docs.withColumn("same", F.sha2(F.to_json(F.struct("source", "lang", F.coalesce("text", F.lit("")).alias("text"))), 256)), vocabulary())
    counts = materialize(counts)
    seen = materialize(counts.join(counts.groupBy("same").agg(F.min("doc_id").alias("first_id")), "same"))
    again = seen.where("doc_id <> first_id")
    versions = {"words": "n_words", "byte_bpe_50k": "n_bpe"}
    kept = rollups.Rollup(spark, shared_dir(spark))
    kept.commit("insert", rollups.changes(counts, versions))
    for _ in range(2):
        kept.commit("delete", rollups.changes(again, versions, -1))
    kept.commit("revise", rollups.revisions(seen.where("doc_id = first_id"), "byte_bpe_50k", "n_bpe", "n_bpe_tidy"))
    return kept.totals()


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search.search(docs, table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (
  SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term
), size AS (
  SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), whole AS (
  SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM size
), weight AS (
  SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, whole GROUP BY term, big_n
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), whole GROUP BY item_id, doc_id
), placed AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 10
"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learnt from the documents whose remainder by 3 is not 1, applied to all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    apart = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = language.fit(docs.where(~apart))
    return language.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(apart, F.lit(False)).alias("held_out"), "lang_pred", "score")


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every document as it is, but for those whose
    h = crc32(doc_id) ends in 0: their n words, joined by one space, repeat
    from word a = g % n with period 1 + floor((n - a) / (3 + g % 8)), where
    g = floor(h / 10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.slices(batches):
            texts = kernel.raw(batch.column("text"))
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                h = zlib.crc32(str(doc_id).encode())
                words = texts[i].split() if doc_id is not None and h % 10 == 0 else []
                if words:
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    texts[i] = b" ".join(words[:a] + [words[a + k % p] for k in range(n - a)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, docs.schema)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document's words, some of which repeat by contract."""
    found = runs.periodic_runs(looped(table(spark, sf_dir, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    best = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), "runs", "collapsed")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return best.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Query]:
    own = [op1_ngram_jaccard_join, op2_quality_rules, op3_best_fit_packing, op4_secret_scans, op5_html_extraction, op6_chat_formatting, op7_benchmark_decontamination, op8_toxicity, op9_token_counts, op10_substring_dedup, op11_ranked_search, op12_language_id, op13_periodic_runs]
    return {f.__name__: prepared(f) for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op11_ranked_search": OP11_SQL}
