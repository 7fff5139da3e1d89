"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, functions as F

from . import collocations, decontaminate, jaccard_join, language_id, line_dedup, mixing, perplexity, secrets, spelling, sql, suffix_dedup, token_counts, toxicity, url_filter

#: Fixed rules of the url query.
URL_RULES = [
    url_filter.Rule("com", "/", "allow"), url_filter.Rule("example.com", "/en/", "block"),
    url_filter.Rule("www.example.com", "/en/", "allow"), url_filter.Rule("net", "/es/", "block"),
    url_filter.Rule("net", "/fr/", "block"),
]

#: Where the tokenizer vocabularies are, and an e-mail address.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark, sf_dir) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string")) % 3 == 1


def op2_language_id(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    model = language_id.fit(docs.filter(~F.col("held_out")))
    return language_id.identify(docs.select("doc_id", "held_out", "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def op3_toxicity(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(held_out(), F.lit(False)))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(~held_out())
    grammar = toxicity.fit(docs, labels)
    scored = toxicity.score(docs, grammar)
    return scored.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
                         "clause_weight", "clauses")


def op4_ngram_jaccard(spark, sf_dir) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op5_perplexity_rules(spark, sf_dir) -> DataFrame:
    judged = perplexity.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *perplexity.STATISTICS, "base_failed", "kept", "log_perplexity")


def redactions(text: Column) -> Column:
    """Edits that replace e-mail addresses and long hexadecimal keys."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    found = F.concat(F.when(F.contains(text, F.lit("@")), secrets.matches(text, 0, EMAIL)).otherwise(none),
                     F.when(text.rlike(secrets.HEX), secrets.matches(text, 1, secrets.HEX)).otherwise(none))
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.when(
        m["kind"] == 0, "[email]").otherwise("[key]").alias("replacement")))


def op6_edit_token_counts(spark, sf_dir) -> DataFrame:
    """Token counts of all documents before and after their redaction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(redactions(F.col("text")), F.array().cast(
        token_counts.EDITS)).alias("edits"))
    vocabulary = token_counts.Vocabulary.read(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    state = token_counts.build(docs, vocabulary).withColumn("n_tokens_before", F.col("n_tokens"))
    edited = token_counts.apply_edits(state, vocabulary)
    return edited.select("doc_id", "n_tokens_before", "n_edits", F.col("n_tokens").alias("n_tokens_after"),
                         F.length("text").alias("n_chars_after"), "reencoded_chars")


def op7_url_filter(spark, sf_dir) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES).select(
        "page_id", "host", "path", "rule", "verdict")


def op8_line_dedup(spark, sf_dir) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped",
                      F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op9_decontaminate(spark, sf_dir) -> DataFrame:
    """Every (doc_id, item_id) found, with the word edits between them."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    pairs = found.select("doc_id", F.explode(F.arrays_zip("item_ids", "item_edits")).alias("m"))
    return pairs.select("doc_id", F.col("m")["item_ids"].alias("item_id"), F.col("m")["item_edits"].alias("edits"))


def op10_secret_scan(spark, sf_dir) -> DataFrame:
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op11_suffix_dedup(spark, sf_dir) -> DataFrame:
    out = suffix_dedup.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op12_collocations(spark, sf_dir) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark, sf_dir) -> DataFrame:
    return spelling.variant_groups(spelling.count_words(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_language_id, op3_toxicity, op4_ngram_jaccard, op5_perplexity_rules, op6_edit_token_counts, op7_url_filter, op8_line_dedup, op9_decontaminate, op10_secret_scan,
                                       op11_suffix_dedup, op12_collocations, op13_spelling_variants)}
SQL = {"op1_mix_sources": sql.MIX, "op4_ngram_jaccard": sql.JACCARD, "op7_url_filter": sql.urls(URL_RULES), "op8_line_dedup": sql.LINES,
       "op10_secret_scan": sql.SECRETS, "op11_suffix_dedup": sql.REPEATS, "op12_collocations": sql.PHRASES}
