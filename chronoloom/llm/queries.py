"""The eleven registered queries of this subpackage, less the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.llm import decontaminate, line_crf, line_dedup, packing, passages, quality_rules, simhash, substring_exact, token_store, warc
from chronoloom.llm.common import new_path, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 1).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op2_line_crf(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    scored = line_crf.score(docs, model, carry=["doc_id"])
    return scored.select("doc_id", line_crf.held_out().alias("held_out"), "score", "predicted")


def op3_passages(spark, sf_dir):
    return passages.near_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_token_store(spark, sf_dir):
    uri = new_path(spark, "tokens")
    manifest = token_store.write_tokens(table(spark, sf_dir, "documents"), uri, tokenizer_file("word_bpe_49k.json"), 2)
    read = token_store.read_tokens(spark, uri).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_store.document_starts(read, manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_suffix_array(spark, sf_dir):
    d = substring_exact.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_line_dedup(spark, sf_dir):
    d = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), carry=["doc_id"])
    return d.select("doc_id", "n_lines", "n_removed", F.sha2("new_text", 256).alias("kept_sha256"))


def op8_quality_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(d, carry=["doc_id"])


def op10_decontaminate(spark, sf_dir):
    d = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return d.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_warc_revisits(spark, sf_dir):
    done = warc.resolve_revisits(warc.captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e.key, F.lit(": "), e.value))
    return done.select("record_id", "canonical_url", "original_id", "status", F.array_join(lines, "\n").alias("headers"), "digest", "n_bytes")


QUERIES = {"op1_packing": op1_packing, "op2_line_crf": op2_line_crf, "op3_passages": op3_passages, "op4_simhash": op4_simhash, "op5_token_store": op5_token_store, "op6_suffix_array": op6_suffix_array, "op7_line_dedup": op7_line_dedup, "op8_quality_rules": op8_quality_rules, "op9_warc_revisits": op9_warc_revisits, "op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {"op9_warc_revisits": warc.ORACLE}
