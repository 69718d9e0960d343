"""The numbered queries: name -> builder over (spark, sf_dir), and DuckDB SQL where SQL can state the result."""

from __future__ import annotations

from quillframe.llm import decontam, embeddings, lm, negatives, pii, quality, ranked, repeats, secrets, simhash, spieces, urls, warc
from quillframe.llm.common import documents
from quillframe.sources.tables import table

QUERIES = {
    "op1_lm_scores": lambda spark, d: lm.op1_lm_scores(documents(spark, d)),
    "op2_warc": lambda spark, d: warc.op2_warc(table(spark, d, "pages")),
    "op3_url_filters": lambda spark, d: urls.op3_url_filters(table(spark, d, "pages")),
    "op5_suffix_dedup": lambda spark, d: repeats.op5_suffix_dedup(documents(spark, d)),
    "op4_sentencepiece": lambda spark, d: spieces.op4_sentencepiece(documents(spark, d)),
    "op9_decontamination": lambda spark, d: decontam.op9_decontamination(documents(spark, d), table(spark, d, "benchmark")),
    "op6_simhash": lambda spark, d: simhash.op6_simhash(documents(spark, d)),
    "op7_pii": lambda spark, d: pii.op7_pii(documents(spark, d)),
    "op8_quality_rules": lambda spark, d: quality.op8_quality_rules(documents(spark, d, "doc_id", "text", "lang")),
    "op10_secret_scans": lambda spark, d: secrets.op10_secret_scans(documents(spark, d)),
    "op11_ranked_search": lambda spark, d: ranked.op11_ranked_search(documents(spark, d), table(spark, d, "benchmark")),
    "op12_hard_negatives": lambda spark, d: negatives.op12_hard_negatives(table(spark, d, "embeddings")),
    "op13_embedding_dedup": lambda spark, d: embeddings.op13_embedding_dedup(table(spark, d, "embeddings")),
}

ORACLE = {
    "op2_warc": warc.OP2_SQL,
    "op7_pii": pii.OP7_SQL,
    "op8_quality_rules": quality.OP8_SQL,
    "op10_secret_scans": secrets.OP10_SQL,
    "op11_ranked_search": ranked.OP11_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
    "op13_embedding_dedup": embeddings.OP13_SQL,
}
