"""The registered queries of this subpackage, and SQL for those that DuckDB can express."""

from __future__ import annotations

from weftline.llm import infill, langid, neardup, packing, piecebpe, prefixtrie, quality, shinglejoin, tokencount, toxicity, urlfilter, warc, zipquality


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            shinglejoin.op1_ngram_jaccard_join,
            tokencount.op2_token_counts,
            packing.op3_packing,
            langid.op4_language_id,
            piecebpe.op5_sentencepiece,
            toxicity.op6_toxicity,
            neardup.op7_embedding_neardup,
            warc.op8_warc,
            quality.op9_quality_rules,
            urlfilter.op10_url_filters,
            infill.op11_fill_in_middle,
            zipquality.op12_quality_classifier,
            prefixtrie.op13_conversation_trie,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_jaccard_join": shinglejoin.ORACLE,
        "op7_embedding_neardup": neardup.ORACLE,
        "op8_warc": warc.ORACLE,
        "op9_quality_rules": quality.ORACLE,
        "op11_fill_in_middle": infill.ORACLE,
        "op13_conversation_trie": prefixtrie.ORACLE,
    }
