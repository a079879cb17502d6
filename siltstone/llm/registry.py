"""The queries of this subpackage and the SQL that some are compared with."""

from __future__ import annotations

from . import alignment, ann, bm25, bpe, compaction, fixity, heap_lloyd, language, mixing, ngram_join, packing, substring_dedup, url_filter

QUERIES = {
    "op1_fixity": fixity.query,
    "op2_suffix_array": substring_dedup.query,
    "op3_packing": packing.query,
    "op4_url_filter": url_filter.query,
    "op5_compaction": compaction.query,
    "op6_ngram_join": ngram_join.query,
    "op7_language": language.query,
    "op8_bpe": bpe.query,
    "op9_bm25": bm25.query,
    "op10_ann": ann.query,
    "op11_alignment": alignment.query,
    "op12_heap_lloyd": heap_lloyd.query,
    "op13_mixing": mixing.query,
}

ORACLE_SQL = {
    "op1_fixity": fixity.ORACLE_SQL,
    "op4_url_filter": url_filter.ORACLE_SQL,
    "op9_bm25": bm25.ORACLE_SQL,
    "op12_heap_lloyd": heap_lloyd.ORACLE_SQL,
    "op13_mixing": mixing.ORACLE_SQL,
}
