"""The registered queries of this subpackage and, where DuckDB can express them, their SQL."""

from __future__ import annotations

from palisade.llm.embedding_dedup import OP2_SQL, op2_embedding_dedup
from palisade.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from palisade.llm.fill_middle import OP11_SQL, op11_fill_middle
from palisade.llm.language_id import op7_language_id
from palisade.llm.line_dedup import OP1_SQL, op1_line_dedup
from palisade.llm.ngram_join import OP10_SQL, op10_ngram_join
from palisade.llm.packing import op4_best_fit_packing
from palisade.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from palisade.llm.secret_scan import OP5_SQL, op5_secret_scan
from palisade.llm.source_mixing import OP3_SQL, op3_source_mixing
from palisade.llm.suffix_dedup import OP9_SQL, op9_suffix_dedup
from palisade.llm.toxicity import op6_toxicity
from palisade.llm.warc import OP13_SQL, op13_warc


def queries() -> dict:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_embedding_dedup": op2_embedding_dedup,
        "op3_source_mixing": op3_source_mixing,
        "op4_best_fit_packing": op4_best_fit_packing,
        "op5_secret_scan": op5_secret_scan,
        "op6_toxicity": op6_toxicity,
        "op7_language_id": op7_language_id,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_ngram_join": op10_ngram_join,
        "op11_fill_middle": op11_fill_middle,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_warc": op13_warc,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_dedup": OP1_SQL,
        "op2_embedding_dedup": OP2_SQL,
        "op3_source_mixing": OP3_SQL,
        "op5_secret_scan": OP5_SQL,
        "op8_exact_dedup": OP8_SQL,
        "op9_suffix_dedup": OP9_SQL,
        "op10_ngram_join": OP10_SQL,
        "op11_fill_middle": OP11_SQL,
        "op12_prefix_trie": OP12_SQL,
        "op13_warc": OP13_SQL,
    }
