"""The queries of this package and the SQL that stands against them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm.bpe import op6_bpe
from lectern.llm.decontaminate import op5_decontaminate
from lectern.llm.fingerprint import op10_fingerprints
from lectern.llm.html import op1_html
from lectern.llm.jaccard import op9_jaccard
from lectern.llm.language import op8_language
from lectern.llm.licenses import op2_licenses
from lectern.llm.merkle import op13_merkle
from lectern.llm.oracles import OP5_SQL, OP9_SQL, OP11_SQL, OP13_SQL
from lectern.llm.pieces import op12_pieces
from lectern.llm.suffixes import op3_suffixes
from lectern.llm.token_counts import op7_token_counts
from lectern.llm.variants import op11_variants
from lectern.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_licenses": op2_licenses,
    "op3_suffixes": op3_suffixes,
    "op4_warc": op4_warc,
    "op5_decontaminate": op5_decontaminate,
    "op6_bpe": op6_bpe,
    "op7_token_counts": op7_token_counts,
    "op8_language": op8_language,
    "op9_jaccard": op9_jaccard,
    "op10_fingerprints": op10_fingerprints,
    "op11_variants": op11_variants,
    "op12_pieces": op12_pieces,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {"op4_warc": OP4_SQL, "op5_decontaminate": OP5_SQL, "op9_jaccard": OP9_SQL, "op11_variants": OP11_SQL, "op13_merkle": OP13_SQL}
