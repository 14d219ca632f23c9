"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.avi import op6_avi_media
from tidemark.llm.decontamination import op2_decontamination
from tidemark.llm.exact_dedup import OP13_SQL, op13_exact_dedup
from tidemark.llm.hard_negatives import OP11_SQL, op11_hard_negatives
from tidemark.llm.line_dedup import op8_line_dedup
from tidemark.llm.merkle import OP12_SQL, op12_merkle
from tidemark.llm.packing import op3_packing
from tidemark.llm.pseudonyms import op10_pseudonyms
from tidemark.llm.sharding import op9_sharding
from tidemark.llm.simhash import op7_simhash
from tidemark.llm.token_files import op5_token_files
from tidemark.llm.toxicity import op1_toxicity
from tidemark.llm.warc import op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_decontamination": op2_decontamination,
    "op3_packing": op3_packing,
    "op4_warc": op4_warc,
    "op5_token_files": op5_token_files,
    "op6_avi_media": op6_avi_media,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_sharding": op9_sharding,
    "op10_pseudonyms": op10_pseudonyms,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_merkle": op12_merkle,
    "op13_exact_dedup": op13_exact_dedup,
}

#: Dictionaries, files and permutations are beyond SQL; tests/llm holds the other queries against brute-force versions.
ORACLES: dict[str, str] = {"op11_hard_negatives": OP11_SQL, "op12_merkle": OP12_SQL, "op13_exact_dedup": OP13_SQL}
