"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from homelens.llm.codebooks import ORACLE as CODEBOOKS_SQL
from homelens.llm.codebooks import op11_integer_codebooks
from homelens.llm.factors import ORACLE as FACTORS_SQL
from homelens.llm.factors import op13_reference_factors
from homelens.llm.infill import ORACLE as INFILL_SQL
from homelens.llm.infill import op12_distinct_texts
from homelens.llm.langid import op3_language_codes
from homelens.llm.lines import ORACLE as LINES_SQL
from homelens.llm.lines import op8_deletion_neighbourhood
from homelens.llm.lm import op5_kneser_ney
from homelens.llm.mixing import op7_splitting_tree
from homelens.llm.neardup import op6_pca_tiles
from homelens.llm.packing import op4_best_two_fit
from homelens.llm.quality import op9_weak_rules
from homelens.llm.setjoin import op1_universe_partition
from homelens.llm.suffixes import op2_bucket_refinement
from homelens.llm.tokenfiles import op10_token_files

QUERIES = {
    "op1_universe_partition": op1_universe_partition,
    "op2_bucket_refinement": op2_bucket_refinement,
    "op3_language_codes": op3_language_codes,
    "op4_best_two_fit": op4_best_two_fit,
    "op5_kneser_ney": op5_kneser_ney,
    "op6_pca_tiles": op6_pca_tiles,
    "op7_splitting_tree": op7_splitting_tree,
    "op8_deletion_neighbourhood": op8_deletion_neighbourhood,
    "op9_weak_rules": op9_weak_rules,
    "op10_token_files": op10_token_files,
    "op11_integer_codebooks": op11_integer_codebooks,
    "op12_distinct_texts": op12_distinct_texts,
    "op13_reference_factors": op13_reference_factors,
}
ORACLES = {
    "op8_deletion_neighbourhood": LINES_SQL,
    "op11_integer_codebooks": CODEBOOKS_SQL,
    "op12_distinct_texts": INFILL_SQL,
    "op13_reference_factors": FACTORS_SQL,
}
