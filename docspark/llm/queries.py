"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from .decontamination import op3
from .language_id import op7
from .lm_scoring import op1
from .mixing import OP5_SQL, op5
from .ngram_join import OP6_SQL, op6
from .nn_descent import OP8_SQL, op8
from .sharding import op10
from .suffix_dedup import op4
from .toxicity import op9
from .warc_zip import OP2_SQL, op2

QUERIES = {
    "op1_lm_deleted_interpolation": op1,
    "op2_warc_zip": op2,
    "op3_benchmark_decontamination": op3,
    "op4_suffix_array_dedup": op4,
    "op5_poisson_mixing": op5,
    "op6_ngram_jaccard_join": op6,
    "op7_language_id": op7,
    "op8_nn_descent": op8,
    "op9_toxicity_grammar": op9,
    "op10_sharding": op10,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_zip": OP2_SQL,
    "op5_poisson_mixing": OP5_SQL,
    "op6_ngram_jaccard_join": OP6_SQL,
    "op8_nn_descent": OP8_SQL,
}
