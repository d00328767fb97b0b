"""The registered query of each operator and of the pipeline, and their SQL counterparts."""

from __future__ import annotations

from tripflow.llm.chat_format import OP5_SQL, op5_chat_format
from tripflow.llm.collocations import OP12_SQL, op12_collocations
from tripflow.llm.decontamination import OP1_SQL, op1_decontamination
from tripflow.llm.fingerprints import op7_fingerprints
from tripflow.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from tripflow.llm.lm_score import op6_lm_score
from tripflow.llm.mixing import op2_mixing
from tripflow.llm.near_dedup import op10_near_dedup
from tripflow.llm.nearest_vectors import op11_nearest_vectors
from tripflow.llm.pii import op9_pii
from tripflow.llm.quality import op8_quality
from tripflow.llm.sharding import op3_sharding
from tripflow.llm.token_counts import op4_token_counts

QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mixing, op3_sharding, op4_token_counts, op5_chat_format, op6_lm_score, op7_fingerprints, op8_quality, op9_pii, op10_near_dedup, op11_nearest_vectors, op12_collocations, op13_hard_negatives)}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op5_chat_format": OP5_SQL, "op12_collocations": OP12_SQL, "op13_hard_negatives": OP13_SQL}
