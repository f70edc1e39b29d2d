"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from tallyloom.llm.byte_bpe import op10_byte_bpe
from tallyloom.llm.common import share_path
from tallyloom.llm.exact_dedup import ORACLE_OP5, op5_exact_dedup
from tallyloom.llm.langid import op8_language_id
from tallyloom.llm.mtree import ORACLE_OP4, op4_topk
from tallyloom.llm.near_dedup import op2_near_dedup
from tallyloom.llm.packing import op6_packing
from tallyloom.llm.passages import ORACLE_OP7, op7_passages
from tallyloom.llm.secrets import ORACLE_OP9, op9_secrets
from tallyloom.llm.toxicity import op1_toxicity
from tallyloom.llm.urls import op3_urls

_ALL = {"op1_toxicity": op1_toxicity, "op2_near_dedup": op2_near_dedup, "op3_urls": op3_urls, "op4_topk": op4_topk, "op5_exact_dedup": op5_exact_dedup, "op6_packing": op6_packing, "op7_passages": op7_passages, "op8_language_id": op8_language_id, "op9_secrets": op9_secrets, "op10_byte_bpe": op10_byte_bpe, "pipeline": corpus_pipeline.run}
QUERIES = {name: lambda spark, sf_dir, f=f: f(share_path(spark), sf_dir) for name, f in _ALL.items()}
ORACLE = {"op4_topk": ORACLE_OP4, "op5_exact_dedup": ORACLE_OP5, "op7_passages": ORACLE_OP7, "op9_secrets": ORACLE_OP9}
