"""The corpus queries that __spark_entry__.py registers, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op6_bpe
from .exact_dedup import OP5_SQL, op5_exact_dedup
from .fingerprint import op3_fingerprint
from .jaccard import OP8_SQL, op8_jaccard_join
from .langid import op2_language_id
from .line_dedup import op10_line_dedup
from .mixing import OP1_SQL, op1_mixing
from .pii import op7_pii
from .quality import op9_quality
from .secrets import op4_secrets

QUERIES = {f.__name__: f for f in (op1_mixing, op2_language_id, op3_fingerprint, op4_secrets, op5_exact_dedup, op6_bpe, op7_pii, op8_jaccard_join, op9_quality, op10_line_dedup)}
#: The others learn, hash or tokenise in ways that SQL lacks; tests/llm holds them against brute force, round trips or held-out rows.
ORACLE_SQL: dict[str, str] = {"op1_mixing": OP1_SQL, "op5_exact_dedup": OP5_SQL, "op8_jaccard_join": OP8_SQL}
