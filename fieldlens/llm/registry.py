"""Registered queries of the training-data operators, and SQL where SQL can express them."""

from __future__ import annotations

from .containment import OP6_SQL, op6_containment
from .edit_counts import op4_edit_counts
from .filter_audit import OP12_SQL, op12_filter_audit
from .line_quality import OP13_SQL, op13_line_quality
from .pii_bootstrap import op2_pii_bootstrap
from .revisit import OP10_SQL, op10_revisit
from .secrets import op1_zstd_secrets
from .sentence_pieces import op9_sentence_pieces
from .simhash_cover import op5_simhash_cover
from .token_store import op7_token_store
from .toxicity import op3_weak_toxicity
from .turn_repair import OP11_SQL, op11_turn_repair
from .voronoi_knn import OP8_SQL, op8_voronoi_knn

QUERIES = {f.__name__: f for f in (
    op1_zstd_secrets, op2_pii_bootstrap, op3_weak_toxicity, op4_edit_counts, op5_simhash_cover,
    op6_containment, op7_token_store, op8_voronoi_knn, op9_sentence_pieces, op10_revisit,
    op11_turn_repair, op12_filter_audit, op13_line_quality)}

#: Operators without an entry here are tested against brute force in tests/llm.
ORACLE_SQL = {"op6_containment": OP6_SQL, "op8_voronoi_knn": OP8_SQL, "op10_revisit": OP10_SQL,
              "op11_turn_repair": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_line_quality": OP13_SQL}
