"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op4_prefix_bpe
from .jaccard import op9_ngram_jaccard_join
from .langid import op8_rank_order_language
from .licenses import op6_license_scan
from .lm import op7_elias_fano_lm
from .media import op1_audio_media
from .packing import op3_best_fit_packing
from .rules import ABLATION_SQL, OP2_SQL, POLICIES_SQL, op2_rule_ledger, rules_ablation, rules_policies
from .toxicity import op10_string_kernel_toxicity
from .unigram import op5_unigram_token_counts

QUERIES = {f.__name__: f for f in (op1_audio_media, op2_rule_ledger, op3_best_fit_packing, op4_prefix_bpe,
    op5_unigram_token_counts, op6_license_scan, op7_elias_fano_lm, op8_rank_order_language, op9_ngram_jaccard_join,
    op10_string_kernel_toxicity, rules_policies, rules_ablation)}
SQL = {"op2_rule_ledger": OP2_SQL, "rules_policies": POLICIES_SQL, "rules_ablation": ABLATION_SQL}
