"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op8_hilbert_neighbours
from .chat_format import OP1_SQL, op1_chat_format
from .decontamination import op10_decontamination
from .near_dedup import op4_near_dedup
from .oracles import OP4_SQL, OP9_SQL, OP10_SQL, OP11_SQL, OP13_SQL
from .packing import op5_best_fit_packing
from .pieces import op12_sentencepiece
from .pii import op7_pseudonyms
from .repair import op11_structure_repair
from .runs import op13_periodic_runs
from .secret_scan import op6_secret_scan
from .sharding import op2_sharding
from .substring_dedup import op9_substring_dedup
from .toxicity import op3_toxicity

QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_sharding": op2_sharding,
    "op3_toxicity": op3_toxicity,
    "op4_near_dedup": op4_near_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_secret_scan": op6_secret_scan,
    "op7_pseudonyms": op7_pseudonyms,
    "op8_hilbert_neighbours": op8_hilbert_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_structure_repair": op11_structure_repair,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLES: dict[str, str] = {
    "op1_chat_format": OP1_SQL,
    "op4_near_dedup": OP4_SQL,
    "op9_substring_dedup": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_structure_repair": OP11_SQL,
    "op13_periodic_runs": OP13_SQL,
}
