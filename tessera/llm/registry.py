"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from .audit import ORACLE_SQL as AUDIT_SQL
from .audit import op13_audit
from .decontamination import op4_decontamination
from .hmm import op2_hmm
from .layout import op7_layout
from .media import op10_media
from .mixing import op5_mixing
from .quotes import ORACLE_SQL as QUOTES_SQL
from .quotes import QUOTING_SQL, op1_quotes, quoted_replies
from .repeats import op9_repeats
from .runs import op12_runs
from .simhash import op3_simhash
from .slots import op11_slots
from .token_files import op8_token_files
from .toxicity import op6_toxicity

QUERIES = {
    "op1_quotes": op1_quotes,
    "op2_hmm": op2_hmm,
    "op3_simhash": op3_simhash,
    "op4_decontamination": op4_decontamination,
    "op5_mixing": op5_mixing,
    "op6_toxicity": op6_toxicity,
    "op7_layout": op7_layout,
    "op8_token_files": op8_token_files,
    "op9_repeats": op9_repeats,
    "op10_media": op10_media,
    "op11_slots": op11_slots,
    "op12_runs": op12_runs,
    "op13_audit": op13_audit,
    "quoted_replies": quoted_replies,
}

ORACLES: dict[str, str] = {"op1_quotes": QUOTES_SQL, "op13_audit": AUDIT_SQL, "quoted_replies": QUOTING_SQL}
