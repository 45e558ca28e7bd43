"""The corpus queries and their SQL, by name."""

from __future__ import annotations

from . import licenses
from .langid import op2_language
from .decontaminate import op10_decontaminate
from .line_dedup import op8_lines
from .ngram_join import op6_ngrams
from .pieces import op3_pieces
from .quality import op4_quality
from .rules import op9_rules
from .toxicity import op7_toxicity
from .urlfilter import op5_urls

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_language": op2_language,
    "op3_pieces": op3_pieces,
    "op4_quality": op4_quality,
    "op5_urls": op5_urls,
    "op6_ngrams": op6_ngrams,
    "op7_toxicity": op7_toxicity,
    "op8_lines": op8_lines,
    "op9_rules": op9_rules,
    "op10_decontaminate": op10_decontaminate,
}
ORACLES: dict[str, str] = {"op1_licenses": licenses.oracle()}
