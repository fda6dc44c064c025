"""The queries of this subpackage and their SQL."""

from tidelog.llm.decontaminate import OP10_SQL, op10_decontamination
from tidelog.llm.language import op8_language
from tidelog.llm.lm import op4_language_model
from tidelog.llm.neardup import op1_neardup
from tidelog.llm.neighbours import op6_neighbours
from tidelog.llm.packing import op7_packing
from tidelog.llm.pii import op9_pii
from tidelog.llm.sstable import op3_sstable
from tidelog.llm.toxicity import op5_toxicity
from tidelog.llm.urls import op2_url_filter

QUERIES = {
    "op1_neardup": op1_neardup,
    "op2_url_filter": op2_url_filter,
    "op3_sstable": op3_sstable,
    "op4_language_model": op4_language_model,
    "op5_toxicity": op5_toxicity,
    "op6_neighbours": op6_neighbours,
    "op7_packing": op7_packing,
    "op8_language": op8_language,
    "op9_pii": op9_pii,
    "op10_decontamination": op10_decontamination,
}
ORACLES = {"op10_decontamination": OP10_SQL}
