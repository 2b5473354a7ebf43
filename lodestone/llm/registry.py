"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm.decontaminate import OP9_SQL, op9_decontamination
from lodestone.llm.divergence import OP12_SQL, op12_source_divergence
from lodestone.llm.exactdup import OP11_SQL, op11_exact_dedup
from lodestone.llm.langid import op2_language_id
from lodestone.llm.licenses import OP8_SQL, op8_license_scan
from lodestone.llm.mainhtml import op10_main_text
from lodestone.llm.maxscore import OP5_SQL, op5_top_k
from lodestone.llm.neardup import OP1_SQL, op1_near_duplicates
from lodestone.llm.packing import op6_packing
from lodestone.llm.quality import op4_quality
from lodestone.llm.urlfilter import OP7_SQL, op7_url_filter
from lodestone.llm.warc import OP3_SQL, op3_warc
from lodestone.llm.whitening import op13_whitening

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language_id": op2_language_id,
    "op3_warc": op3_warc,
    "op4_quality": op4_quality,
    "op5_top_k": op5_top_k,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_whitening": op13_whitening,
}
#: The others are models and programs that SQL can't express; tests hold them against brute force.
ORACLE_SQL = {
    "op1_near_duplicates": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op5_top_k": OP5_SQL,
    "op7_url_filter": OP7_SQL,
    "op8_license_scan": OP8_SQL,
    "op9_decontamination": OP9_SQL,
    "op11_exact_dedup": OP11_SQL,
    "op12_source_divergence": OP12_SQL,
}
