"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pixledger.llm.decontaminate import op9_decontaminate
from pixledger.llm.fingerprints import op3_fingerprints
from pixledger.llm.html_text import op8_html_text
from pixledger.llm.jaccard_join import op1_jaccard_join
from pixledger.llm.language import op10_language
from pixledger.llm.manifest import op12_manifest
from pixledger.llm.oracles import ORACLES
from pixledger.llm.packing import op6_packing
from pixledger.llm.periodic_runs import op11_periodic_runs
from pixledger.llm.personal_data import op7_personal_data
from pixledger.llm.quality import op2_quality
from pixledger.llm.repeats import op13_substring_dedup
from pixledger.llm.secrets import op4_secrets
from pixledger.llm.url_filter import op5_url_filter

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_quality": op2_quality,
    "op3_fingerprints": op3_fingerprints,
    "op4_secrets": op4_secrets,
    "op5_url_filter": op5_url_filter,
    "op6_packing": op6_packing,
    "op7_personal_data": op7_personal_data,
    "op8_html_text": op8_html_text,
    "op9_decontaminate": op9_decontaminate,
    "op10_language": op10_language,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_manifest": op12_manifest,
    "op13_substring_dedup": op13_substring_dedup,
}

__all__ = ["ORACLES", "QUERIES"]
