"""The text operators' queries and their SQL."""

from __future__ import annotations

from .decontam import op10_decontamination
from .hmm import op2_language_model
from .license import op8_license_scan
from .mixing import op5_mixing
from .neardup import op6_near_duplicates
from .oracles import LEAKS, LICENSES, NEAR_DUPLICATES, QUALITY, QUOTES, URLS
from .quality import op7_quality
from .quotes import op9_quotation_linking
from .sharding import op3_sharding
from .tokenout import op1_token_output
from .urlfilter import op4_url_filter

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_language_model": op2_language_model,
    "op3_sharding": op3_sharding,
    "op4_url_filter": op4_url_filter,
    "op5_mixing": op5_mixing,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_quality_rules": op7_quality,
    "op8_license_scan": op8_license_scan,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {"op10_decontamination": LEAKS, "op4_url_filter": URLS, "op6_near_duplicates": NEAR_DUPLICATES, "op7_quality_rules": QUALITY, "op8_license_scan": LICENSES, "op9_quotation_linking": QUOTES}
