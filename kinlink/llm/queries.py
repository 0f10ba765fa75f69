"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from kinlink.llm.decontaminate import OP7_SQL, op7_decontaminate
from kinlink.llm.figures import LICENSE_SQL, PII_SQL, QUALITY_SQL, license_base, pii_base, quality_base
from kinlink.llm.license import op8_license
from kinlink.llm.packing import op2_packing
from kinlink.llm.pii import op4_pii
from kinlink.llm.quality import op5_quality
from kinlink.llm.simhash import op6_simhash
from kinlink.llm.token_store import op9_token_store
from kinlink.llm.toxicity import op3_toxicity
from kinlink.llm.urls import OP10_SQL, op10_urls
from kinlink.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_packing": op2_packing,
    "op3_toxicity": op3_toxicity,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_simhash": op6_simhash,
    "op7_decontaminate": op7_decontaminate,
    "op8_license": op8_license,
    "op9_token_store": op9_token_store,
    "op10_urls": op10_urls,
    # op4, op5 and op8 without what they learn
    "pii_base": pii_base,
    "quality_base": quality_base,
    "license_base": license_base,
}
SQL = {"op1_warc": OP1_SQL, "op7_decontaminate": OP7_SQL, "op10_urls": OP10_SQL, "pii_base": PII_SQL, "quality_base": QUALITY_SQL, "license_base": LICENSE_SQL}
