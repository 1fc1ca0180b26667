"""Imports every module that registers a query."""

from inlay.llm import (  # noqa: F401
    op1_near_dedup,
    op2_packing,
    op3_sharding,
    op4_line_dedup,
    op5_decontamination,
    op6_hmm,
    op7_suffix,
    op8_secrets,
    op9_warc,
    op10_quality,
    op11_repair,
    op12_fingerprint,
    op13_whitening,
    oracles,
)
from inlay.llm.queries import ORACLES, QUERIES  # noqa: F401
