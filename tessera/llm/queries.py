"""The ten queries by name, and oracle SQL where SQL expresses them."""

from __future__ import annotations

from tessera.llm import decontam, html, jaccard, licenses, lm, mixture, nearest, secrets, templates, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1,
    "op2_lm_scores": lm.op2,
    "op3_line_templates": templates.op3,
    "op4_secret_scan": secrets.op4,
    "op5_source_mix": mixture.op5,
    "op6_html_text": html.op6,
    "op7_decontamination": decontam.op7,
    "op8_jaccard_join": jaccard.op8,
    "op9_toxicity": toxicity.op9,
    "op10_nearest": nearest.op10,
}
ORACLES = {"op5_source_mix": mixture.ORACLE, "op8_jaccard_join": jaccard.ORACLE, "op10_nearest": nearest.ORACLE}
