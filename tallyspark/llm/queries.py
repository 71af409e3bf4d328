"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import decontaminate, language, lines, middle, minhash, packing, pii, quality, rules, secrets, toxicity, urls, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1,
    "op2_url_templates": urls.op2,
    "op3_toxic_instances": toxicity.op3,
    "op4_secret_ledger": secrets.op4,
    "op5_pii_bootstrap": pii.op5,
    "op6_rule_bitmasks": rules.op6,
    "op7_minhash_near_dedup": minhash.op7,
    "op8_quality_bayes": quality.op8,
    "op9_language_gru": language.op9,
    "op10_decontamination": decontaminate.op10,
    "op11_fill_in_middle": middle.op11,
    "op12_embedding_whitening": whitening.op12,
    "op13_line_dedup": lines.op13,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {"op6_rule_bitmasks": rules.SQL, "op10_decontamination": decontaminate.SQL, "op11_fill_in_middle": middle.SQL, "op13_line_dedup": lines.SQL}
