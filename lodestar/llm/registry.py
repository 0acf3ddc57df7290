"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestar.llm import fingerprint, langid, mixing, neardup, packing, pii, quality, secrets, urlfilter, warc

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_url_filter": urlfilter.op4_url_filter,
    "op5_language_id": langid.op5_language_id,
    "page_language": langid.page_language,
    "op6_fingerprints": fingerprint.op6_fingerprints,
    "op7_pii": pii.op7_pii,
    "op8_revisits": warc.op8_revisits,
    "op9_near_duplicates": neardup.op9_near_duplicates,
    "op10_source_mix": mixing.op10_source_mix,
}

ORACLES: dict[str, str] = {
    "op4_url_filter": urlfilter.OP4_SQL,
    "op8_revisits": warc.OP8_SQL,
    "op10_source_mix": mixing.OP10_SQL,
}
