"""The queries of the numbered operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .ann import op6_additive_quantisation_search
from .bpe import op3_bpe_encode_decode
from .collocations import op13_phrase_collocations
from .filter_audit import op12_filter_interaction_audit
from .fingerprints import op5_document_fingerprints
from .html_extract import op2_html_extraction
from .jaccard_join import op9_ngram_jaccard_join
from .language_id import op11_language_id
from .licenses import op10_license_scan
from .oracles import collocations_sql, filter_audit_sql, license_scan_sql, secret_scan_sql, substring_dedup_sql
from .packing import op4_minimum_bin_slack_packing
from .quality import op7_quality_classifier
from .secrets import op8_secret_scan
from .substring_dedup import op1_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_html_extraction,
        op3_bpe_encode_decode,
        op4_minimum_bin_slack_packing,
        op5_document_fingerprints,
        op6_additive_quantisation_search,
        op7_quality_classifier,
        op8_secret_scan,
        op9_ngram_jaccard_join,
        op10_license_scan,
        op11_language_id,
        op12_filter_interaction_audit,
        op13_phrase_collocations,
    )
}

#: The others are beyond SQL, or only close to what it gives: their tests hold them against brute force, a library, an
#: exact round trip or held-out accuracy.
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup_sql(),
    "op8_secret_scan": secret_scan_sql(),
    "op10_license_scan": license_scan_sql(),
    "op12_filter_interaction_audit": filter_audit_sql(),
    "op13_phrase_collocations": collocations_sql(),
}
