"""All queries of the subpackage with the SQL that checks them."""

from affinity.llm import (
    ctw,
    decision_list,
    gam_quality,
    html_wrappers,
    icws_dedup,
    merkle,
    mixing,
    permuterm,
    secret_scan,
    sentencepiece_codec,
    substring_dedup,
    syncmers,
    url_filters,
)

MODULES = (
    sentencepiece_codec,
    decision_list,
    html_wrappers,
    substring_dedup,
    ctw,
    syncmers,
    icws_dedup,
    gam_quality,
    mixing,
    url_filters,
    merkle,
    secret_scan,
    permuterm,
)
