"""The queries of this subpackage and, where SQL can express them, their SQL."""

from phylospark.llm.decontamination import NEAR_SQL, OP6_SQL, near_terms, op6_decontamination
from phylospark.llm.divergence import OP13_SQL, op13_divergence
from phylospark.llm.extraction import op4_extraction
from phylospark.llm.filter_audit import OP11_SQL, op11_filter_audit
from phylospark.llm.media import op2_media
from phylospark.llm.mixing import OP7_SQL, op7_mixing
from phylospark.llm.pii import op8_pii
from phylospark.llm.quality import op3_quality
from phylospark.llm.sharding import op5_sharding
from phylospark.llm.simhash import op9_simhash
from phylospark.llm.suffixes import op10_suffixes
from phylospark.llm.tokens import op1_tokens
from phylospark.llm.url_filters import OP12_SQL, op12_url_filters

QUERIES = {
    "op1_tokens": op1_tokens,
    "op2_media": op2_media,
    "op3_quality": op3_quality,
    "op4_extraction": op4_extraction,
    "op5_sharding": op5_sharding,
    "op6_decontamination": op6_decontamination,
    "near_terms": near_terms,
    "op7_mixing": op7_mixing,
    "op8_pii": op8_pii,
    "op9_simhash": op9_simhash,
    "op10_suffixes": op10_suffixes,
    "op11_filter_audit": op11_filter_audit,
    "op12_url_filters": op12_url_filters,
    "op13_divergence": op13_divergence,
}

ORACLES = {
    "op6_decontamination": OP6_SQL,
    "near_terms": NEAR_SQL,
    "op7_mixing": OP7_SQL,
    "op11_filter_audit": OP11_SQL,
    "op12_url_filters": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
