"""Registered queries of this subpackage, and their SQL where it can express them."""

from .decontaminate import op9_decontaminate
from .divergence import OP11_SQL, op11_divergence
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .filter_audit import OP12_SQL, op12_filter_audit
from .html_extract import op5_html
from .jaccard import op3_jaccard
from .language import op10_language
from .line_dedup import op2_line_dedup, op2_line_dedup_whole
from .quality import op1_quality
from .sentencepiece_codec import op7_sentencepiece
from .suffix_dedup import op4_suffix_dedup
from .sharding import op6_sharding
from .token_counts import op13_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_line_dedup, op2_line_dedup_whole, op3_jaccard, op4_suffix_dedup, op5_html, op6_sharding, op7_sentencepiece,
        op8_exact_dedup, op9_decontaminate, op10_language, op11_divergence, op12_filter_audit, op13_token_counts,
    )
}
SQL = {"op8_exact_dedup": OP8_SQL, "op11_divergence": OP11_SQL, "op12_filter_audit": OP12_SQL}
