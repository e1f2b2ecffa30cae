"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op3_bpe
from .exact_dedup import OP8_SQL, op8_exact_dedup
from .html_wrapper import op10_html
from .language import op4_language
from .mixing import op7_mixing
from .near_dedup import op9_near_dedup
from .pii import op2_pii
from .quality import op6_quality
from .topk import OP1_SQL, op1_topk
from .url_filter import OP5_SQL, op5_url_filter

QUERIES = {
    f.__name__: f
    for f in (op1_topk, op2_pii, op3_bpe, op4_language, op5_url_filter, op6_quality, op7_mixing, op8_exact_dedup, op9_near_dedup, op10_html)
}
ORACLE_SQL = {"op1_topk": OP1_SQL, "op5_url_filter": OP5_SQL, "op8_exact_dedup": OP8_SQL}
