"""The operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .decontaminate import SQL as _DECONTAMINATE_SQL
from .decontaminate import op1_decontaminate
from .fill_in_middle import SQL as _FILL_SQL
from .fill_in_middle import op13_fill_in_middle
from .html_text import op7_html_text
from .huffman import op6_huffman
from .language_id import op2_language_id
from .line_dedup import SQL as _LINE_SQL
from .line_dedup import op10_line_dedup
from .near_dedup import op5_near_dedup
from .quality import op3_quality
from .top_k import DOCUMENTS_SQL as _TOP_K_DOCUMENTS_SQL
from .top_k import SQL as _TOP_K_SQL
from .top_k import op9_top_k, op9_top_k_documents
from .toxicity import op4_toxicity
from .vector_codes import SQL as _CODES_SQL
from .vector_codes import op12_vector_codes
from .vector_dedup import SQL as _VECTOR_SQL
from .vector_dedup import op11_vector_dedup

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_near_dedup": op5_near_dedup,
    "op6_huffman": op6_huffman,
    "op7_html_text": op7_html_text,
    "op8_bpe": op8_bpe,
    "op9_top_k_documents": op9_top_k_documents,
    "op9_top_k": op9_top_k,
    "op10_line_dedup": op10_line_dedup,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_decontaminate": _DECONTAMINATE_SQL,
    "op9_top_k_documents": _TOP_K_DOCUMENTS_SQL,
    "op9_top_k": _TOP_K_SQL,
    "op10_line_dedup": _LINE_SQL,
    "op11_vector_dedup": _VECTOR_SQL,
    "op12_vector_codes": _CODES_SQL,
    "op13_fill_in_middle": _FILL_SQL,
}
