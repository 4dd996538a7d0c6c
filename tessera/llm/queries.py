"""One query for each of the thirteen training-data operators, with SQL where SQL can express the result."""

from __future__ import annotations

from tessera.llm.decontamination import OP5_SQL, op5_decontamination
from tessera.llm.html_text import op8_html_text
from tessera.llm.language_model import OP2_SQL, op2_lm_scoring
from tessera.llm.lexical_search import OP13_SQL, op13_lexical_search
from tessera.llm.minhash import OP7_SQL, op7_minhash
from tessera.llm.mixing import OP3_SQL, op3_mixing
from tessera.llm.packing import op11_packing
from tessera.llm.quality import op4_quality
from tessera.llm.secrets import op6_secrets
from tessera.llm.spelling import OP12_SQL, op12_spelling_variants
from tessera.llm.substring_dedup import OP1_SQL, op1_substring_dedup
from tessera.llm.topk import OP9_SQL, op9_exact_topk
from tessera.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_mixing": op3_mixing,
    "op4_quality": op4_quality,
    "op5_decontamination": op5_decontamination,
    "op6_secrets": op6_secrets,
    "op7_minhash": op7_minhash,
    "op8_html_text": op8_html_text,
    "op9_exact_topk": op9_exact_topk,
    "op10_warc": op10_warc,
    "op11_packing": op11_packing,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_lexical_search": op13_lexical_search,
}
ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": OP1_SQL,
    "op2_lm_scoring": OP2_SQL,
    "op3_mixing": OP3_SQL,
    "op5_decontamination": OP5_SQL,
    "op7_minhash": OP7_SQL,
    "op9_exact_topk": OP9_SQL,
    "op10_warc": OP10_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_lexical_search": OP13_SQL,
}
