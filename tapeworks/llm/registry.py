"""The queries of this subpackage by name, and DuckDB SQL for those that SQL can express."""

from tapeworks.llm.bpe import op1_bpe
from tapeworks.llm.decontaminate import op2_decontaminate
from tapeworks.llm.exact_dedup import OP11_SQL, op11_exact_dedup
from tapeworks.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from tapeworks.llm.html_extract import op8_html_extract
from tapeworks.llm.language_id import op3_language_id
from tapeworks.llm.merkle import OP13_SQL, op13_merkle
from tapeworks.llm.minhash import op9_minhash_near_dedup
from tapeworks.llm.quality_classifier import op10_quality_classifier
from tapeworks.llm.quality_rules import op6_quality_rules
from tapeworks.llm.suffix_dedup import op7_suffix_dedup
from tapeworks.llm.warc import OP4_SQL, op4_warc
from tapeworks.llm.wavelet import op5_token_ids

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_decontaminate": op2_decontaminate,
    "op3_language_id": op3_language_id,
    "op4_warc": op4_warc,
    "op5_token_ids": op5_token_ids,
    "op6_quality_rules": op6_quality_rules,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_html_extract": op8_html_extract,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_merkle": op13_merkle,
}
SQL: dict[str, str] = {"op4_warc": OP4_SQL, "op11_exact_dedup": OP11_SQL, "op12_fill_in_middle": OP12_SQL, "op13_merkle": OP13_SQL}
