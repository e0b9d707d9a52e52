"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from linewise.llm.decontaminate import op9_benchmark_decontamination
from linewise.llm.infill import op13_fill_in_middle
from linewise.llm.language import op8_language_id
from linewise.llm.licenses import op3_license_scans
from linewise.llm.lines import op1_line_dedup
from linewise.llm.mixing import op11_source_mixing
from linewise.llm.oracle import infill_sql, license_sql, line_dedup_sql, mixing_sql, quality_sql, trie_sql
from linewise.llm.packing import op4_best_fit_packing
from linewise.llm.quality import op2_quality_rules
from linewise.llm.sharding import op7_sharding
from linewise.llm.simhash import op6_simhash_near_dedup
from linewise.llm.tokenfile import op10_token_planes
from linewise.llm.toxicity import op5_toxicity
from linewise.llm.trie import op12_prefix_trie

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_quality_rules": op2_quality_rules,
    "op3_license_scans": op3_license_scans,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_toxicity": op5_toxicity,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_token_planes": op10_token_planes,
    "op11_source_mixing": op11_source_mixing,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE: dict[str, str] = {
    "op1_line_dedup": line_dedup_sql(),
    "op2_quality_rules": quality_sql(),
    "op3_license_scans": license_sql(),
    "op11_source_mixing": mixing_sql(),
    "op12_prefix_trie": trie_sql(),
    "op13_fill_in_middle": infill_sql(),
}
