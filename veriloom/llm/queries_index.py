"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import exact_dedup, fill_in_middle, mixing, prefix_trie, substring_dedup
from .decontamination import op9_decontamination
from .exact_dedup import op2_exact_dedup
from .fill_in_middle import op11_fill_in_middle
from .language import op8_language
from .licenses import op10_licenses
from .mixing import op13_mixing
from .near_dedup import op7_near_dedup
from .prefix_trie import op12_prefix_trie
from .quality import op5_quality
from .sentencepiece_sampling import op1_sentencepiece
from .substring_dedup import op6_substring_dedup
from .toxicity import op4_toxicity
from .url_filter import op3_url_filter

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_toxicity": op4_toxicity,
    "op5_quality": op5_quality,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_language": op8_language,
    "op9_decontamination": op9_decontamination,
    "op10_licenses": op10_licenses,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_mixing": op13_mixing,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op11_fill_in_middle": fill_in_middle.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_mixing": mixing.SQL,
}
