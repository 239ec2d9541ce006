"""The corpus operators' queries and, where SQL can express them, their SQL."""

from torquil.llm.class_lm import op1_class_lm
from torquil.llm.html_text import op8_html_text
from torquil.llm.language_filters import op12_language_filters
from torquil.llm.licenses import op10_licenses
from torquil.llm.near_vectors import op9_near_vectors
from torquil.llm.ngram_join import op2_ngram_join
from torquil.llm.packing import op5_packing
from torquil.llm.prefix_trie import SQL as PREFIX_TRIE, op11_prefix_trie
from torquil.llm.quality import op6_quality
from torquil.llm.sample_pieces import op7_sample_pieces
from torquil.llm.secrets import op3_secrets
from torquil.llm.spelling_trie import op13_spelling_trie
from torquil.llm.suffix_dedup import op4_suffix_dedup

QUERIES = {f.__name__: f for f in (op1_class_lm, op2_ngram_join, op3_secrets, op4_suffix_dedup, op5_packing, op6_quality, op7_sample_pieces, op8_html_text, op9_near_vectors, op10_licenses, op11_prefix_trie, op12_language_filters, op13_spelling_trie)}
SQL: dict[str, str] = {"op11_prefix_trie": PREFIX_TRIE}
