"""The queries of this subpackage and, where SQL can express them, their SQL."""

from .alignment import op11_align_tokens
from .html import op9_html_text
from .languages import op2_language
from .line_dedup import OP10_SQL, op10_line_dedup
from .media import op3_media
from .mixing import OP4_SQL, op4_mix_sources
from .packing import op13_pack
from .pieces import op8_sentencepiece
from .quality import op6_quality
from .simhash import op1_simhash
from .tokenfile import op5_token_file
from .topk import OP7_SQL, op7_top_k
from .trie import OP12_SQL, op12_prefix_trie

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_language": op2_language,
    "op3_media": op3_media,
    "op4_mix_sources": op4_mix_sources,
    "op5_token_file": op5_token_file,
    "op6_quality": op6_quality,
    "op7_top_k": op7_top_k,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_html_text": op9_html_text,
    "op10_line_dedup": op10_line_dedup,
    "op11_align_tokens": op11_align_tokens,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_pack": op13_pack,
}

ORACLE_SQL = {
    "op4_mix_sources": OP4_SQL,
    "op7_top_k": OP7_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
}
