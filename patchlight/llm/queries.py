"""The queries of this subpackage and, where SQL can say them, their oracles."""

from .q_archive import OP3_SQL, op3_archive
from .q_chat_pairs import OP2_SQL, op2_chat_pairs
from .q_contamination import OP5_SQL, op5_contamination
from .q_filter_audit import OP11_SQL, op11_filter_audit
from .q_html_text import OP13_SQL, op13_html_text
from .q_language import op1_language
from .q_line_rules import OP9_SQL, op9_line_rules
from .q_lm_scoring import op8_context_tree
from .q_mixing import OP10_SQL, op10_mix
from .q_ngram_join import OP4_SQL, op4_ngram_join
from .q_quality import op7_quality
from .q_ranked_search import OP12_SQL, op12_ranked_search
from .q_url_templates import OP6_SQL, op6_url_templates

QUERIES = {"op1_language": op1_language, "op2_chat_pairs": op2_chat_pairs, "op3_archive": op3_archive, "op4_ngram_join": op4_ngram_join, "op5_contamination": op5_contamination, "op6_url_templates": op6_url_templates, "op7_quality": op7_quality, "op8_context_tree": op8_context_tree, "op9_line_rules": op9_line_rules, "op10_mix": op10_mix, "op11_filter_audit": op11_filter_audit, "op12_ranked_search": op12_ranked_search, "op13_html_text": op13_html_text}
ORACLES = {"op2_chat_pairs": OP2_SQL, "op3_archive": OP3_SQL, "op4_ngram_join": OP4_SQL, "op5_contamination": OP5_SQL, "op6_url_templates": OP6_SQL, "op9_line_rules": OP9_SQL, "op10_mix": OP10_SQL, "op11_filter_audit": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_html_text": OP13_SQL}
