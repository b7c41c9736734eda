"""Operators of a training-data pipeline, and their queries by name."""

from kerbsight.llm.chat import OP2_SQL, op2_chat_format
from kerbsight.llm.decontaminate import op4_decontaminate
from kerbsight.llm.divergence import OP11_SQL, op11_source_divergence
from kerbsight.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from kerbsight.llm.pii import op3_personal_data
from kerbsight.llm.pieces import op1_sentencepiece
from kerbsight.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from kerbsight.llm.secrets import OP7_SQL, op7_secret_scan
from kerbsight.llm.setsketch import OP12_SQL, op12_minhash_dedup
from kerbsight.llm.simhash import op5_simhash_dedup
from kerbsight.llm.token_files import op10_token_files
from kerbsight.llm.toxicity import op9_toxicity
from kerbsight.llm.urls import OP6_SQL, op6_url_filter

QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_chat_format, op3_personal_data, op4_decontaminate, op5_simhash_dedup, op6_url_filter, op7_secret_scan, op8_exact_dedup, op9_toxicity, op10_token_files, op11_source_divergence, op12_minhash_dedup, op13_prefix_trie)}
ORACLES: dict[str, str] = {"op2_chat_format": OP2_SQL, "op6_url_filter": OP6_SQL, "op7_secret_scan": OP7_SQL, "op8_exact_dedup": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_minhash_dedup": OP12_SQL, "op13_prefix_trie": OP13_SQL}
