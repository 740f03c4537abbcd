"""Queries of the training-data operators and the SQL that checks them."""

import corpus_pipeline
from quillspark.llm.bpe import op9_byte_bpe
from quillspark.llm.chat import ORACLE_SQL as CHAT_SQL
from quillspark.llm.chat import op5_chat_formatting
from quillspark.llm.embedding import op4_embedding_dedup
from quillspark.llm.langid import op3_language_id
from quillspark.llm.packing import op2_best_fit_packing
from quillspark.llm.quality import op8_quality_rules
from quillspark.llm.secrets import op6_secret_scans
from quillspark.llm.simhash import op10_simhash
from quillspark.llm.suffix import op1_suffix_array
from quillspark.llm.warc import ORACLE_SQL as WARC_SQL
from quillspark.llm.warc import op7_warc

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_embedding_dedup": op4_embedding_dedup,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_secret_scans": op6_secret_scans,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_simhash": op10_simhash,
    "pipeline": corpus_pipeline.run,
}

#: SQL where SQL can express the operator; the rest is tested against brute force in tests/llm.
ORACLES: dict[str, str] = {"op5_chat_formatting": CHAT_SQL, "op7_warc": WARC_SQL}
