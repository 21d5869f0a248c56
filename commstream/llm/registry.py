"""Queries of this subpackage and the SQL that DuckDB checks them with."""

from __future__ import annotations

from commstream.llm.bpe import op3_bpe
from commstream.llm.chat_format import op5_chat_format
from commstream.llm.embedding_dedup import op7_embedding_dedup
from commstream.llm.language_id import op6_language_id
from commstream.llm.mixing import ORACLE_SQL as MIXING_SQL
from commstream.llm.mixing import op4_mixing
from commstream.llm.ngram_jaccard import op2_ngram_jaccard
from commstream.llm.pii import op1_pii
from commstream.llm.quality import op8_quality
from commstream.llm.simhash import op10_simhash
from commstream.llm.substring_dedup import op9_substring_dedup

QUERIES = {
    f.__name__: f
    for f in (op1_pii, op2_ngram_jaccard, op3_bpe, op4_mixing, op5_chat_format, op6_language_id, op7_embedding_dedup, op8_quality, op9_substring_dedup, op10_simhash)
}

ORACLES = {"op4_mixing": MIXING_SQL}
