"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .chat_format import OP2_SQL, op2_chat_format
from .cube_mix import op9_cube_mix
from .decontaminate import OP3_SQL, op3_decontaminate
from .line_dedup import OP8_SQL, op8_line_dedup
from .media_chunks import op1_media_chunks
from .ngram_join import OP10_SQL, op10_ngram_join
from .quality_bayes import op6_quality_bayes
from .toxicity import op5_toxicity
from .url_filter import op4_url_filter
from .warc_merkle import OP7_SQL, op7_warc_merkle

QUERIES = {
    "op1_media_chunks": op1_media_chunks,
    "op2_chat_format": op2_chat_format,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_quality_bayes": op6_quality_bayes,
    "op7_warc_merkle": op7_warc_merkle,
    "op8_line_dedup": op8_line_dedup,
    "op9_cube_mix": op9_cube_mix,
    "op10_ngram_join": op10_ngram_join,
}
ORACLE_SQL = {
    "op2_chat_format": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op7_warc_merkle": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_ngram_join": OP10_SQL,
}
