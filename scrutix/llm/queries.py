"""The thin ``opN_*`` queries and their SQL, one per operator."""

from __future__ import annotations

from .chat import SQL as CHAT_SQL
from .chat import op4_chat
from .cnn import op7_quality
from .common import table
from .embeddings import SQL as VECTOR_SQL
from .embeddings import op10_embeddings
from .matroska import op2_matroska
from .mixing import op1_mixing
from .packing import op8_packing
from .pii import op9_pii
from .setsketch import SQL as NEAR_SQL
from .setsketch import op6_setsketch
from .urls import op3_urls
from .warc import op5_warc

QUERIES = {
    "op1_mixing": lambda spark, d: op1_mixing(table(spark, d, "documents")),
    "op2_matroska": lambda spark, d: op2_matroska(table(spark, d, "documents")),
    "op3_urls": lambda spark, d: op3_urls(table(spark, d, "pages")),
    "op4_chat": lambda spark, d: op4_chat(table(spark, d, "conversations")),
    "op5_warc": lambda spark, d: op5_warc(table(spark, d, "pages")),
    "op6_setsketch": lambda spark, d: op6_setsketch(table(spark, d, "documents")),
    "op7_quality": lambda spark, d: op7_quality(table(spark, d, "documents"), table(spark, d, "labels")),
    "op8_packing": lambda spark, d: op8_packing(table(spark, d, "documents")),
    "op9_pii": lambda spark, d: op9_pii(table(spark, d, "documents")),
    "op10_embeddings": lambda spark, d: op10_embeddings(table(spark, d, "embeddings")),
}

ORACLE_SQL: dict[str, str] = {"op4_chat": CHAT_SQL, "op6_setsketch": NEAR_SQL, "op10_embeddings": VECTOR_SQL}
