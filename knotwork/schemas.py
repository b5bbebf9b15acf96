"""Schemas of the engine's tables; every table has a further partition column ``batch``."""

from __future__ import annotations

BATCHES = "origin string"
DOCUMENTS = "document_id string, text string, title string, file_type string, path string, deleted boolean"
CHUNKS = "chunk_id string, document_id string, chunk_index int, content string"
MENTIONS = "document_id string, text string, type string, start_pos int, end_pos int, metadata string, added boolean"
RELATIONS = (
    "document_id string, source string, source_type string, target string, target_type string, relationship string,"
    " confidence double, bidirectional boolean, added boolean"
)
EMBEDDINGS = "id string, document_id string, embedding array<double>"

TABLES = {
    "batches": BATCHES, "documents": DOCUMENTS, "chunks": CHUNKS, "mentions": MENTIONS, "relations": RELATIONS, "embeddings": EMBEDDINGS,
}
