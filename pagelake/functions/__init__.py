"""Column → Column expressions (Catalyst built-ins only)."""

from pagelake.functions.html import (collapse_ws, content_hash, decode_entities, html_text,
                                     html_title, node_text_stripped, strip_ws)
from pagelake.functions.text import (chunk_windows, citation_numbers, common_prefix_len, decode_body,
                                     highlight, repair_mojibake, serialize_table, snippet)
from pagelake.functions.urls import domain, origin, resolve_url, title_from_url, url_part
from pagelake.functions.vectors import check_vectors, cosine_distance, dot, l2_norm

__all__ = [
    "collapse_ws", "content_hash", "decode_entities", "html_text", "html_title", "node_text_stripped",
    "strip_ws", "chunk_windows", "citation_numbers", "common_prefix_len", "decode_body", "highlight",
    "repair_mojibake", "serialize_table", "snippet", "domain", "origin", "resolve_url",
    "title_from_url", "url_part", "check_vectors", "cosine_distance", "dot", "l2_norm",
]
