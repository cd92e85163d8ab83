"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from lexshoal.llm import chat, decontaminate, lines, media, near, packing, quality, sharding, spelling, substrings, toxicity, trie, warc

_MODULES = (chat, packing, decontaminate, media, substrings, quality, lines, warc, near, toxicity, trie, spelling, sharding)

QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
