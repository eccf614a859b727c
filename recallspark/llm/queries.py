"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from recallspark.llm import ann, bpe, chat, html_text, language, lattice, maxscore, merkle, ngram_join, packing, pii, quality, whitening

MODULES = [ann, bpe, chat, html_text, language, lattice, maxscore, merkle, ngram_join, packing, pii, quality, whitening]

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
