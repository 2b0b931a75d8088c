"""All queries of this subpackage."""

import corpus_pipeline

from . import ann, chat, divergence, langid, media, mixing, paragraphs, pieces, pii, quality, search, simhash, urlrules

MODULES = (ann, chat, divergence, langid, media, mixing, paragraphs, pieces, pii, quality, search, simhash, urlrules)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}
