"""Operators for preparing large text corpora, with their queries.

Nothing else in the library imports this package.
"""

import importlib

#: Query modules, one for each operator; each has ``QUERY``, ``run`` and ``SQL`` (None where SQL cannot say it).
MODULES = [
    "decontamination", "exact_dedup", "token_counts", "token_files", "language_id", "toxicity", "html_extraction", "ngram_join", "kneser_ney", "sentencepiece",
    "token_alignment", "spelling_variants", "sketch_dedup",
]


def queries():
    """Query name to ``(run, sql)`` for every operator of this package."""
    found = {}
    for name in MODULES:
        module = importlib.import_module(f"firnline.llm.{name}")
        found[module.QUERY] = (module.run, module.SQL)
    return found
