"""Training-data operators: extraction, language, quality, licences, dedup, decontamination, chat, packing.

Nothing else in the package imports this subpackage; ``queries.py`` here
registers its queries and ``corpus_pipeline.py`` chains five of the operators.
"""
