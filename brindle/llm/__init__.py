"""Training-data operators: de-duplication, scoring, tokenisation, packing and formatting of corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
