"""Training-data operators: one module per operator, plus their queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
