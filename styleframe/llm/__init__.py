"""Training-data operators: thirteen distributed operators and their registered queries.

One module per operator; ``queries.py`` registers ``op1_`` .. ``op13_`` and
``pipeline`` (``corpus_pipeline.py`` at the repository top chains five of them).
Nothing else in the library imports this subpackage.
"""
