"""Training-data operators: thirteen components that prepare text corpora at scale.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only when it is present.
"""
