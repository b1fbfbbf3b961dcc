"""All queries of the rating engine: name -> (function of (spark, dir), SQL or None)."""

from . import evaluation, features

QUERIES = {**features.QUERIES, **evaluation.QUERIES}
