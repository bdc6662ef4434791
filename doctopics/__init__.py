"""doctopics: document analytics as Spark jobs.

clean -> tokenise -> vectorise -> factor / cluster -> describe topics -> evaluate -> compare,
each step a function from DataFrame to DataFrame or a fitted model with ``transform``.
"""

__version__ = "0.1.0"
