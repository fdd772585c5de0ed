"""Imports every module of queries so that they register themselves."""

from lodestone.plans import storage_queries  # noqa: F401
from lodestone.plans import text_queries  # noqa: F401
from lodestone.plans import retrieval_queries  # noqa: F401
from lodestone.plans import graph_queries  # noqa: F401
from lodestone.plans import learning_queries  # noqa: F401
from lodestone.plans import source_queries  # noqa: F401
from lodestone.plans import more_queries  # noqa: F401
