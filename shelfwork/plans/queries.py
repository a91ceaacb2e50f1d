"""All registered queries."""

from . import file_queries, image_queries, label_queries, model_queries, report_queries, text_queries, vocab_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
