"""All registered queries of the operators in this folder."""

from . import bpe, chat, decontaminate, hmm, language, merkle, neighbours, periods, quality, rules, simhash, toxicity, warc  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
