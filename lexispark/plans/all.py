"""All queries of the core."""

from functools import reduce

from . import q_dictionary, q_fusion, q_reports, q_retrieval, q_scoring, q_spans, q_splits, q_text
from .catalogue import Catalogue

CORE = reduce(Catalogue.merge, [q_scoring.C, q_text.C, q_dictionary.C, q_fusion.C, q_retrieval.C, q_spans.C, q_splits.C, q_reports.C], Catalogue())
