"""Importing this module registers every query."""

from pairrank.plans import q_explain, q_fairness, q_intake, q_lexicon, q_pairs, q_ranking, q_text  # noqa: F401
from pairrank.plans.registry import ORACLES, QUERIES  # noqa: F401
