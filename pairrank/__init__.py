"""Ranking, fairness audit and explanation of item/posting pairs, as Spark DataFrame operators."""
