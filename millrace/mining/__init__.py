"""Frequent itemsets, association rules and what follows from them."""
