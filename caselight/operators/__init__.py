"""Operators: cleaning, extraction, rules, consistency, causality, duplicates, analytics, reports, privacy."""
