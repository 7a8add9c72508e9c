"""Operators for preparing training data: one module each, plus ``queries`` with their registered forms."""
