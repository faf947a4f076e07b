"""Operators for preparing language-model training data, and the registered queries over them."""
