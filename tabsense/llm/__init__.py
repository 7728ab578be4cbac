"""Operators for large training corpora: one module per operator, registered in ``queries``."""
