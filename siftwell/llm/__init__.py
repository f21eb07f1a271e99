"""Operators for preparing training text: one module per operator, registered by ``queries``."""
