"""Registered queries: every operator over the driver's tables, each with its SQL twin."""
