"""Landed input to domain rows: one module per source family."""
