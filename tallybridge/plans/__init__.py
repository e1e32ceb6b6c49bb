"""Whole workflows: compare, report, migrate, gated write."""
