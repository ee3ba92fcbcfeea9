"""Shared building blocks: constants, expressions, block-wise running totals, exact quantiles, lineage cuts."""
