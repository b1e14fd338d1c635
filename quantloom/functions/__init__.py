"""Indicator, fee, slippage and sizing formulas as Columns."""
