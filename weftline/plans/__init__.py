"""Registered queries: every operator applied to adapter views of the driver's tables, and the same in SQL."""
