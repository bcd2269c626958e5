"""Algebra, parser, operand ordering and the planner."""
