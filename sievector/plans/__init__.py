"""Logical plans: registered queries, staging, iterative joins."""
