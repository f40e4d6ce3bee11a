"""Composed jobs: preparation chain, training job, scoring, and the
registered queries that bind operators to the test tables."""
