"""Claim grounding and requirement-fit analytics on Spark."""
