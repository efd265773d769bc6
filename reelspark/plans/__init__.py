"""Whole retrieval plans and the storage of their stages."""
