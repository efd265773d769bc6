"""Operators over scenes, prompts, clips and names."""
