"""Readers for annotation, region, vocabulary and image layouts."""
