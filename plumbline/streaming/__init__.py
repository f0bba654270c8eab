"""Enrichment of streams (an extension: the batch plan is narrow, so it runs on streams as it is)."""
