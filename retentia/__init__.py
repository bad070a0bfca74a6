"""Engagement analytics on Spark: sessions, cohorts, event metrics, funnels, streaming ingest."""
