"""Tessera: panorama-catalogue analytics and ranked vector search on Spark."""
