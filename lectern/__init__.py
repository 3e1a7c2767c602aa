"""Lectern: analytics over collections of documents that cite one another, on Spark."""
