"""Spark-native hybrid-peptide analytics."""
