"""docspark.operators"""
