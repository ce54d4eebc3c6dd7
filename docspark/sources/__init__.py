"""docspark.sources"""
