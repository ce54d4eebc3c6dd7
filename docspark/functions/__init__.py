"""docspark.functions"""
