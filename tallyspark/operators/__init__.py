"""tallyspark.operators"""
