"""tallyspark.functions"""
