"""tallyspark: reconciliation of messy shipment tables as composable Spark DataFrame operators."""

__version__ = "0.1.0"
