"""Larkspur: analytics over broker reports, market quotes, statements, sanctions lists and document records, as Spark DataFrame operators."""
