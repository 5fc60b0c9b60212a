"""Tidemark: analytics on Spark for entities whose value is observed at irregular dates."""
