"""Transcript, note and training-corpus analytics as Spark DataFrame operators."""
