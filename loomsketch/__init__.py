"""Sequence-sketch analytics as Spark plans."""
