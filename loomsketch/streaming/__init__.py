"""streaming of the sequence-sketch engine."""
