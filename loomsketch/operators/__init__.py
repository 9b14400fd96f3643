"""operators of the sequence-sketch engine."""
