"""functions of the sequence-sketch engine."""
