"""plans of the sequence-sketch engine."""
