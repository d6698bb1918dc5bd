"""Part of the notes engine."""
