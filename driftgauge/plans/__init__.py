"""The stages of an evaluation, composed from the operators."""
