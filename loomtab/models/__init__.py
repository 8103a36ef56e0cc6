"""Trainable models: DataFrame/SQL models, shared-pass gradient models, tree ensembles."""
