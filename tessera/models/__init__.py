"""Data-loss models of replicated layouts."""
