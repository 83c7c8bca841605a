"""Cutting lineage through the shared checkpoint folder that the cluster names."""

from quadrille.functions.lineage import cut

__all__ = ["cut"]
