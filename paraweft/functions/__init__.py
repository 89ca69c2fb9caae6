"""Part of paraweft."""
