"""Publishing: fingerprints, gated and immutable writes, manifests."""
