"""Continuous upkeep: new document files as a stream, applied to a store batch by batch."""
