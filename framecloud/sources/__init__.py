"""Readers that turn files into frame, camera and point tables."""
