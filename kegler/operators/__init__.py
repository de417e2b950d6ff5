"""Operators on detections, signals, shots, colours and manifests."""
