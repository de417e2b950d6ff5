"""Operators put together: from detections or signals to shots and manifests."""
