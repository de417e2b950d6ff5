"""Venue and target files, frames, clips and the adapters of media tools."""
