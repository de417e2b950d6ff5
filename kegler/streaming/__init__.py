"""Shots from a live stream of signals."""
