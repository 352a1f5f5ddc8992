"""Readers, writers and dispatch rules."""
