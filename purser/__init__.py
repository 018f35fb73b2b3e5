"""Purser: cleaning, profiling and classifying large grouped manifests on Spark."""
