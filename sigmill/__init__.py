"""Sigmill: mining grounded user-problem signals from large post collections with Spark."""
