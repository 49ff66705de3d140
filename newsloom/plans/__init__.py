"""Registered queries of the core library, each with its SQL where SQL can say it."""
