"""Lectern: documents to chunks, graphs and answers, as Spark plans."""
