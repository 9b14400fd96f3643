"""Readers and writers: FASTA, hexadecimal CSV, exon JSON, results of experiments, and the driver's tables as sequences."""
