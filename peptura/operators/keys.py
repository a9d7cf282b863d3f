"""What names a spectrum: scan numbers repeat from sample to sample."""

SPECTRUM = ["sample", "scan"]
