"""Reading, footers and writing."""
