"""Writers and text reports."""
