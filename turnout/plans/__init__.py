"""The named reports, each a DataFrame built from the operators."""
