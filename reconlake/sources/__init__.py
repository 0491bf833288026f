"""Statement files, settlement reports and feeds as DataFrames."""
