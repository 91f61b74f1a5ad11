"""Question-answer dataset engine on PySpark DataFrames."""
