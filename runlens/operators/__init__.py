"""The catalogue of questions, each a function of DataFrames."""
