"""Training-data operators: ten corpus-scale jobs, each a plain function from DataFrame to DataFrame.

Nothing outside this package imports it; deleting the folder leaves the rest of the library working.
"""
