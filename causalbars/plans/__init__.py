"""Plan-level helpers shared by the operators.

Everything here is plain DataFrame code; the point of the package is that no
helper ever asks one task to hold a whole series, fold or timeline.
"""
