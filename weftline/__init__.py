"""weftline: sequence analytics on Spark DataFrames.

Any table that can be read as *sequence -> unit -> token* (programs and their
functions, documents and their lines, users and their events) gets frequency,
n-gram, information, motif, language-model, compression, distance, clone,
classification and resampling operators, each a function from DataFrames to a
lazy DataFrame.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Kernels travel with their code, so executors need not have this package
    on their own path."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()
