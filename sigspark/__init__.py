"""Signal-capture analytics on Spark: frames, spectra, regions, tracks, measurements, decisions, scores."""

import sys

from pyspark import cloudpickle

# tasks get the package's small Python helpers with the job, so workers need no copy of it on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
