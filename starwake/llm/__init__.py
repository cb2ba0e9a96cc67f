"""Operations of a training-data pipeline, as Spark jobs over tables of documents, pages and vectors.

Functions of this subpackage that run inside tasks are sent with the job, so executors need numpy,
pandas and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
