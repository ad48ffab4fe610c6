"""corpusloom - web-corpus ingestion, retrieval and answer assembly as PySpark jobs.

Layout
    functions/  Column -> Column expressions (no UDFs, whole-stage codegen friendly)
    sources/    readers and collection writers
    operators/  DataFrame -> DataFrame operators (joins, windows, aggregates)
    plans/      end-to-end jobs composed of the operators
    streaming/  Structured Streaming jobs
"""

import sys

from pyspark import cloudpickle

# Ship the package's own functions inside task closures, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
