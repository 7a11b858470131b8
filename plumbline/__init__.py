"""Spark-native hybrid retrieval, index building and retrieval evaluation.

Everything is a function from DataFrames to DataFrames.  Packages:

``functions``  column expressions (text, vectors, intent, prompts, files)
``operators``  DataFrame operators (chunking, sparse, dense, fusion, evaluation, chat, model jobs)
``sources``    readers, stored tables, upsert / delete / reindex
``plans``      composed retrieval and answer plans, block-wise top-k, ordered segments
``streaming``  Structured Streaming jobs
``workload``   the registered queries over the test tables and their SQL twins
"""
import sys

from pyspark import cloudpickle

# Arrow and pandas functions travel to the executors by value, so a cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
